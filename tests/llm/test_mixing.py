"""Mixing against the closed forms and its own promises."""

import math
import re
from collections import Counter, defaultdict

import pytest

from scriptorium.llm import mixing
from scriptorium.plans.scratch import stored


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def entropy(tokens, a):
    q = [t**a for t in tokens]
    return -sum(x / sum(q) * math.log(x / sum(q)) for x in q)


def sources(spark, tokens):
    return stored(spark.createDataFrame([(f"s{i}", 1, t) for i, t in enumerate(tokens)], "source string, docs long, tokens long"), "test_sources")


def test_exponent(spark):
    tokens = [50_000, 7000, 900, 900]
    a = mixing.solve_exponent(sources(spark, tokens), max_repeats=3.0)
    assert a == pytest.approx(1 - math.log(3) / math.log(50_000 / 900), abs=1e-6)
    b = mixing.solve_exponent(sources(spark, tokens), entropy=1.1)
    assert entropy(tokens, b) == pytest.approx(1.1, abs=1e-5)
    assert mixing.solve_exponent(sources(spark, tokens), max_repeats=1.0) == pytest.approx(1.0)
    assert mixing.solve_exponent(sources(spark, [5, 5]), max_repeats=2.0) < 1e-6
    assert mixing.solve_exponent(sources(spark, [0]), max_repeats=2.0) == 1.0
    with pytest.raises(ValueError):
        mixing.solve_exponent(sources(spark, tokens))


@pytest.mark.parametrize("budget", [None, 120_000])
def test_readings_follow_the_budgets(spark, sf, monkeypatch, budget):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 3)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    count = {r.doc_id: words(r.text) for r in rows}
    tokens, members = Counter(), defaultdict(list)
    for r in rows:
        tokens[r.source] += count[r.doc_id]
        members[r.source].append(r.doc_id)
    a = mixing.solve_exponent(docs.groupBy("source").agg({"doc_id": "count"}).join(spark.createDataFrame(list(tokens.items()), "source string, tokens long"), "source"), max_repeats=2.5)
    z = sum(t**a for t in tokens.values())
    total = budget or max(t / (t**a / z) for t in tokens.values())
    read = mixing.mix(docs, max_repeats=2.5, budget_tokens=budget).collect()
    got = defaultdict(lambda: defaultdict(list))
    for r in read:
        assert r.n_tokens == count[r.row.doc_id]
        got[r.row.source][r.epoch].append((r.place, r.row.doc_id))
    for s, t in tokens.items():
        want = total * t**a / z
        done = sum(count[i] for e in got[s].values() for _, i in e)
        assert want - 1 <= done <= want + max(count[i] for i in members[s]) + 1
        whole = int(round(want) // t)
        for e in range(whole):
            assert sorted(i for _, i in got[s][e]) == sorted(members[s])
        assert len({i for _, i in got[s].get(whole, [])}) == len(got[s].get(whole, [])) and max(got[s], default=0) <= whole
    if budget is None:
        assert {r.row.doc_id for r in read} == set(count)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c", None, 0), (2, None, "x", 0), (3, "", "y", 0), (4, "w " * 50_000, "z", 0), (5, "a", "z", 0), (5, "a", "z", 0), (None, "a b", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, epoch int")
    read = mixing.mix(df, max_repeats=4.0).collect()
    seen = Counter(r.row.doc_id for r in read)
    assert set(seen) == {1, 2, 3, 4, 5, None} and seen[4] == 1 and seen[5] == 2 and seen[1] >= 3 and seen[2] == seen[3] == 1
    assert mixing.mix(df.limit(0), max_repeats=4.0).collect() == []
