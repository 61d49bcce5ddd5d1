"""Quality cascade against loops over strings."""

import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

from scriptorium.llm import quality
from scriptorium.llm.kernel import utf8


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(grams)
    covered = {j for i, g in enumerate(grams) if counts[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    letters = sum(bool(re.search("[A-Za-z]", x)) or any(ord(c) >= 0xC0 for c in x) for x in w)
    kept = not failed and 2 * len(w) <= chars <= 15 * len(w) and 100 * symbols <= 30 * len(w) and 100 * dup <= 50 * len(lines)
    kept = kept and 100 * letters >= 60 * len(w) and 100 * max(Counter(w).values(), default=0) <= 40 * len(w)
    return (len(w), chars, symbols, dup, len(covered), failed, kept)


def test_matches_loops_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: brute(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality.judge(docs).collect()}
    assert got == want


ROWS = [(1, None), (2, ""), (3, "\n\n \n"), (4, "a b c a b c\na b c\n\na b c"), (5, "é " * 60), (6, "word" * 40_000), (7, "x1 " * 100_000), (None, "no id | here"), (4, "again\r\nagain\r\n"), (8, " ".join(f"w{i}" for i in range(80)))]


def test_odd_rows_and_every_order(spark):
    docs = spark.createDataFrame([(*r, 5) for r in ROWS], "doc_id long, text string, kept int")
    want = sorted((str(i), *brute(t)) for i, t in ROWS)
    for rules in itertools.islice(itertools.permutations(quality.RULES), 0, 720, 240):
        got = quality.judge(docs, rules).collect()
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == want
        assert all((r.rejected_by is None) == r.kept for r in got)


def test_empty_table_and_sampled_order(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(empty).collect() == []
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert {r.name for r in quality.order_rules(docs)} == {r.name for r in quality.RULES}


def block(texts):
    return quality.Block(*utf8(pa.array(texts, pa.string())))


def test_survivors_keep_their_features(sf):
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()] + [None, "", "a\nb\na", "é é é é"]
    whole = block(texts)
    rows = np.arange(0, len(texts), 3)
    for known in ([], ["top_word"], ["n_dup_lines", "n_repeat_words"], list(quality._PER_ROW)):
        for name in known:
            getattr(whole, name)
        part, alone = whole.subset(rows), block([texts[i] for i in rows])
        assert set(known) <= set(part.__dict__)
        for name in quality._PER_ROW:
            assert (getattr(part, name) == getattr(alone, name)).all()


def test_later_rules_see_survivors_only_and_metrics_cost_nothing(spark, sf):
    """The cascade does less than all rules on all rows."""
    seen = {r.name: 0 for r in quality.RULES}

    def counted(rule):
        def rejects(b):
            seen[rule.name] += b.rows
            return rule.rejects(b)

        return quality.Rule(rule.name, rejects)

    texts = ["short", "x1 " * 100, " ".join(f"word{i}" for i in range(60))]
    rules = [counted(r) for r in quality.RULES]
    assert quality.cascade(block(texts), rules) == ["base", "base", None]
    assert seen["base"] == 3 and all(n == 1 for name, n in seen.items() if name != "base")
    found = quality.order(block(texts * 50), quality.RULES, quality.METRICS)
    assert sorted(n for n, _, _ in found) == sorted(r.name for r in quality.RULES) and sum(r for *_, r in found) == 100
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = {r.doc_id: r.kept for r in quality.judge(docs, quality.RULES, metrics=()).collect()}
    assert plain == {r.doc_id: r.kept for r in quality.judge(docs).collect()}


def test_text_ids_and_clashing_names(spark):
    docs = spark.createDataFrame([("x", "a b", 1, "n"), ("x", "a b", 1, "n")], "doc_id string, text string, n_words int, id string")
    got = quality.judge(docs).collect()
    assert [(r.doc_id, r.n_words, r.kept) for r in got] == [("x", 2, False)] * 2
