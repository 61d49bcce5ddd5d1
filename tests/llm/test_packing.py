"""Packing: nothing lost, bins keep their bounds, and the best bin is chosen."""

import random
import re
import time
from collections import Counter, defaultdict

from scriptorium.llm import packing


def plain_best_fit(sizes, clusters, sources, capacity, most):
    room, held, bins = [], [], []
    for size, c, s in zip(sizes, clusters, sources, strict=True):
        fits = [(r, b) for b, r in enumerate(room) if r >= size and r > 0 and (c is None or ("c", c) not in held[b]) and (s is None or held[b][("s", s)] < most)]
        if fits:
            b = min(fits)[1]
        else:
            b = len(room)
            room.append(capacity)
            held.append(Counter())
        room[b] -= size
        held[b].update([("c", c), ("s", s)])
        bins.append(b)
    return bins


def test_best_fit_equals_the_plain_search():
    rng = random.Random(5)
    for trial in range(60):
        n = rng.randrange(1, 150)
        rows = sorted(((rng.choice([rng.randrange(1, 60), 30, 100]), rng.choice([None, 1, 1, 1, rng.randrange(40)]), rng.choice([None, "a", "a", "b", "c"])) for _ in range(n)), key=lambda x: (-x[0], str(x)))
        sizes, clusters, sources = zip(*rows, strict=True)
        bins, offsets = packing.best_fit(sizes, clusters, sources, 100, 1 + trial % 3)
        assert bins == plain_best_fit(sizes, clusters, sources, 100, 1 + trial % 3)


def check(rows, got, capacity, most):
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    pieces, bins = defaultdict(list), defaultdict(list)
    text, source = {i: t for i, t, _ in rows}, {i: s for i, _, s in rows}
    for r in got:
        pieces[r.doc_id].append((r.first_token, r.n_tokens))
        assert (r.bin_id is None) == (r.n_tokens == 0)
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for i, n in words.items():
        at = 0
        for first, k in sorted(pieces[i]):
            assert first == at
            at += k
        assert at == n
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= capacity
        assert max(Counter(text[r.doc_id] for r in held).values()) == 1
        assert max(Counter(source[r.doc_id] for r in held if source[r.doc_id]).values(), default=0) <= most
    return len(bins), sum(words.values())


def test_documents(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    n, words = check(rows, packing.pack(docs).collect(), 2048, 2)
    assert n * 2048 < 1.6 * words
    monkeypatch.setattr(packing, "GROUP", 10)
    check(rows, packing.pack(docs, capacity=500).collect(), 500, 2)


def test_nulls_copies_and_empty(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y z", None), (4, "x y z", "a"), (5, "w " * 30_000, "b"), (6, "q", "a"), (7, "r", "a"), (8, "t", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, cluster int")
    check(rows, packing.pack(df, capacity=1000).collect(), 1000, 2)
    assert packing.pack(df.limit(0)).collect() == []
    repeated = spark.createDataFrame([(None, "same text", "a")] * 50, "doc_id long, text string, source string")
    assert len({r.bin_id for r in packing.pack(repeated).collect()}) == 50


def test_copies_of_a_hot_text_are_spread_over_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 60)
    rows = [(i, "w " * 10 if i % 3 == 0 else f"t{i} " * 90, None) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n, _ = check(rows, packing.pack(df, capacity=100).collect(), 100, 2)
    assert n <= 880  # 800 at best: every copy beside another text


def test_a_hot_source_is_not_walked(monkeypatch):
    """Bins that a hot source or cluster has filled are not searched again."""
    n = 8192
    began = time.perf_counter()
    bins, _ = packing.best_fit(sorted((i * 37 % 700 + 20 for i in range(n)), reverse=True), [None] * n, ["a"] * n, 2048, 2)
    assert len(set(bins)) == n // 2
    rng = random.Random(2)
    rows = sorted(((rng.randrange(20, 700), 1 if i % 3 == 0 else 10 + i, "a" if i % 3 == 0 else rng.choice("bcdefg")) for i in range(n)), key=lambda x: (-x[0], str(x)))
    bins, _ = packing.best_fit(*zip(*rows, strict=True), 2048, 2)
    assert len(set(bins)) <= n // 2
    assert time.perf_counter() - began < 4


def test_hot_indexes_change_nothing(monkeypatch):
    rng = random.Random(11)
    for trial in range(20):
        n = rng.randrange(60, 300)
        rows = sorted(((rng.randrange(1, 80), rng.choice([1, 1, 2, 10 + rng.randrange(200)]), rng.choice(["a", "a", "b", None])) for _ in range(n)), key=lambda x: (-x[0], str(x)))
        assert packing.best_fit(*zip(*rows, strict=True), 100, 1 + trial % 2)[0] == plain_best_fit(*zip(*rows, strict=True), 100, 1 + trial % 2)


def test_groups_do_not_follow_the_shuffle_partitions(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted((r.doc_id, r.piece, r.bin_id or -1) for r in packing.pack(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len({b >> 20 for *_, b in found[0]}) > 5


def test_text_ids_and_clashing_names(spark):
    df = spark.createDataFrame([("x", "a b", "s", 1, 2)] * 3 + [("y", "w " * 5000, None, 1, 2)], "doc_id string, text string, source string, row int, words int")
    got = packing.pack(df, capacity=2000).collect()
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in got) == [("x", 0, 2)] * 3 + [("y", 0, 2000), ("y", 1, 2000), ("y", 2, 1000)]
    assert len({r.bin_id for r in got if r.doc_id == "x"}) == 3
