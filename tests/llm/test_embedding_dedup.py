"""Embedding near-dedup against all pairs."""

import math

import numpy as np

from scriptorium.llm import embedding_dedup as e


def brute(rows, cosine=0.95):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links, parent = {n: 0 for n in range(len(rows))}, {i: i for i, _ in ok}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v in ok:
        a = np.array(v, np.float64)
        for j, w in ok:
            b = np.array(w, np.float64)
            if i < j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    count = {i: sum(1 for j, w in ok if j != i and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= cosine) for i, v in ok}
    return {i: (count[i], find(i)) for i, _ in ok}


def test_matches_all_pairs(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    x = np.array([v for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = ((x @ x.T) >= 0.95).sum(1) - 1
    for block, dense in ((1024, 8), (7, 8), (1024, 0), (7, 0)):
        monkeypatch.setattr(e, "BLOCK", block)
        monkeypatch.setattr(e, "DENSE", dense)
        got = {r.vec_id: r for r in e.near_duplicates(df).collect()}
        assert [got[i].n_links for i, _ in rows] == want.tolist()
        assert {i: (r.n_links, r.component_id) for i, r in got.items()} == brute(rows)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [0.97, 0.3]), (12, [0.8, 0.55])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, copies int")
    got = e.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want.get(r.vec_id, (0, r.vec_id))
        assert r.kept == (r.vec_id is None or r.vec_id == r.component_id)
    assert e.near_duplicates(df.limit(0)).collect() == []


def test_size_ties_repeats_and_clashing_names(spark):
    """Components of any finite size; a cosine at the threshold links; copies and repeated ids count by their own vector."""
    rows = [(1, [3e200, 4e200]), (2, [3e-200, 4e-200]), (3, [4.0, -3.0]), (3, [3.0, 4.0]), (3, [3.0, 4.0]), (4, [4.0, -3.0]), (5, [1.0] * 5000), (6, [1.0] * 4999 + [1.01])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, rep long, signs int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in e.near_duplicates(df).collect())
    assert got == sorted([(1, 2, 1), (2, 2, 1), (3, 1, 3), (3, 2, 1), (3, 2, 1), (4, 1, 3), (5, 1, 5), (6, 1, 5)])
    tie = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r.n_links for r in e.near_duplicates(tie, cosine=0.7).collect()] == [1, 1]


def test_a_large_group_of_near_copies(spark):
    """Thousands of distinct near copies: no row per pair, all links counted."""
    rng = np.random.default_rng(9)
    one = rng.standard_normal(32)
    x = np.concatenate([one + rng.standard_normal((2500, 32)) * 0.1, rng.standard_normal((500, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in e.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((unit @ unit.T) >= 0.95).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= (1 - 1e-4) * want.sum()
    assert {got[i].component_id for i in np.flatnonzero(want > 50)} == {0}


def test_plan_keeps_recall_at_every_size():
    for n in (2, 10_000, 10**6, 10**9):
        bits, tables = e.plan(n, 0.95)
        same = (1 - math.acos(0.95) / math.pi) ** bits
        assert (1 - same) ** tables <= e.MISS
        assert bits * tables // 10 < e.most_different(bits * tables, 0.95) < bits * tables // 2 or bits * tables < 60
