"""Near-dedup against brute force over all pairs."""

import random
import re

import numpy as np

from scriptorium.llm import minhash


def brute(rows, k, percent):
    sets = {}
    for doc_id, text in rows:
        if doc_id is None:
            continue
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        s = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(doc_id, []).append(frozenset(s))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_matches_brute_force_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (2, 5):
        want = brute(rows, k, 80)
        got = minhash.near_duplicates(docs, shingle_words=k).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_nulls_repeats_and_short_texts(spark):
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (None, "one two"), (8, long_text), (9, long_text + " end"), (9, "one"), (10, "ünï cödé"), (10, "ünï cödé")]
    docs = spark.createDataFrame([(*r, "x", r[0]) for r in rows], "doc_id long, text string, id string, component_id long")
    got = minhash.near_duplicates(docs, shingle_words=2).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute(rows, 2, 80)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def family(members, planted, seed=7):
    """Texts of 800 words that differ in about 133 of them (similarity about 0.71), and the last ``planted`` in 80 from one of the first (0.82)."""
    rng = random.Random(seed)
    rows = [[rng.randrange(3) for _ in range(200)] for _ in range(members)]
    for i in range(planted):
        near = list(rows[i])
        for j in rng.sample(range(200), 80):
            near[j] = (near[j] + 1) % 3
        rows.append(near)
    common = " ".join(f"c{i}" for i in range(600))
    return [(i, common + " " + " ".join(f"s{j}x{v}" for j, v in enumerate(r))) for i, r in enumerate(rows)]


def test_pairs_within_a_family_just_below_the_threshold(spark, monkeypatch):
    rows = family(200, 40)
    want = brute(rows, 1, 80)
    assert sum(i != c for i, c in want.items()) >= 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle_words=1).collect()} == want
    for block, dense in ((30, 4), (256, 10**9), (50, 0)):  # blocks of texts, single pairs, every unit as a block
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "DENSE", dense)
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, shingle_words=1).collect()} == want


def test_shared_counts_and_the_filter():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, rng.integers(0, 300)).astype(np.uint64)) for _ in range(40)]
    assert (minhash.shared_counts(sets) * (1 - np.eye(40)) == [[len(np.intersect1d(a, b)) if i != j else 0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]).all()
    for n, size in ((300, 5), (300, 60), (300, 1000)):
        for _ in range(n):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
            other = np.concatenate([base[: size - size // 10], rng.integers(0, 1 << 63, size // 10, dtype=np.uint64)])
            x, y = (minhash.sketch(np.unique(s))[: minhash.BANDS * minhash.ROWS] for s in (base, other))
            assert (x == y).sum() >= minhash.least_equal(np.array([size]), 80)[0]
