"""Steps whose cost must grow with their input: what they join, what they broadcast, and the same results."""

import pytest

from scriptorium.operators import records as M


def plan(df):
    return df._jdf.queryExecution().toString()


def test_substrings_meet_without_broadcast(spark):
    names = [(i, f"Name#{i:06d}") for i in range(3000)] + [(3000, "ab"), (3001, ""), (3002, None), (3003, "Dr. AB")]
    asked = [(1, "000012"), (2, "Dr. name#000100 jr."), (3, "AB"), (4, ""), (5, None), (6, "name#000007")]
    df = M.substring_pairs(spark.createDataFrame(asked, "query_id long, q string"), spark.createDataFrame(names, "id long, name string"))
    want = sorted((q, i) for q, a in asked for i, t in names if a is not None and t is not None and (a.lower() in t.lower() or t.lower() in a.lower()))
    assert sorted(map(tuple, df.collect())) == want
    assert "Broadcast" not in plan(df)


def test_lookups_by_rare_words_agree_with_all_pairs(spark):
    import random
    import re

    draw = random.Random(3)
    names = [(i, " ".join(draw.choices("a b c d e f g h".split(), k=draw.randint(1, 6)))) for i in range(150)] + [(150, "Zeta-ONE two"), (151, "zeta one TWO three"), (152, ""), (153, None), (154, "-")]
    df = spark.createDataFrame(names, "id long, name string")
    sets = {i: {w for w in re.split(r"[^\w]+", (t or "").lower()) if w} for i, t in names}
    for least, k in ((0.5, 2), (0.6, 3), (0.75, 1), (0.8, 1), (0.0, 2)):
        want = []
        for i, a in sets.items():
            scored = [(-len(a & b) / max(len(a), len(b)), j) for j, b in sets.items() if a & b]
            want += [(i, j, -s, r) for r, (s, j) in enumerate(sorted(x for x in scored if -x[0] >= least)[:k], 1)]
        got = M.overlap_lookup(df, df, least, k)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert "Broadcast" not in plan(got)


@pytest.mark.parametrize("name", ["best_concept_match", "match_concepts", "match_evidences", "fulltext_lookup"])
def test_lookups_take_the_whole_table(spark, sf, name):
    from scriptorium import registry

    found = registry.queries()[name](spark, sf)
    assert found.where("id % 100 <> 0").count() > 0
    assert "% 100" not in registry.oracle_sql()[name]


def agrees(spark, tmp_path, name, **tables):
    """A query over tables of the test against its SQL."""
    import duckdb

    from scriptorium import registry

    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    got = [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


def test_roundtrip_keeps_every_document(spark, tmp_path):
    texts = ["plain", "", "   ", None, "a\r\nb\rc d\u0085", 'q"\\ \U0001f600', "\t", "x" * 300_000]
    rows = [(i, t, la, None if t is None else len(t)) for i, t in enumerate(texts) for la in ("en", 'd"e', "f\nr", "a,b", "z\\", "", None)]
    agrees(spark, tmp_path, "json_jsonl_csv_text_roundtrip", documents=spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long"))


def test_page_titles_with_cut_references(spark, tmp_path):
    titles = ["a &amp; b", "cut &amp", "&quot;q&quot; &amp;amp;", "end &", "&amp;&amp;&amp", "x &a", "&#38; &lt;"]
    html = '<html lang="en"><head><title>{0}</title></head><body><article><h1>{0}</h1><p>Text.</p></article></body></html>'
    rows = [(i, f"http://x/{i}", html.format(t)) for i, t in enumerate(titles)]
    agrees(spark, tmp_path, "page_documents", pages=spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_rouge_of_long_answers_is_linear(spark, tmp_path):
    import time

    long = [" ".join(f"w{i % m}" for i in range(20_000)) for m in (19_999, 15_000)]
    turns = [(1, 1, "user", long[0]), (1, 2, "assistant", long[1]), (2, 1, "user", "A b\ta  b\n"), (2, 2, "assistant", " a b b\x0ba"), (2, 3, "user", ""), (2, 4, "assistant", "x"), (3, 1, "user", ""), (3, 2, "assistant", " ")]
    tables = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    start = time.time()
    agrees(spark, tmp_path, "rouge_1_2", conversations=tables)
    agrees(spark, tmp_path, "summary_mode_avg", conversations=tables)
    assert time.time() - start < 60


def test_period_chunks_without_python(spark):
    from scriptorium.catalog.records import chunk_at_periods

    def cut(rest, most):
        out = []
        while len(rest) > most:
            at = rest.rfind(".", 0, most)
            at = at + 1 if at > 0.6 * most else most
            out.append(rest[:at])
            rest = rest[at:]
        return [*out, rest] if rest else out

    texts = ["", "a", "a.b" * 40, "é" * 25 + "." + "ü.\U0001f600" * 20, "." * 50, "x" * 20, "x" * 21, "123456.7890", "1234567.890", "abcdefghi.k", "abcdefghij.k"]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    for most in (10, 20, 7, 1):
        got = chunk_at_periods(df, most)
        assert sorted(map(tuple, got.collect())) == [(i, n, p) for i, t in enumerate(texts) for n, p in enumerate(cut(t, most))]
        assert "Python" not in plan(got)


def test_vectors_leave_a_worker_in_slices(spark):
    import numpy as np
    import pyarrow as pa

    from scriptorium.operators import models

    asked = []

    def load():
        model = models.HashEmbedder(8)
        return lambda texts: (asked.append(len(texts)), model(texts))[1]

    texts = [f"w{i} w{i % 7}" for i in range(1000)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    out = list(models.vectors_of(load, 16)(iter([batch])))
    assert max(b.num_rows for b in out) <= models.SLICE and max(asked) <= 16
    got = np.array([v for b in out for v in b.column(1).to_pylist()])
    assert np.allclose(got, models.HashEmbedder(8)(texts)) and [i for b in out for i in b.column(0).to_pylist()] == list(range(len(texts)))


def graph_of(spark):
    import random

    draw = random.Random(5)
    edges = {(p, t): draw.randint(1, 9) / 10 for p in range(60) for t in draw.sample(range(12), 3)}
    df = spark.createDataFrame([(p, t, c, 1.0 + t % 3) for (p, t), c in edges.items()], "paper long, target long, confidence double, w double")
    sources = spark.range(0, 60, 7).withColumnRenamed("id", "src")
    others = spark.range(0, 60).where("id % 3 <> 0").withColumnRenamed("id", "other")
    return edges, df, sources, others


def test_shared_targets_move_no_pair_alone(spark, monkeypatch):
    import re
    from collections import defaultdict

    from pyspark.sql import functions as F

    from scriptorium.operators import graph as G

    monkeypatch.setattr(G, "POSTINGS", 4)
    edges, df, sources, others = graph_of(spark)
    got = G.co_occurrence(df, sources, (F.col("confidence") + F.col("a_confidence")) * F.col("a_w"), others=others, shared=["w"])
    want = defaultdict(float)
    for (p, t), c in edges.items():
        for (q, u), d in edges.items():
            if t == u and p % 7 == 0 and p != q and q % 3:
                want[p, q] += (c + d) * (1.0 + t % 3)
    assert {(r.src, r.other): r.raw for r in got.collect()} == pytest.approx(dict(want))
    assert not re.search(r"hashpartitioning\(src#\d+L?, other#", plan(got))


def test_hierarchy_moves_no_pair_alone(spark, monkeypatch):
    import re
    from collections import defaultdict

    from scriptorium.operators import graph as G

    monkeypatch.setattr(G, "POSTINGS", 4)
    edges, df, sources, others = graph_of(spark)
    tree = spark.range(2, 12).selectExpr("id AS src", "id div 2 AS dst")
    got = G.hierarchy_signal(df.select("paper", "target"), tree, sources, 2, others=others)
    up = {(t, t // 2, 1) for t in range(2, 12)} | {(t, t // 2 // 2, 2) for t in range(4, 12)}
    hit = {(p, q, hop, way) for p, t in edges if p % 7 == 0 for a, b, hop in up for way, (x, y) in enumerate(((a, b), (b, a))) if x == t for q, u in edges if u == y and q != p and q % 3}
    want = defaultdict(float)
    for p, q, hop, _ in hit:
        want[p, q] += 1 / (hop + 1)
    assert {(r.src, r.other): r.raw for r in got.collect()} == pytest.approx(dict(want))
    assert not re.search(r"hashpartitioning\(src#\d+L?, other#", plan(got))


def test_recommendation_deals_pairs_once(spark, sf):
    import re

    from scriptorium import registry
    from scriptorium.catalog.graph import _signals
    from scriptorium.operators import graph as G

    assert "hashpartitioning(src" in plan(_signals(spark, sf))
    for name in ("recommend_topk", "batch_recommend"):
        found = plan(registry.queries()[name](spark, sf)).partition("== Physical Plan ==")[2]
        last = found[: found.index("Union")]
        assert not re.search(r"Exchange hashpartitioning\(src#\d+L?, (other|signal)#", last)
    rows = [(1, 2, "x", 4.0), (1, 3, "x", 2.0), (1, 3, "y", 5.0), (1, 1, "x", 9.0), (2, 5, "y", 0.0), (2, 6, "z", 1.0)]
    got = G.recommend(spark.createDataFrame(rows, "src long, other long, signal string, raw double"), {"x": 0.6, "y": 0.4}, 5)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 0.266667, 2), (1, 3, 0.533333, 1)]


def test_assertions_sort_no_edge(spark):
    import re

    from scriptorium.operators import graph as G

    nodes = spark.createDataFrame([("a", "Paper", False), ("a", "Concept", False), ("b", "Paper", False), ("c", "Paper", True), ("d", "Odd", False), (None, "Paper", False), ("e", "Paper", False)], "id string, kind string, stub boolean")
    edges = spark.createDataFrame([("a", "b", "CITES"), ("a", "x", "CITES"), ("x", "y", "CITES"), ("y", "a", "ODD"), (None, "a", "CITES"), ("e", None, "USES_CONCEPT"), ("x", "y", "CITES"), ("z", None, "CITES")], "src string, dst string, kind string")
    calls = spark.createDataFrame([("extract", True)], "phase string, success boolean")
    got = G.assertions(nodes, edges, edges, edges, nodes, calls)
    values = {r.assertion: r.value for r in got.collect()}
    assert values["nodes"] == 7 and values["edges"] == 8 and values["node_types"] == 1 and values["edge_types"] == 1 and values["type_conflicts"] == 1
    assert values["isolated"] == pytest.approx(3 / 7, abs=1e-6) and values["degree"] == pytest.approx((4 + 4 + 1 + 1) / 7, abs=1e-6)
    assert values["consistency"] == pytest.approx(1 / 8) and values["papers_without_edges"] == 2
    assert len(re.findall("Join LeftSemi", plan(got).partition("== Optimized Logical Plan ==")[2].partition("== Physical Plan ==")[0])) == 2  # the unknown ends alone


def test_titles_are_scored_by_distinct_texts(spark):
    import difflib
    import re

    base = ["deep nets for graphs", "Deep nets for graph", "cats and dogs", "cats and dog", "", None]
    titles = [(i * 10 + j, t) for i, t in enumerate(base) for j in range(4)]
    df = spark.createDataFrame(titles, "id long, title string")
    got = M.similar_titles(df.where("id % 2 = 0"), df)
    ratio = {(i, j): difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio() for i, a in titles for j, b in titles if i != j and i % 2 == 0 and a and b}
    rows = got.collect()
    assert {(r.id, r.match): r.ratio for r in rows} == pytest.approx({k: v for k, v in ratio.items() if v >= 0.8}) and len(rows) == len(set(rows))
    assert re.search(r"MapInPandas score\(x#\d+, y#\d+\)", plan(got)) and "BroadcastHashJoin" not in plan(got)
