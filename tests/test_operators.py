"""Operators on small fixtures: goldens, idempotence and order independence."""

import random

from pyspark.sql import functions as F

from scriptorium.functions import structure as S
from scriptorium.functions import text as T
from scriptorium.operators import evaluate, graph, jobs, records, relational, retrieval
from scriptorium.plans.components import connected_components, merged_components
from scriptorium.sources import files, html


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_cleaning_is_idempotent(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", T.clean_text(F.col("text"), True).alias("once"))
    assert docs.where(T.clean_text(F.col("once"), True) != F.col("once")).count() == 0


def test_cleaning_goldens(spark):
    assert one(spark, T.clean_text(F.col("t")), t="meth-\nod ﬁt — “x”\nPage 3 of 10\n") == 'method fit -- "x"'
    assert one(spark, T.clean_text(F.col("t"), True), t="a,\nb.\nhttps://x.org/1\nEnd") == "a, b.\n\nEnd"
    assert one(spark, T.escape_query(F.col("t")), t="a+b (c)") == "a\\+b \\(c\\)"
    assert one(spark, T.count_of(F.col("t"), F.lit("aa")), t="aaaaa") == 2


def test_chunks_cover_the_text(spark):
    for n in (0, 1, 9, 10, 11, 17, 25):
        text = "".join(chr(97 + i % 26) for i in range(n))
        parts = one(spark, T.fixed_chunks(F.col("t"), 10, 3), t=text)
        assert all(p == text[i * 7 : i * 7 + 10] for i, p in enumerate(parts))
        assert (not parts and n == 0) or len(parts[-1]) + 7 * (len(parts) - 1) == n


def test_authors_and_headings(spark):
    assert one(spark, S.clean_author(F.col("t")), t="John Smith1,*") == "JOHN SMITH"
    assert one(spark, S.clean_author(F.col("t")), t="Smith, J. A.") == "SMITH, J. A"
    assert one(spark, S.clean_author(F.col("t")), t="N/A") is None
    for line, want in (("1. Introduction", True), ("plain words", False), ("x = y", False), ("References", True), ("ALL CAPS LINE", True)):
        assert one(spark, S.is_heading(F.col("t")), t=line) is want


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_merged_components_are_those_of_all_links(spark):
    old, new = [(1, 2), (2, 3), (7, 8), (10, 11)], [(3, 8), (20, 11), (30, 31), (31, 0), (5, 5), (2, 1)]
    component = connected_components(spark.createDataFrame(old, "a long, b long"), "a", "b")
    got = {r.node: r.component for r in merged_components(component, spark.createDataFrame(new, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 10: 10, 11: 10, 20: 10, 30: 0, 31: 0, 0: 0}


def test_upserts_do_not_depend_on_order_and_repeat_harmlessly(spark):
    rng = random.Random(2)
    batch = [(rng.randrange(5), rng.random(), f"e{i}") for i in range(40)]
    schema = "k int, confidence double, evidence string"
    empty = spark.createDataFrame([], schema)

    def apply(rows, old):
        return graph.upsert_best(old, spark.createDataFrame(rows, schema), ["k"], "confidence", ["evidence"])

    first = apply(batch, empty)
    want = sorted(map(tuple, first.collect()))
    assert sorted(map(tuple, apply(batch[::-1], empty).collect())) == want
    assert sorted(map(tuple, apply(batch, first).collect())) == want


def test_cycles_are_rejected(spark):
    tree = spark.createDataFrame([(2, 1), (3, 2), (4, 3)], "src long, dst long")
    new = spark.createDataFrame([(1, 3), (1, 1), (5, 4), (1, 4)], "src long, dst long")
    assert sorted(map(tuple, graph.reject_cycles(tree, new).select("src", "dst").collect())) == [(5, 4)]
    c = spark.createDataFrame([(1, "a", "b", 0.9), (1, "b", "a", 0.8), (1, "b", "c", 0.7), (1, "c", "a", 0.95)], "group long, src string, dst string, confidence double")
    assert sorted((r.src, r.dst) for r in graph.accept_in_order(c).collect()) == [("a", "b"), ("c", "a")]


def test_rank_metrics(spark):
    hits = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("q", 3, 1), ("z", 1, 0)], "q string, rank int, rel int")
    m = {r.q: r for r in evaluate.rank_metrics(hits, ["q"], 5).collect()}
    assert (m["q"].precision_k, round(m["q"].precision_n, 4), m["q"].recall, m["q"].hit, m["q"].mrr) == (0.4, 0.6667, 1.0, 1, 0.5)
    assert (m["z"].mrr, m["z"].ndcg_list, m["z"].recall) == (0.0, 0.0, 0.0)


def test_scores_are_bounded(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert docs.where(~T.ocr_score(T.mojibake_ratio(F.col("text")), T.noisy_ratio(F.col("text"))).between(0, 1)).count() == 0
    lists = spark.createDataFrame([("q", "k", 1, 1), ("q", "k", 2, 1), ("q", "m", 1, 2)], "query_id string, key string, list_no int, rank int")
    assert {r.key: r.score for r in retrieval.rrf(lists).collect()} == {"k": round(2 / 61, 6), "m": round(1 / 62, 6)}


def test_queue(spark):
    rows = [(1, "pending", "2024-01-01 00:00:00", "a", 0), (2, "pending", "2024-01-01 00:00:00", "a", 0), (3, "running", "2024-01-01 00:00:00", "b", 2), (4, "running", "2024-01-01 00:00:00", "b", 3), (5, "running", "2024-01-01 00:55:00", "b", 0)]
    df = spark.createDataFrame(rows, "job_id int, status string, at string, kind string, retry int").withColumn("created_at", F.to_timestamp("at")).withColumn("started_at", F.to_timestamp("at"))
    assert [r.job_id for r in jobs.claim(df, ["kind"]).collect()] == [1]
    got = {r.job_id: (r.status, r.retry) for r in jobs.recover(df, F.to_timestamp(F.lit("2024-01-01 01:00:00"))).collect()}
    assert got == {1: ("pending", 0), 2: ("pending", 0), 3: ("pending", 3), 4: ("running", 3), 5: ("running", 0)}


def test_entities_and_tables(spark):
    df = spark.createDataFrame([(1, "ResNet-50", ["residual net"], 0.9, 0), (1, "resnet 50", [], 0.5, 1), (1, "Residual Net", [], 0.95, 2)], "doc_id int, name string, aliases array<string>, confidence double, section int")
    assert [r.name for r in records.merge_entities(df).collect()] == ["ResNet-50"]
    page = "<html><body><h1>T</h1><p>a&amp;b <script>no</script>c</p><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table></body></html>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    assert [(r.tag, r.text) for r in html.text_blocks(pages).orderBy("block").collect()][:2] == [("h1", "T"), ("p", "a&b c")]
    assert [(r.headers, r.data) for r in html.tables(pages).collect()] == [(["x", "y"], [["1", "2"]])]


def test_documents_and_profile(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"doc_id": "1", "title": "T", "unknown": 5,\n "sections": [{"name": "s", "content": "c"}]}')
    row = files.read_documents(spark, str(tmp_path)).first()
    assert (row.doc_id, row.sections[0].content) == ("1", "c") and "unknown" not in row
    df = spark.createDataFrame([(1, None), (1, "x")], "a int, b string")
    assert {r.column_name: (r.total, r.nulls, r.distinct_values) for r in relational.profile(df).collect()} == {"a": (2, 0, 1), "b": (2, 1, 1)}
    assert [r.a for r in relational.page(spark.range(9).toDF("a"), ["a"], 2, 4).collect()] == [4, 5, 6, 7]
