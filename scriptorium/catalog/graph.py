"""The knowledge graph over adapters: orders are papers, customers authors, parts concepts, suppliers evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import graph as G
from scriptorium.registry import query

from .base import table

CATEGORY = {"ECONOMY": "method", "STANDARD": "model", "MEDIUM": "task", "PROMO": "framework", "LARGE": "technology", "SMALL": "concept"}
CATEGORY_SQL = "CASE split_part(p_type, ' ', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY.items()) + " END"

SQL = {
    "papers": "SELECT o_orderkey AS id, o_custkey AS author, year(o_orderdate) AS year, CASE WHEN o_orderstatus = 'P' THEN 'stub' ELSE 'kg_built' END AS status FROM orders",
    "concepts": f"SELECT p_partkey AS id, p_name AS name, {CATEGORY_SQL} AS category FROM part",
    "uses": "SELECT l_orderkey AS paper, l_partkey AS target, max(1 - l_discount) AS confidence FROM lineitem GROUP BY ALL",
    "evaluates": "SELECT l_orderkey AS paper, l_suppkey AS target, max(1 - l_tax) AS confidence FROM lineitem GROUP BY ALL",
    "cites": "SELECT DISTINCT src, dst FROM (SELECT o_orderkey AS src, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dst FROM orders UNION ALL SELECT o_orderkey, o_orderkey // 2 FROM orders WHERE o_orderkey > 1) WHERE dst IS NOT NULL AND src <> dst",
    "based_on": "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1",
}


def with_sql(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " "


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderstatus") == "P", "stub").otherwise("kg_built").alias("status"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kinds[F.substring_index("p_type", " ", 1)].alias("category"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("target")).agg(F.max(1 - F.col("l_discount")).alias("confidence"))


def evaluates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("target")).agg(F.max(1 - F.col("l_tax")).alias("confidence"))


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    both = o.select(F.col("o_orderkey").alias("src"), before.alias("dst")).unionByName(o.where("o_orderkey > 1").select(F.col("o_orderkey").alias("src"), F.expr("o_orderkey div 2").alias("dst")))
    return both.where("dst is not null and src <> dst").distinct()


def based_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


@query("kg_nodes_edges_counts", with_sql("uses", "evaluates", "cites") + "SELECT 'Paper' AS label, count(*)::BIGINT AS n FROM orders UNION ALL SELECT 'Author', count(*) FROM customer UNION ALL SELECT 'Concept', count(*) FROM part UNION ALL SELECT 'Evidence', count(*) FROM supplier UNION ALL SELECT 'USES_CONCEPT', count(*) FROM uses UNION ALL SELECT 'EVALUATES_ON', count(*) FROM evaluates UNION ALL SELECT 'CITES', count(*) FROM cites")
def kg_nodes_edges_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"Paper": table(spark, sf_dir, "orders"), "Author": table(spark, sf_dir, "customer"), "Concept": table(spark, sf_dir, "part"), "Evidence": table(spark, sf_dir, "supplier"), "USES_CONCEPT": uses(spark, sf_dir), "EVALUATES_ON": evaluates(spark, sf_dir), "CITES": cites(spark, sf_dir)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("kg_top_concepts", with_sql("uses") + "SELECT target AS concept, count(*)::BIGINT AS papers, round(avg(confidence), 6) AS avg_confidence FROM uses GROUP BY 1 ORDER BY papers DESC, concept LIMIT 20")
def kg_top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = uses(spark, sf_dir).groupBy(F.col("target").alias("concept")).agg(F.count("*").alias("papers"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    return n.orderBy(F.desc("papers"), "concept").limit(20)


@query("kg_top_evidence", with_sql("evaluates") + "SELECT target AS evidence, count(*)::BIGINT AS papers FROM evaluates GROUP BY 1 ORDER BY papers DESC, evidence LIMIT 20")
def kg_top_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluates(spark, sf_dir).groupBy(F.col("target").alias("evidence")).agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "evidence").limit(20)


@query("kg_metric_best", "SELECT l_orderkey AS paper, l_returnflag AS metric, l_linestatus AS measured_on, max(l_extendedprice) AS value FROM lineitem GROUP BY ALL ORDER BY value DESC, paper, metric, measured_on LIMIT 20")
def kg_metric_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("measured_on")).agg(F.max("l_extendedprice").alias("value"))
    return best.orderBy(F.desc("value"), "paper", "metric", "measured_on").limit(20)


@query("kg_finding_summary", "SELECT o_orderpriority AS finding_type, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS avg_value FROM orders GROUP BY 1")
def kg_finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("finding_type")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("avg_value"))


@query(
    "kg_paper_entity_counts",
    with_sql("papers", "uses", "evaluates", "cites") + """SELECT id, coalesce(c, 0)::BIGINT AS concepts, coalesce(e, 0)::BIGINT AS evidences, coalesce(r, 0)::BIGINT AS refs FROM papers LEFT JOIN (SELECT paper, count(*) AS c FROM uses GROUP BY 1) u ON u.paper = id
LEFT JOIN (SELECT paper, count(*) AS e FROM evaluates GROUP BY 1) v ON v.paper = id LEFT JOIN (SELECT src, count(*) AS r FROM cites GROUP BY 1) w ON w.src = id""",
)
def kg_paper_entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side is counted before it is joined, so no join fans out."""
    out = papers(spark, sf_dir).select("id")
    for name, df, key in (("concepts", uses(spark, sf_dir), "paper"), ("evidences", evaluates(spark, sf_dir), "paper"), ("refs", cites(spark, sf_dir), "src")):
        out = out.join(df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


_BATCH = "SELECT l_orderkey AS paper, l_partkey AS target, l_linenumber AS line, 1 - l_discount AS confidence FROM lineitem"


@query(
    "upsert_concept_edges",
    f"WITH b AS ({_BATCH}) SELECT paper, target, max(confidence) AS confidence, arg_max(line, (confidence, -(line % 2), line)) AS evidence FROM b GROUP BY ALL",
)
def upsert_concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("evidence"), (1 - F.col("l_discount")).alias("confidence"))
    return G.upsert_best(lines.where("evidence % 2 = 0"), lines.where("evidence % 2 = 1"), ["paper", "target"], "confidence", ["evidence"])


@query("upsert_metric_edges", "SELECT l_orderkey AS paper, l_returnflag AS metric, l_linestatus AS measured_on, l_suppkey AS measured_by, max(l_extendedprice) AS value, arg_max(CASE WHEN l_linenumber % 2 = 0 THEN 'stored' ELSE 'new' END, (l_extendedprice, l_linenumber % 2 = 0)) AS seen FROM lineitem GROUP BY ALL")
def upsert_metric_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even lines are stored; the odd ones come as a batch and win only with a higher value."""
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("measured_on"), F.col("l_suppkey").alias("measured_by"), F.col("l_extendedprice").alias("value"), "l_linenumber")
    old, new = m.where("l_linenumber % 2 = 0").withColumn("seen", F.lit("stored")), m.where("l_linenumber % 2 = 1").withColumn("seen", F.lit("new"))
    return G.upsert_best(old, new, ["paper", "metric", "measured_on", "measured_by"], "value", ["seen"])


@query(
    "paper_merge_by_title_year",
    """WITH o AS (SELECT 'T' || o_orderkey % 700 AS title, CASE WHEN o_orderkey % 5 > 0 THEN year(o_orderdate) ELSE 0 END AS year, min(o_orderkey) AS id, min_by('old' || o_orderkey, o_orderkey) AS abstract FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL),
n AS (SELECT 'T' || o_orderkey % 700 AS title, CASE WHEN o_orderkey % 5 > 0 THEN year(o_orderdate) ELSE 0 END AS year, min(o_orderkey) AS id, min_by('new' || o_orderkey, o_orderkey) AS abstract FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL)
SELECT title, year::BIGINT AS year, coalesce(o.id, n.id) AS id, coalesce(o.abstract, n.abstract) AS abstract FROM o FULL JOIN n USING (title, year)""",
)
def paper_merge_by_title_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is title and year, an unknown year being 0; what is stored stays."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("T"), F.col("o_orderkey") % 700).alias("title"), F.when(F.col("o_orderkey") % 5 > 0, F.year("o_orderdate")).alias("year"))
    keyed = rows.withColumn("year", F.coalesce("year", F.lit(0)).cast("long"))

    def side(where: str, mark: str) -> DataFrame:
        return keyed.where(where).groupBy("title", "year").agg(F.min("id").alias("id")).withColumn("abstract", F.concat(F.lit(mark), "id"))

    return G.upsert_fill(side("id % 3 = 0", "old"), side("id % 3 <> 0", "new"), ["title", "year"], [], ["id", "abstract"])


@query(
    "upsert_topics",
    """WITH t AS (SELECT DISTINCT p_partkey AS paper, lower(trim(x)) AS topic, lo FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS x, 'stored' AS lo FROM part WHERE p_partkey % 3 <> 1 UNION ALL SELECT p_partkey, unnest(string_split(p_type || ' ' || p_name, ' ')), 'batch' FROM part WHERE p_partkey % 2 = 0) WHERE trim(x) <> '')
SELECT paper, topic, min(lo) AS source FROM t GROUP BY ALL""",
)
def upsert_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of a batch beside stored ones; an edge's source is the last to write it."""
    part = table(spark, sf_dir, "part")

    def topics(rows: DataFrame, text: str, source: str) -> DataFrame:
        words = rows.select(F.col("p_partkey").alias("paper"), F.explode(F.split(F.expr(text), " ")).alias("t"))
        return words.select("paper", F.lower(F.trim("t")).alias("topic")).where("topic <> ''").distinct().withColumn("source", F.lit(source))

    old = topics(part.where("p_partkey % 3 <> 1"), "p_type", "stored")
    new = topics(part.where("p_partkey % 2 = 0"), "concat(p_type, ' ', p_name)", "batch")
    return G.upsert_fill(old, new, ["paper", "topic"], ["source"], [])


@query(
    "upsert_similar_to",
    """WITH o AS (SELECT o_orderkey AS src, o_orderkey // 2 AS dst, o_totalprice AS score, 'old' AS shared FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS src, o_orderkey // 2 AS dst, o_totalprice / 2 AS score, 'new' AS shared FROM orders WHERE o_orderkey % 2 = 0)
SELECT src, dst, round(coalesce(n.score, o.score), 4) AS score, coalesce(o.shared, n.shared) AS shared FROM o FULL JOIN n USING (src, dst)""",
)
def upsert_similar_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), F.expr("o_orderkey div 2").alias("dst"), F.col("o_totalprice").alias("score"))
    old = o.where("src % 3 <> 0").withColumn("shared", F.lit("old"))
    new = o.where("src % 2 = 0").withColumn("score", F.col("score") / 2).withColumn("shared", F.lit("new"))
    return G.upsert_fill(old, new, ["src", "dst"], ["score"], ["shared"]).withColumn("score", F.round("score", 4))


@query(
    "paper_merge",
    """WITH o AS (SELECT o_orderkey AS id, 'A' || o_orderkey AS title, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'old' END AS abstract FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS id, 'B' || o_orderkey AS title, 'new' AS abstract FROM orders WHERE o_orderkey % 2 = 0)
SELECT id, coalesce(n.title, o.title) AS title, CASE WHEN coalesce(o.abstract, '') = '' THEN coalesce(n.abstract, o.abstract) ELSE o.abstract END AS abstract FROM o FULL JOIN n USING (id)""",
)
def paper_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    old = o.where("id % 3 <> 0").select("id", F.concat(F.lit("A"), "id").alias("title"), F.when(F.col("id") % 5 == 0, "").otherwise("old").alias("abstract"))
    new = o.where("id % 2 = 0").select("id", F.concat(F.lit("B"), "id").alias("title"), F.lit("new").alias("abstract"))
    return G.upsert_fill(old, new, ["id"], ["title"], ["abstract"])


_REFS = """r AS (SELECT l_orderkey * 10 + l_linenumber AS ref_id, CASE WHEN l_linenumber % 4 = 0 THEN l_partkey END AS doc_id, CASE WHEN l_linenumber % 4 = 1 THEN '10.1/' || l_suppkey END AS doi, 'T' || (l_partkey % 3000) AS title, CASE WHEN l_partkey % 2 = 0 THEN 1995 + l_partkey % 7 END AS year FROM lineitem),
p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '10.1/' || (o_orderkey % 1000) END AS doi, 'T' || (o_orderkey % 2000) AS title, CASE WHEN o_orderkey % 2 = 0 THEN 1995 + o_orderkey % 7 END AS year FROM orders)"""


@query(
    "citation_resolution",
    f"""WITH {_REFS} SELECT ref_id, coalesce(a.id, d.id, t.id)::VARCHAR AS hit, CASE WHEN a.id IS NOT NULL OR d.id IS NOT NULL THEN 1.0 WHEN t.id IS NOT NULL THEN 0.8 ELSE 0.6 END AS confidence
FROM r LEFT JOIN p a ON a.id = r.doc_id LEFT JOIN (SELECT doi, min(id) AS id FROM p WHERE doi IS NOT NULL GROUP BY 1) d ON d.doi = r.doi
LEFT JOIN (SELECT title, coalesce(year, 0) AS year, min(id) AS id FROM p GROUP BY ALL) t ON t.title = r.title AND t.year = coalesce(r.year, 0)""",
)
def citation_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    year = F.when(F.col("l_partkey") % 2 == 0, 1995 + F.col("l_partkey") % 7)
    refs = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"), F.when(F.col("l_linenumber") % 4 == 0, F.col("l_partkey")).alias("doc_id"), F.when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("10.1/"), "l_suppkey")).alias("doi"), F.concat(F.lit("T"), F.col("l_partkey") % 3000).alias("title"), year.alias("year"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    known = o.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("10.1/"), F.col("id") % 1000)).alias("doi"), F.concat(F.lit("T"), F.col("id") % 2000).alias("title"), F.when(F.col("id") % 2 == 0, 1995 + F.col("id") % 7).alias("year"))
    found = G.resolve(refs, known)
    return found.select("ref_id", F.when(~F.col("target").startswith("stub:"), F.col("target")).alias("hit"), "confidence")


@query(
    "cycle_filtered_hierarchy",
    with_sql("based_on") + """, n AS (SELECT dst AS src, src AS dst FROM based_on WHERE src % 10 = 0 UNION ALL SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 10 = 3),
w AS (SELECT src AS start, dst AS node, 1 AS hop FROM based_on UNION SELECT start, b.dst, hop + 1 FROM w JOIN based_on b ON b.src = w.node WHERE hop < 3)
SELECT DISTINCT src, dst FROM n WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM w WHERE start = n.dst AND node = n.src)""",
)
def cycle_filtered_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = based_on(spark, sf_dir)
    reverse = tree.where("src % 10 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    extra = table(spark, sf_dir, "part").where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 1).alias("dst"))
    return G.reject_cycles(tree, reverse.unionByName(extra)).distinct()


@query(
    "hierarchy_reach",
    with_sql("based_on") + """, up AS (SELECT src AS start, dst AS node, 1 AS hop FROM based_on UNION SELECT start, b.dst, hop + 1 FROM up JOIN based_on b ON b.src = up.node WHERE hop < 3),
down AS (SELECT dst AS start, src AS node, 1 AS hop FROM based_on WHERE dst > 0 UNION SELECT start, b.src, hop + 1 FROM down JOIN based_on b ON b.dst = down.node WHERE hop < 3)
SELECT start, node, round(sum(1.0 / (hop + 1)), 6) AS score FROM (SELECT * FROM up UNION ALL SELECT * FROM down) GROUP BY ALL""",
)
def hierarchy_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("start"))
    return G.hierarchy_scores(based_on(spark, sf_dir), starts).select("start", "node", F.round("score", 6).alias("score"))


@query("consistency_duplicate", "SELECT l_orderkey AS paper, l_partkey AS target, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def consistency_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("target")).agg(F.count("*").alias("n")).where("n > 1")


@query("consistency_inverse", "WITH e AS (SELECT DISTINCT o_orderkey % 50 AS src, o_custkey % 50 AS dst FROM orders) SELECT a.src, a.dst FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst ORDER BY 1, 2 LIMIT 50")
def consistency_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("src"), (F.col("o_custkey") % 50).alias("dst")).distinct()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").where("src < dst").orderBy("src", "dst").limit(50)


@query("consistency_no_evidence", with_sql("uses") + "SELECT paper, target FROM uses WHERE confidence > 0.75 AND target % 9 = 0")
def consistency_no_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = uses(spark, sf_dir).withColumn("evidence", F.when(F.col("target") % 9 == 0, F.lit(" ")).otherwise(F.lit("text")))
    return e.where((F.col("confidence") > 0.75) & (F.trim("evidence") == "")).select("paper", "target")


@query("consistency_low_conf", with_sql("uses") + "SELECT paper, target, round(confidence - 0.45, 6) AS confidence FROM uses WHERE confidence - 0.45 < 0.5")
def consistency_low_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uses(spark, sf_dir).withColumn("confidence", F.col("confidence") - 0.45).where("confidence < 0.5").select("paper", "target", F.round("confidence", 6).alias("confidence"))


@query("consistency_orphans", "SELECT p_partkey AS id, 'Concept' AS label FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 30 = 0) UNION ALL SELECT s_suppkey, 'Evidence' FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey % 300 = 0)")
def consistency_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).join(line.where("l_orderkey % 30 = 0").select(F.col("l_partkey").alias("id")), "id", "left_anti").withColumn("label", F.lit("Concept"))
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")).join(line.where("l_orderkey % 300 = 0").select(F.col("l_suppkey").alias("id")), "id", "left_anti").withColumn("label", F.lit("Evidence"))
    return c.unionByName(e)


@query("papers_without_concepts", with_sql("papers", "uses") + "SELECT id FROM papers WHERE status = 'kg_built' AND id NOT IN (SELECT paper FROM uses)")
def papers_without_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).where("status = 'kg_built'").select("id").join(uses(spark, sf_dir).select(F.col("paper").alias("id")), "id", "left_anti")


@query("entity_resolution", "SELECT id, min(id) OVER (PARTITION BY k) AS canonical FROM (SELECT p_partkey AS id, lower(regexp_replace(p_name, '[-_\\s]', '', 'g')) AS k FROM part)")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names are written in three ways that mean the same; each name's variants are also its aliases."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 1, F.replace("p_name", F.lit(" "), F.lit("-"))).otherwise(F.col("p_name"))
    return G.resolve_entities(p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.array(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("aliases")))


@query(
    "graph_health",
    with_sql("papers", "cites") + """, d AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM cites UNION ALL SELECT dst FROM cites) GROUP BY 1), n AS (SELECT count(*) AS nodes, sum(coalesce(d, 0)) AS ends, avg((coalesce(d, 0) = 0)::INT) AS i, avg(coalesce(d, 0)) AS a FROM papers LEFT JOIN d USING (id))
SELECT nodes::BIGINT AS nodes, (ends // 2)::BIGINT AS edges, round(i, 6) AS isolated_share, round(a, 6) AS avg_degree, i < 0.3 AND a > 1 AS healthy FROM n""",
)
def graph_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degree_health(papers(spark, sf_dir), cites(spark, sf_dir))


@query("neighbourhood", with_sql("uses", "cites") + "SELECT src, dst, kind FROM (SELECT src, dst, 'CITES' AS kind FROM cites UNION ALL SELECT paper, target, 'USES_CONCEPT' FROM uses) WHERE (kind = 'CITES' AND (src = 500 OR dst = 500)) OR (kind <> 'CITES' AND src = 500) ORDER BY kind, src, dst LIMIT 200")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node ids are typed: a concept's number is no paper's."""
    typed = cites(spark, sf_dir).select(F.concat(F.lit("p"), "src").alias("src"), F.concat(F.lit("p"), "dst").alias("dst"), F.lit("CITES").alias("kind")).unionByName(uses(spark, sf_dir).select(F.concat(F.lit("p"), "paper").alias("src"), F.concat(F.lit("c"), "target").alias("dst"), F.lit("USES_CONCEPT").alias("kind")))
    near = G.neighbourhood(typed, F.lit("p500"))
    return near.select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("long").alias("dst"), "kind")


_SEEDS = "id % 100 = 0"
_W = {"shared_concept": 0.35, "shared_evidence": 0.20, "citation": 0.15, "hierarchy": 0.15, "author": 0.15}
_CW = "CASE WHEN category IN ('method', 'model') THEN 1.2 WHEN category IN ('task', 'framework') THEN 1.0 ELSE 0.8 END"

SQL["sig_concept"] = f"SELECT a.paper AS src, b.paper AS other, sum((a.confidence + b.confidence) / 2 * {_CW}) AS raw FROM uses a JOIN uses b USING (target) JOIN concepts c ON c.id = target JOIN papers p ON p.id = b.paper AND p.status = 'kg_built' WHERE a.paper % 100 = 0 AND a.paper <> b.paper GROUP BY ALL"
KIND = {0: "benchmark", 1: "dataset", 2: "corpus", 3: "survey", 4: "census", 5: "other"}
_KINDS = "CASE target % 6 WHEN 0 THEN 1.3 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.8 WHEN 4 THEN 0.8 ELSE 0.7 END"
SQL["sig_evidence"] = f"SELECT a.paper AS src, b.paper AS other, sum((a.confidence + b.confidence) / 2 * {_KINDS}) AS raw FROM evaluates a JOIN evaluates b USING (target) JOIN papers p ON p.id = b.paper AND p.status = 'kg_built' WHERE a.paper % 100 = 0 AND a.paper <> b.paper GROUP BY ALL"
SQL["sig_citation"] = """SELECT src, other, sum(w) AS raw FROM (SELECT src, dst AS other, 1.0 AS w FROM cites WHERE src % 100 = 0 UNION ALL SELECT dst, src, 0.9 FROM cites WHERE dst % 100 = 0
UNION ALL SELECT a.src, b.src, 0.7 FROM cites a JOIN cites b USING (dst) JOIN papers p ON p.id = b.src AND p.status = 'kg_built' WHERE a.src % 100 = 0 AND a.src <> b.src
UNION ALL SELECT a.dst, b.dst, 0.6 FROM cites a JOIN cites b USING (src) JOIN papers p ON p.id = b.dst AND p.status = 'kg_built' WHERE a.dst % 100 = 0 AND a.dst <> b.dst) WHERE other IN (SELECT id FROM papers) GROUP BY ALL"""
SQL["same_author"] = "SELECT a.id AS src, b.id AS other, 1.0 AS raw FROM papers a JOIN papers b USING (author) WHERE a.id % 100 = 0 AND a.id <> b.id AND b.status = 'kg_built'"
SQL["sig_author"] = "SELECT src, other, sum(raw) AS raw FROM (SELECT * FROM same_author UNION ALL SELECT a.id, b.id, 0.6 FROM papers a JOIN papers b ON a.author // 10 = b.author // 10 AND a.author <> b.author WHERE a.id % 100 = 0 AND b.status = 'kg_built') GROUP BY ALL"
SQL["lineage"] = "SELECT src AS child, dst AS parent, 1 AS hop FROM based_on UNION SELECT a.src, b.dst, 2 FROM based_on a JOIN based_on b ON b.src = a.dst"
SQL["sig_hierarchy"] = """SELECT src, other, sum(1.0 / (hop + 1)) AS raw FROM (SELECT DISTINCT a.paper AS src, b.paper AS other, hop, 'up' AS way FROM uses a JOIN lineage ON child = a.target JOIN uses b ON b.target = parent WHERE a.paper % 100 = 0 AND a.paper <> b.paper
UNION ALL SELECT DISTINCT a.paper, b.paper, hop, 'down' FROM uses a JOIN lineage ON parent = a.target JOIN uses b ON b.target = child WHERE a.paper % 100 = 0 AND a.paper <> b.paper) JOIN papers p ON p.id = other AND p.status = 'kg_built' GROUP BY ALL"""


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).where("status = 'kg_built'").select(F.col("id").alias("other"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).where(_SEEDS).select(F.col("id").alias("src"))


def sig_concept(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    w = F.when(F.col("category").isin("method", "model"), 1.2).when(F.col("category").isin("task", "framework"), 1.0).otherwise(0.8)
    c = concepts(spark, sf_dir).select(F.col("id").alias("target"), w.alias("w"))
    return G.co_occurrence(uses(spark, sf_dir).join(c, "target"), seeds(spark, sf_dir), (F.col("confidence") + F.col("a_confidence")) / 2 * F.col("a_w"), others=built(spark, sf_dir), shared=["w"], parts=parts)


def sig_evidence(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    kinds = F.create_map(*[x for n, kind in KIND.items() for x in (F.lit(n), F.lit(kind))])
    weighed = evaluates(spark, sf_dir).withColumn("w", G.evidence_weight(kinds[(F.col("target") % 6).cast("int")]))
    return G.co_occurrence(weighed, seeds(spark, sf_dir), (F.col("confidence") + F.col("a_confidence")) / 2 * F.col("a_w"), others=built(spark, sf_dir), shared=["w"], parts=parts)


def sig_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, b = cites(spark, sf_dir), seeds(spark, sf_dir), built(spark, sf_dir)
    mine_out, mine_in = c.join(s, "src", "left_semi"), c.join(s.select(F.col("src").alias("dst")), "dst", "left_semi")
    direct = mine_out.select("src", F.col("dst").alias("other"), F.lit(1.0).alias("w")).unionByName(mine_in.select(F.col("dst").alias("src"), F.col("src").alias("other"), F.lit(0.9).alias("w")))
    coupled = mine_out.join(c.select(F.col("src").alias("other"), "dst"), "dst").where("src <> other").select("src", "other", F.lit(0.7).alias("w"))
    co_cited = mine_in.select("src", F.col("dst").alias("me")).join(c.select("src", F.col("dst").alias("other")), "src").where("me <> other").select(F.col("me").alias("src"), "other", F.lit(0.6).alias("w"))
    shared = coupled.unionByName(co_cited).join(b, "other", "left_semi").select("src", "other", "w")
    known = papers(spark, sf_dir).select(F.col("id").alias("other"))
    return direct.join(known, "other", "left_semi").select("src", "other", "w").unionByName(shared).groupBy("src", "other").agg(F.sum("w").alias("raw"))


def same_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    mine = p.where(_SEEDS).select(F.col("id").alias("src"), "author")
    others = p.where("status = 'kg_built'").select(F.col("id").alias("other"), "author")
    return mine.join(others, "author").where("src <> other").select("src", "other", F.lit(1.0).alias("raw"))


def sig_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.0 for a shared author, 0.6 for another author of the same institution (ten authors each here)."""
    p = papers(spark, sf_dir).withColumn("place", F.expr("author div 10"))
    mine = p.where(_SEEDS).select(F.col("id").alias("src"), F.col("author").alias("me"), "place")
    near = p.where("status = 'kg_built'").select(F.col("id").alias("other"), "author", "place")
    colleagues = mine.join(near, "place").where("author <> me").select("src", "other", F.lit(0.6).alias("raw"))
    return same_author(spark, sf_dir).unionByName(colleagues).groupBy("src", "other").agg(F.sum("raw").alias("raw"))


def sig_hierarchy(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Papers on concepts up to two steps above or below a paper's own, each hop once a direction."""
    return G.hierarchy_signal(uses(spark, sf_dir).select("paper", "target"), based_on(spark, sf_dir), seeds(spark, sf_dir), 2, others=built(spark, sf_dir), parts=parts)


def _signal(name: str, fn, needs: tuple[str, ...], key: str) -> None:
    @query(name, with_sql(*needs, key) + f"SELECT src, other, round(raw, 5) AS raw FROM {key}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(spark, sf_dir).select("src", "other", F.round("raw", 5).alias("raw"))


_signal("sig_shared_concept", sig_concept, ("papers", "concepts", "uses"), "sig_concept")
_signal("sig_shared_evidence", sig_evidence, ("papers", "evaluates"), "sig_evidence")
_signal("sig_citation", sig_citation, ("papers", "cites"), "sig_citation")
_signal("sig_author", sig_author, ("papers", "same_author"), "sig_author")
_signal("sig_hierarchy", sig_hierarchy, ("papers", "uses", "based_on", "lineage"), "sig_hierarchy")

_ALL = ("papers", "concepts", "uses", "evaluates", "cites", "based_on", "lineage", "same_author", "sig_concept", "sig_evidence", "sig_citation", "sig_author", "sig_hierarchy")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal dealt by the source into equal partitions, so that their union is dealt so, too."""
    parts, out = G.source_parts(seeds(spark, sf_dir)), None
    for name, fn in (("shared_concept", sig_concept), ("shared_evidence", sig_evidence), ("citation", sig_citation), ("hierarchy", sig_hierarchy), ("author", sig_author)):
        dealt = fn(spark, sf_dir, parts) if fn in (sig_concept, sig_evidence, sig_hierarchy) else fn(spark, sf_dir).repartition(parts, "src")
        s = dealt.select("src", "other", F.lit(name).alias("signal"), "raw")
        out = s if out is None else out.unionByName(s)
    return out


_TOP = with_sql(*_ALL) + """, n AS (SELECT src, other, 0.35 * raw / max(raw) OVER (PARTITION BY src) AS v FROM sig_concept UNION ALL SELECT src, other, 0.20 * raw / max(raw) OVER (PARTITION BY src) FROM sig_evidence
UNION ALL SELECT src, other, 0.15 * raw / max(raw) OVER (PARTITION BY src) FROM sig_citation UNION ALL SELECT src, other, 0.15 * raw / max(raw) OVER (PARTITION BY src) FROM sig_author UNION ALL SELECT src, other, 0.15 * raw / max(raw) OVER (PARTITION BY src) FROM sig_hierarchy),
t AS (SELECT src, other, round(sum(v), 6) AS score FROM n GROUP BY ALL), r AS (SELECT src, other, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, other)::BIGINT AS rank FROM t WHERE score >= 0.05) """


@query("recommend_topk", _TOP + "SELECT src, rank, round(score, 4) AS score FROM r WHERE rank <= 10")
def recommend_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.recommend(_signals(spark, sf_dir), _W, 10)
    return found.select("src", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query("recommend_by_author", with_sql("papers", "same_author") + "SELECT src, other, rank FROM (SELECT src, other, row_number() OVER (PARTITION BY src ORDER BY year DESC, other)::BIGINT AS rank FROM same_author JOIN papers ON id = other) WHERE rank <= 5")
def recommend_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = same_author(spark, sf_dir).join(papers(spark, sf_dir).select(F.col("id").alias("other"), "year"), "other")
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("year"), "other")).cast("long")).where("rank <= 5").select("src", "other", "rank")


@query("recommend_popular", with_sql("papers", "cites") + "SELECT id, greatest(count(src), 1)::BIGINT AS cited FROM papers LEFT JOIN cites ON dst = id GROUP BY id, year ORDER BY cited DESC, year DESC, id LIMIT 20")
def recommend_popular(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cites(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("c"))
    p = papers(spark, sf_dir).join(counts, "id", "left").select("id", "year", F.greatest(F.coalesce("c", F.lit(0)), F.lit(1)).alias("cited"))
    return p.orderBy(F.desc("cited"), F.desc("year"), "id").limit(20).select("id", "cited")


@query("recommend_entity", with_sql("papers", "uses", "concepts") + "SELECT u.paper AS id, count(*)::BIGINT AS hits FROM uses u JOIN concepts c ON c.id = target JOIN papers p ON p.id = u.paper WHERE category = 'method' AND name LIKE '%a%' GROUP BY 1")
def recommend_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = concepts(spark, sf_dir).where("category = 'method' AND name LIKE '%a%'").select(F.col("id").alias("target"))
    u = uses(spark, sf_dir).join(c, "target", "left_semi").select(F.col("paper").alias("id"))
    return u.join(papers(spark, sf_dir).select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("hits"))


_TIERS = """methods AS (SELECT paper, target FROM uses JOIN concepts c ON c.id = target WHERE category = 'method'), entity AS (SELECT s.src, s.other, count(*)::DOUBLE AS score FROM same_author s JOIN methods a ON a.paper = s.src JOIN methods b ON b.paper = s.other AND b.target = a.target GROUP BY ALL),
t AS (SELECT src, other, 1 AS tier, score FROM entity UNION ALL SELECT src, other, 2, raw FROM same_author UNION ALL SELECT src, other, 3, raw FROM sig_citation)"""


@query(
    "recommend_tiered",
    with_sql("papers", "uses", "concepts", "cites", "same_author", "sig_citation") + f", {_TIERS} SELECT src, other, tier, round(max(score), 6) AS score FROM t WHERE tier = (SELECT min(tier) FROM t u WHERE u.src = t.src) GROUP BY ALL",
)
def recommend_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tier that has anything for a source: shared author and method, shared author, citations; one row per paper with its best score."""
    same = same_author(spark, sf_dir)
    method = concepts(spark, sf_dir).where("category = 'method'").select(F.col("id").alias("target"))
    used = uses(spark, sf_dir).select("paper", "target").join(method, "target", "left_semi")
    entity = same.join(used.select(F.col("paper").alias("src"), "target"), "src").join(used.select(F.col("paper").alias("other"), "target"), ["other", "target"]).groupBy("src", "other").agg(F.count("*").cast("double").alias("score"))
    tiers = [entity, same.select("src", "other", F.col("raw").alias("score")), sig_citation(spark, sf_dir).select("src", "other", F.col("raw").alias("score"))]
    t = None
    for n, rows in enumerate(tiers, 1):
        rows = rows.select("src", "other", F.lit(n).alias("tier"), "score")
        t = rows if t is None else t.unionByName(rows)
    first = t.groupBy("src").agg(F.min("tier").alias("tier"))
    return t.join(first, ["src", "tier"]).groupBy("src", "other", "tier").agg(F.round(F.max("score"), 6).alias("score"))


@query(
    "recommend_metadata_overlap",
    """WITH k AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part), n AS (SELECT id, count(*) AS n FROM k GROUP BY 1),
u AS (SELECT DISTINCT p_partkey AS id, unnest([p_brand, 'size' || p_size]) AS w FROM part), s AS (SELECT a.id AS src, b.id AS other, 0.65 / na.n AS v FROM k a JOIN k b USING (w) JOIN n na ON na.id = a.id WHERE a.id % 100 = 0
UNION ALL SELECT a.id, b.id, 0.35 / 2 FROM u a JOIN u b USING (w) WHERE a.id % 100 = 0) SELECT src, other, round(sum(v), 6) AS score FROM s WHERE src <> other GROUP BY ALL""",
)
def recommend_metadata_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.65 times the shared part of the keywords and 0.35 times that of the authors, through equi-joins, never all pairs."""
    part = table(spark, sf_dir, "part")
    words = part.select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " "))).alias("w"))
    authors = part.select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(F.array("p_brand", F.concat(F.lit("size"), "p_size")))).alias("w"))

    def overlap(sets: DataFrame, weight: float) -> DataFrame:
        mine = sets.where("id % 100 = 0")
        size = mine.groupBy(F.col("id").alias("src")).agg(F.count("*").alias("n"))
        shared = mine.select(F.col("id").alias("src"), "w").join(sets.select(F.col("id").alias("other"), "w"), "w").where("src <> other").groupBy("src", "other").agg(F.count("*").alias("c"))
        return shared.join(size, "src").select("src", "other", (weight * F.col("c") / F.col("n")).alias("v"))

    both = overlap(words, 0.65).unionByName(overlap(authors, 0.35))
    return both.groupBy("src", "other").agg(F.round(F.sum("v"), 6).alias("score"))


@query("recommend_enriched", with_sql("papers", "uses", "same_author") + "SELECT s.src, s.other, coalesce(string_agg(b.target::VARCHAR, ',' ORDER BY b.target), '') AS shared FROM same_author s LEFT JOIN (SELECT a.paper AS src, b.paper AS other, b.target FROM uses a JOIN uses b USING (target)  WHERE a.paper % 100 = 0) b ON b.src = s.src AND b.other = s.other GROUP BY ALL")
def recommend_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = same_author(spark, sf_dir).select("src", "other")
    u = uses(spark, sf_dir)
    shared = s.join(u.select(F.col("paper").alias("src"), "target"), "src").join(u.select(F.col("paper").alias("other"), "target"), ["other", "target"])
    lists = shared.groupBy("src", "other").agg(F.array_join(F.transform(F.array_sort(F.collect_list("target")), lambda x: x.cast("string")), ",").alias("shared"))
    return s.join(lists, ["src", "other"], "left").select("src", "other", F.coalesce("shared", F.lit("")).alias("shared"))


_BOOSTS = "CASE target % 5 WHEN 0 THEN 0.15 WHEN 1 THEN 0.10 WHEN 2 THEN 0.05 WHEN 3 THEN 0.02 ELSE 0.0 END"


@query(
    "graph_context_chunks",
    with_sql("uses", "evaluates", "concepts") + f""", n AS (SELECT 'Concept' AS kind, target, max(confidence) AS c FROM uses GROUP BY ALL UNION ALL SELECT 'Evidence', target, max(confidence) FROM evaluates GROUP BY ALL),
t AS (SELECT kind, target, c, CASE WHEN kind = 'Concept' THEN (SELECT any_value(name) FROM concepts WHERE id = target) ELSE (SELECT any_value(s_name) FROM supplier WHERE s_suppkey = target) END AS name FROM n)
SELECT kind, target, 'kind=' || kind || ' name=' || name AS text, round(least(1.0, 0.5 * c + least(0.2, 0.05 * ((contains(lower(name), 'al'))::INT + (contains(lower(name), 're'))::INT + (contains(lower(name), '1'))::INT)) + {_BOOSTS}), 6) AS score
FROM t WHERE least(1.0, 0.5 * c + least(0.2, 0.05 * ((contains(lower(name), 'al'))::INT + (contains(lower(name), 're'))::INT + (contains(lower(name), '1'))::INT)) + {_BOOSTS}) >= 0.3 ORDER BY score DESC, kind, target LIMIT 50""",
)
def graph_context_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every concept and evidence with its best confidence, boosted by keywords in the name and by its section; top 50 as text."""
    sections = F.create_map(*[F.lit(x) for pair in {0: "Method", 1: "experiments", 2: "abstract", 3: "Introduction", 4: "appendix"}.items() for x in pair])
    rows = None
    for kind, edges, names in (("Concept", uses(spark, sf_dir), concepts(spark, sf_dir).select(F.col("id").alias("target"), "name")), ("Evidence", evaluates(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), F.col("s_name").alias("name")))):
        best = edges.groupBy("target").agg(F.max("confidence").alias("c")).join(names, "target").withColumn("kind", F.lit(kind))
        rows = best if rows is None else rows.unionByName(best)
    words = F.array(F.lit("al"), F.lit("re"), F.lit("1"))
    score = G.chunk_score(0.5 * F.col("c"), F.col("name"), words, sections[(F.col("target") % 5).cast("int")])
    text = F.concat(F.lit("kind="), "kind", F.lit(" name="), "name")
    out = rows.select("kind", "target", text.alias("text"), F.round(score, 6).alias("score")).where("score >= 0.3")
    return out.orderBy(F.desc("score"), "kind", "target").limit(50)


@query("skip_built_and_claim", with_sql("papers") + "SELECT id, 'processing' AS status FROM papers WHERE status <> 'kg_built'")
def skip_built_and_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers(spark, sf_dir)
    return p.join(p.where("status = 'kg_built'").select("id"), "id", "left_anti").select("id", F.lit("processing").alias("status"))


@query("chunk_insert_if_absent", "SELECT l_orderkey AS doc_id, l_linenumber AS chunk, min(l_linenumber % 2 = 1) AS fresh FROM lineitem GROUP BY ALL")
def chunk_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk")).distinct()
    old = c.where("chunk % 2 = 0").withColumn("fresh", F.lit(False))
    return G.insert_absent(old, c.withColumn("fresh", F.lit(True)), ["doc_id", "chunk"])
