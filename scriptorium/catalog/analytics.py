"""Queries over documents, orders and events as an application's relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import relational as R
from scriptorium.registry import query

from .base import table, values_sql


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as an owner's files: user, workspace, soft deletion, status and file type follow from the id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", (F.col("doc_id") % 10).alias("user_id"), F.col("source").alias("workspace"), (F.col("doc_id") % 13 == 0).alias("is_deleted"),
        F.element_at(F.array(*map(F.lit, ("parsed", "indexed", "failed"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("status"),
        F.when(F.col("doc_id") % 11 == 0, None).otherwise(F.upper("lang")).alias("file_type"), "n_chars",
    )


DOCS = """(SELECT doc_id, doc_id % 10 AS user_id, source AS workspace, doc_id % 13 = 0 AS is_deleted,
['parsed', 'indexed', 'failed'][doc_id % 3 + 1] AS status, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE upper(lang) END AS file_type, n_chars FROM documents)"""


@query("status_counts", f"SELECT status, count(*)::BIGINT AS n FROM {DOCS} WHERE NOT is_deleted GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.value_counts(R.visible(_docs(spark, sf_dir), None), F.col("status"), "status")


@query(
    "kpi_overview",
    f"""SELECT count(*)::BIGINT AS docs, count(*) FILTER (status = 'indexed')::BIGINT AS indexed, count(*) FILTER (status = 'failed')::BIGINT AS failed,
count(*) FILTER (is_deleted)::BIGINT AS deleted, count(DISTINCT user_id)::BIGINT AS users, count(DISTINCT workspace)::BIGINT AS workspaces, sum(n_chars)::BIGINT AS chars FROM {DOCS}""",
)
def kpi_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).agg(
        F.count("*").alias("docs"), F.count_if(F.col("status") == "indexed").alias("indexed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if("is_deleted").alias("deleted"), F.count_distinct("user_id").alias("users"), F.count_distinct("workspace").alias("workspaces"), F.sum("n_chars").alias("chars"),
    )


@query("docs_by_type", f"SELECT lower(coalesce(file_type, 'unknown')) AS file_type, count(*)::BIGINT AS n FROM {DOCS} GROUP BY 1")
def docs_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.value_counts(_docs(spark, sf_dir), F.lower(F.coalesce("file_type", F.lit("unknown"))), "file_type")


_KPI = """SELECT count(*)::DOUBLE AS docs, count(*) FILTER (status = 'failed')::DOUBLE AS failed,
(SELECT count(*) FROM events)::DOUBLE AS jobs, (SELECT count(*) FROM events WHERE event_type = 'error')::DOUBLE AS failed_jobs FROM """ + DOCS


def _kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of counts; both sides are single rows, so the join is of one row with one row."""
    d = _docs(spark, sf_dir).agg(F.count("*").cast("double").alias("docs"), F.count_if(F.col("status") == "failed").cast("double").alias("failed"), F.lit(1).alias("one"))
    e = table(spark, sf_dir, "events").agg(F.count("*").cast("double").alias("jobs"), F.count_if(F.col("event_type") == "error").cast("double").alias("failed_jobs"), F.lit(1).alias("one"))
    return d.join(e, "one").drop("one")


@query("health_scores", f"SELECT round(greatest(0, 100 - (0.6 * 100 * failed / docs + 0.4 * 100 * failed_jobs / jobs)))::BIGINT AS health, round(100 * (docs - failed) / docs)::BIGINT AS readiness FROM ({_KPI})")
def health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = 0.6 * 100 * F.col("failed") / F.col("docs") + 0.4 * 100 * F.col("failed_jobs") / F.col("jobs")
    return _kpis(spark, sf_dir).select(F.round(F.greatest(F.lit(0), 100 - lost)).cast("long").alias("health"), F.round(100 * (F.col("docs") - F.col("failed")) / F.col("docs")).cast("long").alias("readiness"))


@query(
    "risk_levels",
    f"""WITH k AS ({_KPI}), r AS (SELECT 'documents' AS area, 100 * failed / docs AS v, 15 AS high, 7 AS medium FROM k UNION ALL SELECT 'jobs', 100 * failed_jobs / jobs, 12, 5 FROM k)
SELECT area, round(v, 4) AS share, CASE WHEN v >= high THEN 'high' WHEN v >= medium THEN 'medium' ELSE 'low' END AS risk FROM r""",
)
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = F.array(
        F.struct(F.lit("documents").alias("area"), (100 * F.col("failed") / F.col("docs")).alias("v"), F.lit(15).alias("high"), F.lit(7).alias("medium")),
        F.struct(F.lit("jobs").alias("area"), (100 * F.col("failed_jobs") / F.col("jobs")).alias("v"), F.lit(12).alias("high"), F.lit(5).alias("medium")),
    )
    r = _kpis(spark, sf_dir).select(F.inline(areas))
    return r.select("area", F.round("v", 4).alias("share"), F.when(F.col("v") >= F.col("high"), "high").when(F.col("v") >= F.col("medium"), "medium").otherwise("low").alias("risk"))


@query(
    "executive_insights",
    """WITH y AS (SELECT arg_max(y, (n, -y)) AS v FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1)),
t AS (SELECT arg_max(p_type, (n, p_type)) AS v FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1)) SELECT 'year' AS what, v::VARCHAR AS top FROM y UNION ALL SELECT 'topic', v FROM t""",
)
def executive_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("v")).count().agg(F.max_by("v", F.struct("count", -F.col("v"))).alias("top"))
    topics = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("v")).count().agg(F.max_by("v", F.struct("count", "v")).alias("top"))
    return years.select(F.lit("year").alias("what"), F.col("top").cast("string").alias("top")).unionByName(topics.select(F.lit("topic").alias("what"), "top"))


@query("group_by_year", "SELECT year(o_orderdate)::BIGINT AS year, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, year LIMIT 10")
def group_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.value_counts(table(spark, sf_dir, "orders"), F.year("o_orderdate").cast("long"), "year").orderBy(F.desc("n"), "year").limit(10)


@query("group_by_author", "SELECT c_name AS author, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY n DESC, author LIMIT 10")
def group_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))  # counted before names are joined
    named = papers.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("author")), "o_custkey")
    return named.groupBy("author").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "author").limit(10)


@query("group_by_topic", "SELECT t AS topic, count(*)::BIGINT AS n FROM (SELECT unnest([p_type, p_brand]) AS t FROM part) GROUP BY 1 ORDER BY n DESC, topic LIMIT 10")
def group_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = table(spark, sf_dir, "part").select(F.explode(F.array("p_type", "p_brand")).alias("topic"))
    return topics.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(10)


@query("user_dashboard_join", "SELECT o_custkey AS user_id, count(*)::BIGINT AS summaries FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def user_dashboard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return lines.join(mine, "o_orderkey").groupBy("user_id").agg(F.count("*").alias("summaries"))


@query(
    "admin_docs_with_counts",
    """WITH p AS (SELECT o_orderkey, o_orderstatus, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%1%' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20)
SELECT o_orderkey AS doc_id, o_orderstatus AS status, c_name AS owner, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::BIGINT AS chunks FROM p""",
)
def admin_docs_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "customer").where(F.col("c_name").ilike("%1%")).select("c_custkey", "c_name")
    rows = table(spark, sf_dir, "orders").join(owners, F.col("o_custkey") == F.col("c_custkey"))
    found = R.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 1, 20).select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.col("c_name").alias("owner"))
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id")).join(found.select("doc_id"), "doc_id", "left_semi")
    return R.with_counts(found, chunks, "doc_id", "chunks")


@query("admin_user_search", "SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE (c_name ILIKE '%99%' OR c_mktsegment ILIKE '%auto%') AND c_nationkey = 3")
def admin_user_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where(F.col("c_name").ilike("%99%") | F.col("c_mktsegment").ilike("%auto%")).where("c_nationkey = 3")
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))


@query("list_page", f"SELECT doc_id, status FROM {DOCS} WHERE NOT is_deleted AND user_id = 3 ORDER BY n_chars DESC, doc_id LIMIT 10 OFFSET 10")
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(R.visible(_docs(spark, sf_dir), 3), [F.desc("n_chars"), "doc_id"], 2, 10).select("doc_id", "status")


@query("list_two_key", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def list_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(table(spark, sf_dir, "orders"), ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"], 3, 20).select("o_orderkey", "o_orderpriority")


@query("visible_docs", f"SELECT doc_id, workspace, n_chars FROM {DOCS} WHERE NOT is_deleted AND user_id = 4 AND workspace = 'src4'")
def visible_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.visible(_docs(spark, sf_dir), 4).where("workspace = 'src4'").select("doc_id", "workspace", "n_chars")


@query("doc_struct", f"SELECT doc_id, status || '/' || coalesce(file_type, '?') || '/' || n_chars AS packed FROM {DOCS}")
def doc_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = _docs(spark, sf_dir).select("doc_id", F.struct("status", "file_type", F.struct("n_chars").alias("size")).alias("meta"))
    return nested.select("doc_id", F.concat_ws("/", "meta.status", F.coalesce("meta.file_type", F.lit("?")), "meta.size.n_chars").alias("packed"))


@query("library_filter", f"SELECT doc_id FROM {DOCS} WHERE contains(lower(concat_ws(' ', workspace, file_type, status)), 'src1') AND status = 'indexed'")
def library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(F.lower(F.concat_ws(" ", "workspace", "file_type", "status")).contains("src1")).where("status = 'indexed'").select("doc_id")


@query(
    "timeline_union",
    """SELECT kind, id, ts FROM (SELECT 'upload' AS kind, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ts FROM orders WHERE o_custkey = 7
UNION ALL SELECT event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events WHERE user_id = 7)""",
)
def timeline_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = "yyyy-MM-dd HH:mm:ss"
    o = table(spark, sf_dir, "orders").where("o_custkey = 7").select(F.lit("upload").alias("kind"), F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", stamp).alias("ts"))
    e = table(spark, sf_dir, "events").where("user_id = 7").select(F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.date_format("ts", stamp).alias("ts"))
    return o.unionByName(e).orderBy("ts", "id")


@query("latest_per_key", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("latest_unused_code", "SELECT user_id, event_id FROM events WHERE event_type = 'signup' AND value < 50 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_unused_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    unused = table(spark, sf_dir, "events").where("event_type = 'signup' AND value < 50")
    return unused.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(
    "session_memory_last_n",
    """WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, md5(right(string_agg(role || ': ' || text, chr(10) ORDER BY turn), 500)) AS digest, count(*)::BIGINT AS turns FROM r WHERE k <= 3 GROUP BY conv_id""",
)
def session_memory_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = R.last_n(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 3)
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    joined = kept.groupBy("conv_id").agg(turns.alias("t"))
    text = F.array_join(F.transform("t", lambda x: x.line), "\n")
    return joined.select("conv_id", F.md5(F.right(text, F.lit(500))).alias("digest"), F.size("t").cast("long").alias("turns"))


@query("flatten_props", "SELECT event_id, (props->>'$.k')::BIGINT AS props_k, user_id FROM events")
def flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "k long").alias("props"))
    return nested.select("event_id", F.col("props.k").alias("props_k"), "user_id")


@query(
    "column_profile",
    " UNION ALL ".join(f"SELECT 'documents' AS table_name, '{c}' AS column_name, count(*)::BIGINT AS total, count(*) FILTER ({c} IS NULL)::BIGINT AS nulls, count(DISTINCT {c}::VARCHAR)::BIGINT AS distinct_values FROM documents" for c in ("doc_id", "text", "lang", "source", "n_chars"))
    + " UNION ALL "
    + " UNION ALL ".join(f"SELECT 'nation', '{c}', count(*), count(*) FILTER ({c} IS NULL), count(DISTINCT {c}::VARCHAR) FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")),
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [R.profile(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "*") for t in ("documents", "nation")]
    return parts[0].unionByName(parts[1])


@query("train_val_test_split")
def train_val_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70/15/15 with exact counts; a salted hash ranks the rows, so any seed gives a total order."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    bucket = labels.withColumn("h", F.xxhash64(F.lit(42), "doc_id")).withColumn("b", F.pmod("h", F.lit(256)))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = bucket.groupBy("b").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))  # 256 rows
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))
    sizes = sizes.withColumn("total", total)
    rank = F.row_number().over(Window.partitionBy("b").orderBy("h", "doc_id")) + F.col("before")
    ranked = bucket.join(F.broadcast(sizes.select("b", "before", "total")), "b").select("doc_id", (rank / F.col("total")).alias("q"))
    return ranked.select("doc_id", F.when(F.col("q") <= 0.7, "train").when(F.col("q") <= 0.85, "val").otherwise("test").alias("split"))


@query("owner_join", "SELECT e.event_id AS job_id, o.o_orderkey AS doc_id, o.o_custkey AS owner FROM events e JOIN orders o ON e.event_id = o.o_orderkey")
def owner_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job with its document's owner."""
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"))
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("owner"))
    return jobs.join(docs, F.col("job_id") == F.col("doc_id")).select("job_id", "doc_id", "owner")


@query("visible_semi", f"SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM {DOCS} WHERE NOT is_deleted AND user_id = 2)")
def visible_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(R.visible(_docs(spark, sf_dir), 2), "doc_id", "left_semi")


@query("update_join_backfill", "SELECT e.event_id, coalesce(CASE WHEN e.event_id % 2 = 0 THEN e.user_id END, c.c_custkey) AS user_id FROM events e LEFT JOIN customer c ON c.c_custkey = e.event_id % 200")
def update_join_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("user_id"), (F.col("event_id") % 200).alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("found"))
    return e.join(c, "c_custkey", "left").select("event_id", F.coalesce("user_id", "found").alias("user_id"))


@query("batch_summary", "SELECT count(*)::BIGINT AS total, count(*) FILTER (event_type = 'purchase')::BIGINT AS succeeded, count(*) FILTER (event_type = 'error')::BIGINT AS failed, round(count(*) FILTER (event_type = 'purchase') / count(*)::DOUBLE, 6) AS rate, round(avg(value), 4) AS avg_duration FROM events")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, bad = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").agg(F.count("*").alias("total"), done.alias("succeeded"), bad.alias("failed"), F.round(done / F.count("*"), 6).alias("rate"), F.round(F.avg("value"), 4).alias("avg_duration"))


@query("failures_by_step", "SELECT (props->>'$.k')::BIGINT % 8 AS failed_at, count(*)::BIGINT AS n, min(event_id)::BIGINT AS first_id FROM events WHERE event_type = 'error' GROUP BY 1")
def failures_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.pmod(F.get_json_object("props", "$.k").cast("long"), F.lit(8)).alias("failed_at"), "event_id")
    return failed.groupBy("failed_at").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("chunk_count", "SELECT l_orderkey AS doc_id, count(*)::BIGINT AS chunks FROM lineitem GROUP BY 1")
def chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("chunks"))


@query("ordered_chunks", "SELECT l_orderkey AS doc_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS chunks FROM lineitem GROUP BY 1")
def ordered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey")
    packed = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    return packed.select("doc_id", F.array_join(F.transform("c", lambda x: x.l_partkey.cast("string")), ",").alias("chunks"))


_SECTION_ROWS = [(1, 0, "Intro", "a" * 60, "introduction"), (1, 1, "Refs", "r" * 99, "references"), (1, 2, "Method", "m" * 80, "methodology"), (1, 3, "Again", "m" * 120, "methodology"), (1, 4, "Tiny", "t", "results"), (2, 0, "Res", "x" * 70, "results"), (2, 1, "Abs", "y" * 70, "abstract")]


@query(
    "prioritized_sections",
    f"""SELECT doc_id, name, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind IN ('abstract', 'methodology', 'results') DESC, ord) AS rank FROM
(SELECT * FROM {values_sql(['doc_id', 'ord', 'name', 'content', 'kind'], _SECTION_ROWS)} WHERE length(content) >= 50 AND kind <> 'references' QUALIFY row_number() OVER (PARTITION BY doc_id, substr(content, 1, 100) ORDER BY ord) = 1)) WHERE rank <= 8""",
)
def prioritized_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(_SECTION_ROWS, "doc_id int, ord int, name string, content string, kind string").where("length(content) >= 50 AND kind <> 'references'")
    first = R.latest(df.withColumn("head", F.substring("content", 1, 100)), ["doc_id", "head"], [F.asc("ord")])
    order = Window.partitionBy("doc_id").orderBy(F.col("kind").isin("abstract", "methodology", "results").desc(), "ord")
    return first.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 8").select("doc_id", "name", "rank")


@query("donut_chart_rule", f"SELECT (count(*) FILTER (n > 0) <= 2) AND (sum(n) = 0 OR max(n) / sum(n) > 0.85) AS use_donut FROM (SELECT file_type, count(*) AS n FROM {DOCS} GROUP BY 1)")
def donut_chart_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = R.value_counts(_docs(spark, sf_dir), F.col("file_type"))
    few, total = F.count_if(F.col("n") > 0) <= 2, F.sum("n")
    return n.agg((few & ((total == 0) | (F.max("n") / total > 0.85))).alias("use_donut"))


@query("soft_delete_and_bulk", f"SELECT status, count(*)::BIGINT AS n FROM (SELECT doc_id, CASE WHEN user_id = 5 THEN 'deleted' ELSE status END AS status FROM {DOCS} WHERE doc_id % 17 <> 0 UNION ALL SELECT doc_id + 10000000, 'new' FROM {DOCS} WHERE doc_id % 17 = 0) GROUP BY 1")
def soft_delete_and_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    gone = d.where("doc_id % 17 = 0").select("doc_id")
    kept = d.join(gone, "doc_id", "left_anti").select("doc_id", F.when(F.col("user_id") == 5, "deleted").otherwise(F.col("status")).alias("status"))
    added = gone.select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit("new").alias("status"))
    return kept.unionByName(added).groupBy("status").agg(F.count("*").alias("n"))
