"""Search, fusion, reranking and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import evaluate as E
from scriptorium.operators import retrieval as V
from scriptorium.plans.broadcasts import small
from scriptorium.plans.scratch import stored
from scriptorium.registry import query

from .base import table

_Q = "SELECT item_id, text FROM benchmark"


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage, whole, is a query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_BM25 = f"""q AS (SELECT item_id AS query_id, t AS term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS t FROM ({_Q})) GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM documents),
n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM d),
tf AS (SELECT doc_id, term, len(any_value(toks)) AS dl, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 5)"""


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), _queries(spark, sf_dir))


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank::BIGINT AS rank FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("context_render", f"WITH {_BM25} SELECT query_id, string_agg('[' || rank || '] file=' || doc_id || ' score=' || printf('%.4f', score), chr(10) || chr(10) ORDER BY rank) AS context FROM bm GROUP BY 1")
def context_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string("[%d] file=%d score=%.4f", "rank", "doc_id", "score")
    lines = _bm25(spark, sf_dir).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    return lines.select("query_id", F.array_join(F.transform("l", lambda x: x.line), "\n\n").alias("context"))


_COUNTS = """c AS (SELECT b.item_id AS query_id, doc_id, ((length(lower(d.text)) - length(replace(lower(d.text), lower(b.text), ''))) // length(b.text))::BIGINT AS hits
FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))),
ct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, doc_id) AS rank FROM c) WHERE rank <= 5)"""


def _count_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents with most occurrences of each query."""
    hits = V.phrase_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), _queries(spark, sf_dir))
    return V.top_k(hits, ["query_id"], [F.desc("hits"), F.asc("doc_id")], 5)


@query(
    "rrf_fusion",
    f"""WITH {_BM25}, {_COUNTS}, l AS (SELECT query_id, substr(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), 1, 500) AS k, doc_id, rank, list_no FROM (SELECT query_id, doc_id, rank, 1 AS list_no FROM bm UNION ALL SELECT query_id, doc_id, rank, 2 FROM ct) JOIN documents USING (doc_id))
SELECT query_id, round(sum(1 / (60.0 + rank)), 6) AS score, arg_min(doc_id, list_no * 1000 + rank) AS doc_id FROM l GROUP BY query_id, k""",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _bm25(spark, sf_dir).select("query_id", "doc_id", "rank", F.lit(1).alias("list_no"))
    b = _count_hits(spark, sf_dir).select("query_id", "doc_id", "rank", F.lit(2).alias("list_no"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lists = stored(a.unionByName(b), "ranked_lists")
    hits = docs.join(small(lists.select("doc_id").distinct()), "doc_id", "left_semi")  # a few texts are normalised, not all
    keyed = hits.join(lists, "doc_id").select("query_id", "doc_id", "rank", "list_no", F.substring(F.regexp_replace(F.lower("text"), r"\s+", " "), 1, 500).alias("key"))
    fused = V.rrf(keyed)
    payload = keyed.select("query_id", "key", "list_no", "rank", "doc_id")
    return fused.join(payload, ["query_id", "key", "list_no", "rank"]).select("query_id", "score", "doc_id")


@query("fusion_boost", f"WITH {_BM25} SELECT query_id, doc_id, round(score + CASE WHEN contains(lower(text), 'tion') OR contains(lower(text), 'ment') THEN 0.08 ELSE 0 END, 6) AS score FROM bm JOIN documents USING (doc_id)")
def fusion_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _bm25(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    terms = F.array(F.lit("tion"), F.lit("ment"))
    boost = F.when(F.exists(terms, lambda x: F.contains(F.col("t"), x)), 0.08).otherwise(0.0)
    return hits.join(docs, "doc_id").select("query_id", "doc_id", F.round(F.col("score") + boost, 6).alias("score"))


_FEATURES = f"""WITH {_BM25}, p AS (SELECT query_id, doc_id, score, list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda x: x <> '') AS q, list_filter(regexp_split_to_array(lower(d.text), '\\s+'), lambda x: x <> '') AS t
 FROM bm JOIN ({_Q}) b ON b.item_id = query_id JOIN documents d USING (doc_id)),
f AS (SELECT query_id, doc_id, score AS base, len(list_intersect(list_distinct(q), list_distinct(t))) / greatest(len(list_distinct(q)), 1)::DOUBLE AS overlap,
 len(list_intersect(list_distinct(q), list_distinct(t))) / greatest(len(list_distinct(list_concat(q, t))), 1)::DOUBLE AS jaccard, least(len(q) / 32.0, 1) AS query_norm, least(len(t) / 512.0, 1) AS text_norm,
 least(len(q), len(t)) / greatest(len(q), len(t), 1)::DOUBLE AS length_ratio,
 CASE WHEN len(list_filter(range(1, len(q)), lambda i: contains(array_to_string(t, ' '), q[i] || ' ' || q[i + 1]))) > 0 THEN 1.0 ELSE 0.0 END AS bigram FROM p)"""
_NAMES = ["base", "overlap", "jaccard", "query_norm", "text_norm", "length_ratio", "bigram"]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _bm25(spark, sf_dir).select("query_id", "doc_id", "score")
    pairs = hits.join(_queries(spark, sf_dir).withColumnRenamed("text", "q"), "query_id").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return pairs.select("query_id", "doc_id", *[c.alias(n) for n, c in V.rerank_features(F.col("q"), F.col("text"), F.col("score")).items()])


@query("rerank_features", _FEATURES + " SELECT query_id, doc_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES) + " FROM f")
def rerank_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("query_id", "doc_id", *[F.round(n, 6).alias(n) for n in _NAMES])


@query("rerank_minmax", _FEATURES + " SELECT query_id, doc_id, " + ", ".join(f"round(CASE WHEN max({n}) OVER () - min({n}) OVER () <= 1e-12 THEN 0 ELSE ({n} - min({n}) OVER ()) / (max({n}) OVER () - min({n}) OVER ()) END, 5) AS {n}" for n in _NAMES) + " FROM f")
def rerank_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.min_max(_features(spark, sf_dir), _NAMES).select("query_id", "doc_id", *[F.round(n, 5).alias(n) for n in _NAMES])


@query(
    "linear_rerank_sigmoid",
    _FEATURES + " SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM (SELECT query_id, doc_id, round(1 / (1 + exp(-(0.1 * base + 1.5 * overlap + 2 * jaccard - 0.5 * text_norm + bigram - 1))), 6) AS score FROM f)) WHERE rank <= 3",
)
def linear_rerank_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = V.weighted_score({n: F.col(n) for n in _NAMES}, {"base": 0.1, "overlap": 1.5, "jaccard": 2.0, "text_norm": -0.5, "bigram": 1.0}) - 1
    scored = _features(spark, sf_dir).select("query_id", "doc_id", F.round(V.sigmoid(raw), 6).alias("score"))
    return V.top_k(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], 3).select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_VEC = """SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id, v.label = q.label AS rel, {score} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({score}, 9) DESC, v.vec_id) AS rank
FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id) WHERE rank <= {k}"""
_DOT = "list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _neighbours(spark: SparkSession, sf_dir: str, k: int, cosine: bool = False) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    # a vector is no answer to itself: one more is asked for and the query left out
    found = V.vector_top_k(v, q, k + 1, cosine=cosine).where("vec_id <> query_id").drop("rank")
    ranked = stored(V.top_k(found, ["query_id"], [F.desc(F.round("score", 9)), F.asc("vec_id")], k), "neighbours")
    labels = v.select("vec_id", "label").join(small(ranked.select("vec_id").union(ranked.select("query_id")).distinct()), "vec_id", "left_semi")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return ranked.join(labels, "vec_id").join(own, "query_id").select("query_id", "vec_id", (F.col("label") == F.col("own")).alias("rel"), "score", F.col("rank").cast("long").alias("rank"))


@query("vector_topk_ip", f"SELECT query_id, vec_id, round(score, 6) AS score, rank::BIGINT AS rank FROM ({_VEC.format(score=_DOT, k=5)})")
def vector_topk_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("vector_cosine_scaled", f"SELECT query_id, vec_id, round(least(greatest((score + 1) / 2, 0), 1), 6) AS score FROM ({_VEC.format(score=_COS, k=3)})")
def vector_cosine_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, 3, cosine=True).select("query_id", "vec_id", F.round(V.scaled_cosine(F.col("score")), 6).alias("score"))


@query(
    "rank_metrics",
    f"""WITH h AS ({_VEC.format(score=_DOT, k=10)}), t AS (SELECT a.vec_id AS query_id, count(*) - 1 AS total FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0 GROUP BY 1),
m AS (SELECT query_id, count(*) FILTER (rel AND rank <= 5) AS good, count(*) FILTER (rel) AS all_good, coalesce(1.0 / min(rank) FILTER (rel), 0) AS mrr, coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 5), 0) AS dcg FROM h GROUP BY 1)
SELECT query_id, round(good / 5.0, 6) AS precision_k, round(good / 5.0, 6) AS precision_n, round(good / total::DOUBLE, 6) AS recall, (good > 0)::BIGINT AS hit, round(mrr, 6) AS mrr,
round(CASE WHEN all_good > 0 THEN dcg / list_sum(list_transform(range(1, least(5, all_good) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_list,
round(CASE WHEN total > 0 THEN dcg / list_sum(list_transform(range(1, least(5, total) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_set FROM m JOIN t USING (query_id)""",
)
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    totals = v.groupBy("label").agg((F.count("*") - 1).cast("int").alias("total"))
    total = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(totals, "label").select("query_id", "total")
    hits = _neighbours(spark, sf_dir, 10).withColumn("rel", F.col("rel").cast("int")).join(total, "query_id")
    m = E.rank_metrics(hits, ["query_id"], 5, F.col("total"))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision_k", "precision_n", "recall")], F.col("hit").cast("long").alias("hit"), *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg_list", "ndcg_set")])


@query(
    "rank_metrics_overall",
    f"""WITH h AS ({_VEC.format(score=_DOT, k=10)}), m AS (SELECT query_id, count(*) FILTER (rel) AS good, coalesce(1.0 / min(rank) FILTER (rel), 0) AS mrr, {", ".join(f"max((rel AND rank <= {k})::INT) AS h{k}" for k in (1, 5, 10))},
{", ".join(f"coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= {k}), 0) AS d{k}" for k in (5, 10))} FROM h GROUP BY 1)
SELECT count(*)::BIGINT AS queries, round(avg(mrr), 6) AS mrr, {", ".join(f"round(avg(h{k}), 6) AS hit_{k}" for k in (1, 5, 10))},
{", ".join(f"round(avg(CASE WHEN good > 0 THEN d{k} / list_sum(list_transform(range(1, least({k}, good) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END), 6) AS ndcg_{k}" for k in (5, 10))} FROM m""",
)
def rank_metrics_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over all queries of MRR, hit@1/5/10 and nDCG@5/10."""
    hits = stored(_neighbours(spark, sf_dir, 10).withColumn("rel", F.col("rel").cast("int")), "overall_hits")
    by_query = None
    for k in (1, 5, 10):
        one = E.rank_metrics(hits, ["query_id"], k, F.lit(k)).select("query_id", "mrr", F.col("hit").alias(f"hit_{k}"), F.col("ndcg_list").alias(f"ndcg_{k}"))
        by_query = one if by_query is None else by_query.join(one.drop("mrr"), "query_id")
    return by_query.agg(F.count("*").alias("queries"), F.round(F.avg("mrr"), 6).alias("mrr"), *[F.round(F.avg(f"hit_{k}"), 6).alias(f"hit_{k}") for k in (1, 5, 10)], *[F.round(F.avg(f"ndcg_{k}"), 6).alias(f"ndcg_{k}") for k in (5, 10)])


@query(
    "cold_start_buckets",
    f"""WITH h AS (SELECT query_id, max((rel AND rank <= 5)::INT) AS hit5, max((rel AND rank <= 1)::INT) AS hit1 FROM ({_VEC.format(score=_DOT, k=5)}) GROUP BY 1), n AS (SELECT query_id, hit1, hit5, query_id // 100 AS history FROM h)
SELECT b AS bucket, count(*)::BIGINT AS cases, round(avg(hit1), 6) AS hit_1, round(avg(hit5), 6) AS hit_5 FROM n, (SELECT unnest([0, 1, 3, 5]) AS b) WHERE history >= b GROUP BY b""",
)
def cold_start_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _neighbours(spark, sf_dir, 5).groupBy("query_id").agg(F.max((F.col("rel") & (F.col("rank") <= 5)).cast("int")).alias("h5"), F.max((F.col("rel") & (F.col("rank") <= 1)).cast("int")).alias("h1"))
    history = F.expr("query_id div 100")
    cases = hits.select("h1", "h5", F.explode(F.filter(F.array(*map(F.lit, (0, 1, 3, 5))), lambda b: b <= history)).alias("bucket"))
    return cases.groupBy("bucket").agg(F.count("*").alias("cases"), F.round(F.avg("h1"), 6).alias("hit_1"), F.round(F.avg("h5"), 6).alias("hit_5"))


@query("hash_embedding_norms")
def hash_embedding_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.hash_embedding(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return e.groupBy("doc_id").agg(F.count("*").alias("filled"), F.round(F.sum(F.col("weight") * F.col("weight")), 6).alias("norm"))


@query("vector_index_query", f"SELECT label, count(*)::BIGINT AS hits FROM ({_VEC.format(score=_DOT, k=5)}) h JOIN embeddings e ON e.vec_id = h.vec_id GROUP BY label")
def vector_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _neighbours(spark, sf_dir, 5).select("vec_id")
    return hits.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id").groupBy("label").agg(F.count("*").alias("hits"))


def ranked_or_counted(ranked: DataFrame, counted: DataFrame) -> DataFrame:
    """(query_id, doc_id, tier): the ranked hits of a query, or its occurrences where the ranked search found nothing."""
    first = ranked.select("query_id", "doc_id", F.lit("ranked").alias("tier"))
    rest = counted.select("query_id", "doc_id", F.lit("count").alias("tier"))
    return first.unionByName(rest.join(ranked.select("query_id").distinct(), "query_id", "left_anti"))


@query("semantic_or_local_search", f"WITH {_BM25}, {_COUNTS} SELECT query_id, doc_id, 'ranked' AS tier FROM bm UNION ALL SELECT query_id, doc_id, 'count' FROM ct WHERE query_id NOT IN (SELECT query_id FROM bm)")
def semantic_or_local_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_or_counted(stored(_bm25(spark, sf_dir), "ranked"), _count_hits(spark, sf_dir))


@query("weighted_recency", "SELECT o_orderkey, round(0.7 * least(greatest((year(o_orderdate) - 1995) / 6.0, 0), 1) + 0.3 * o_totalprice / 500000, 9) AS score FROM orders")
def weighted_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {"recency": V.recency(F.year("o_orderdate"), 1995, 2001), "price": F.col("o_totalprice") / 500000}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(V.weighted_score(parts, {"recency": 0.7, "price": 0.3, "absent": 0.5}), 9).alias("score"))


@query(
    "relation_prf",
    """WITH p AS (SELECT DISTINCT l_returnflag AS domain, l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_quantity > 20), g AS (SELECT DISTINCT l_returnflag AS domain, l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_discount < 0.06),
b AS (SELECT domain, p.src IS NOT NULL AS p, g.src IS NOT NULL AS g FROM p FULL JOIN g USING (domain, src, dst)), n AS (SELECT domain, count(*) FILTER (p AND g) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM b GROUP BY ROLLUP (domain))
SELECT coalesce(domain, 'all') AS domain, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM n""",
)
def relation_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("domain"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_quantity", "l_discount")
    m = E.prf(lines.where("l_quantity > 20"), lines.where("l_discount < 0.06"), ["domain", "src", "dst"], ["domain"])
    return m.select(F.coalesce("domain", F.lit("all")).alias("domain"), "tp", "fp", "fn", F.round("f1", 6).alias("f1"))
