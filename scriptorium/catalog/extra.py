"""Upserts by key, provenance, stubs, nested cleaning, author strings and model calls."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import structure as S
from scriptorium.functions import text as T
from scriptorium.operators import graph as G
from scriptorium.operators import models
from scriptorium.operators import retrieval as V
from scriptorium.registry import query

from .base import table, values_sql
from .answers import ROUGE_SQL, rouge_scores
from .graph import _TOP, _W, _signals
from .retrieval import _features


@query("support_edges_stub", "SELECT l_orderkey AS src, l_partkey * 10 AS dst, max(1 - l_tax) AS confidence, NOT (l_partkey * 10 IN (SELECT o_orderkey FROM orders)) AS stub FROM lineitem GROUP BY ALL")
def support_edges_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper-to-paper edges; targets that are unknown get a stub."""
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("src"), (F.col("l_partkey") * 10).alias("dst")).agg(F.max(1 - F.col("l_tax")).alias("confidence"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dst"), F.lit(False).alias("known"))
    return e.join(known, "dst", "left").select("src", "dst", "confidence", F.coalesce(F.col("known"), F.lit(True)).alias("stub"))


@query(
    "provenance_update",
    """WITH o AS (SELECT l_orderkey AS k, max(1 - l_discount) AS c FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), n AS (SELECT l_orderkey AS k, max(1 - l_discount) AS c FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1)
SELECT k, CASE WHEN o.c IS NULL OR n.c >= o.c THEN n.c ELSE o.c END AS confidence, CASE WHEN o.c IS NULL OR n.c >= o.c THEN 'new' ELSE 'old' END AS evidence, CASE WHEN n.c IS NULL THEN 'old' ELSE 'new' END AS seen_by FROM o FULL JOIN n USING (k)""",
)
def provenance_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who saw an edge last is always updated, confidence and evidence only when not lower; edges of one side stay."""
    best = lambda odd: table(spark, sf_dir, "lineitem").where(f"l_linenumber % 2 = {odd}").groupBy(F.col("l_orderkey").alias("k")).agg(F.max(1 - F.col("l_discount")).alias(f"c{odd}"))
    newer = F.col("c0").isNull() | (F.col("c1") >= F.col("c0"))
    seen = F.when(F.col("c1").isNull(), "old").otherwise("new")
    return best(0).join(best(1), "k", "full_outer").select("k", F.when(newer, F.col("c1")).otherwise(F.col("c0")).alias("confidence"), F.when(newer, "new").otherwise("old").alias("evidence"), seen.alias("seen_by"))


@query("metadata_upsert", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce('q' || quality, source) AS kind, coalesce(lang, 'none') AS lang FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("kind"), "lang")
    new = table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("kind"), F.lit(None).cast("string").alias("lang"))
    return G.upsert_fill(old, new, ["doc_id"], ["kind", "lang"], []).select("doc_id", "kind", F.coalesce("lang", F.lit("none")).alias("lang"))


@query("artifact_upsert", "SELECT event_id % 100 AS document_id, event_type AS artifact_type, max(value) AS size FROM events GROUP BY ALL")
def artifact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 100).alias("document_id"), F.col("event_type").alias("artifact_type"), F.col("value").alias("size"))
    return G.upsert_best(e.where("size < 50"), e.where("size >= 50"), ["document_id", "artifact_type"], "size", []).select("document_id", "artifact_type", "size")


@query("batch_recommend", _TOP + ", s AS (SELECT o_orderkey AS src FROM orders WHERE o_orderkey % 100 = 0) SELECT src, count(other)::BIGINT AS n FROM s LEFT JOIN (SELECT src, other FROM r WHERE rank <= 5) USING (src) GROUP BY src")
def batch_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seed papers at once; a paper without candidates has an empty list, not an error."""
    found = G.recommend(_signals(spark, sf_dir), _W, 5).groupBy("src").agg(F.count("*").alias("n"))
    all_ = table(spark, sf_dir, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("src"))
    return all_.join(found, "src", "left").select("src", F.coalesce("n", F.lit(0)).alias("n"))


_DOC = [(1, " A ﬁne\ttitle ", "Intro\n\n\n\nbody  text", "see-\nthe “figure”"), (2, "x", "Page 3\nkeep", None)]


@query("clean_document_struct", f"SELECT id, trim(regexp_replace(replace(t, 'ﬁ', 'fi'), '[ \\t]{{2,}}', ' ', 'g')) AS title, trim(regexp_replace(regexp_replace(regexp_replace(s, '(?m)^[\\t ]*Page\\s+\\d+[\\t ]*$', '', 'g'), '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS section, replace(replace(regexp_replace(c, '-\\n', '', 'g'), '“', '\"'), '”', '\"') AS caption FROM {values_sql(['id', 't', 's', 'c'], _DOC)}")
def clean_document_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field of a nested document by its own cleaner."""
    df = spark.createDataFrame(_DOC, "id int, t string, s string, c string")
    nested = df.select("id", F.struct(F.col("t").alias("title"), F.array(F.struct(F.col("s").alias("content"))).alias("sections"), F.array(F.struct(F.col("c").alias("caption"))).alias("figures")).alias("d"))
    cleaned = nested.select(
        "id", T.clean_heading(F.col("d.title")).alias("title"),
        F.transform("d.sections", lambda s: F.struct(T.clean_text(s.content).alias("content"))).alias("sections"), F.transform("d.figures", lambda f: F.struct(T.clean_text(f.caption).alias("caption"))).alias("figures"),
    )
    return cleaned.select("id", "title", F.col("sections")[0]["content"].alias("section"), F.col("figures")[0]["caption"].alias("caption"))


_ROUGE = "WITH rouge AS (" + ROUGE_SQL + ") "

_AUTHORS = [(1, "Jane Doe (University of X, USA)"), (2, "John Roe, Institute of Y"), (3, "Ann Lee1,2"), (4, "Bo Li bo.li@acme.com"), (5, "Kim Park - Acme Corp, Korea")]


# Words of a place -> country; the first that fits.
COUNTRY_WORDS = {"VN": ["vietnam", "vnu", "hust"], "US": ["usa", "united states"], "JP": ["japan"], "CN": ["china"], "KR": ["korea"]}


def author_parts(raw: Column) -> Column:
    """struct<name, affiliation, email, kind, country> of an author string."""
    email = F.regexp_extract(raw, r"([\w.+-]+@[\w.-]+\.[a-zA-Z]{2,})", 1)
    bare = T.strip(F.replace(raw, email, F.lit("")))
    bare = F.when(email == "", raw).otherwise(bare)
    paren, dash, mark = r"^([^(]+?)\s*\(([^)]+)\)\s*$", r"^([^,\-]+?)\s*[,\-]\s*(.+)$", r"^([^\d]+?)\s*[\d,]+\s*$"
    name = F.when(bare.rlike(paren), F.regexp_extract(bare, paren, 1)).when(bare.rlike(dash) & ~bare.rlike(mark), F.regexp_extract(bare, dash, 1)).when(bare.rlike(mark), F.regexp_extract(bare, mark, 1)).otherwise(bare)
    place = F.when(bare.rlike(paren), F.regexp_extract(bare, paren, 2)).when(bare.rlike(dash) & ~bare.rlike(mark), F.regexp_extract(bare, dash, 2)).otherwise("")
    low = F.lower(place)
    kind = F.when(low.rlike("university"), "university").when(low.rlike("institute"), "institute").when(low.rlike("company|corp|ltd"), "company").otherwise("")
    country = F.lit("")
    for code in reversed(COUNTRY_WORDS):
        country = F.when(low.rlike("|".join(COUNTRY_WORDS[code])), code).otherwise(country)
    return F.struct(T.strip(name).alias("name"), place.alias("affiliation"), email.alias("email"), kind.alias("kind"), country.alias("country"))


@query("author_parse_affiliation")
def author_parse_affiliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_AUTHORS, "id int, t string").select("id", F.inline(F.array(author_parts(F.col("t")))))


_APA = [(1, "Smith, J., & Doe, A. B. (2019). A title."), (2, "John Smith, Jane Doe (2020) T"), (3, "no year"), (4, "Lee, K. (2001a). X")]


@query("author_parse")
def author_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author block before (year); surnames take the initials that follow them."""
    block = F.regexp_replace(T.strip(F.regexp_extract("t", r"^(.*?)\s*\(\d{4}[a-z]?\)", 1)), r"\.$", "")
    initial = r"^[A-ZÀ-Ý](\.\s?[A-ZÀ-Ý])*\.?$"
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.col("block"), r",?\s*&\s*", ", "), r",\s*"), T.strip), lambda x: x != "")
    dotted = lambda x: F.when(x.endswith("."), x).otherwise(F.concat(x, F.lit(".")))
    add = lambda acc, x: F.when(x.rlike(initial) & (F.size(acc) > 0), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.when(F.contains(F.element_at(acc, -1), F.lit(",")), F.lit(" ")).otherwise(F.lit(", ")), dotted(x))))).otherwise(F.array_append(acc, x))
    folded = F.aggregate(parts, F.array().cast("array<string>"), add)
    return spark.createDataFrame(_APA, "id int, t string").select("id", block.alias("block")).select("id", F.array_join(folded, "; ").alias("authors"), F.size(S.clean_authors(folded)).alias("valid"))


@query("summary_mode_avg", _ROUGE + "SELECT 'turn' || turn AS mode, count(*)::BIGINT AS n, round(avg(rouge_1), 5) AS rouge_1, round(avg(rouge_2), 5) AS rouge_2 FROM rouge GROUP BY turn")
def summary_mode_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ROUGE of the answers of each mode (here: the turn)."""
    scores = rouge_scores(spark, sf_dir).withColumn("mode", F.concat(F.lit("turn"), "turn"))
    return scores.groupBy("mode").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in ("rouge_1", "rouge_2")])


@query("model_generate_stub", "SELECT conv_id, turn, substr(string_split(trim('Q: ' || text), '.')[1], 1, 200) AS answer FROM conversations WHERE role = 'user'")
def model_generate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", models.generate()(models.prompt("Q: {text}", text=F.col("text"))).alias("answer"))


@query("mlp_rerank")
def mlp_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked hits of every query reordered by the network over their seven features."""
    f = _features(spark, sf_dir)
    scored = f.select("query_id", "doc_id", F.round(models.mlp_score(F.array(*[F.col(c).cast("double") for c in f.columns[2:]])), 6).alias("score"))
    return V.top_k(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], 5).select("query_id", "doc_id", "score", "rank")


@query("uuid_paper_ids")
def uuid_paper_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based ids: of the doi, else of title and year."""
    import uuid

    @F.pandas_udf("string")
    def make(key: pd.Series) -> pd.Series:
        return key.map(lambda k: str(uuid.uuid5(uuid.NAMESPACE_URL, k)))

    o = table(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("doi:10.1/"), "o_orderkey")).otherwise(F.concat_ws("|", F.concat(F.lit("t"), "o_orderkey"), F.year("o_orderdate")))
    return o.select(F.col("o_orderkey").alias("id"), make(key).alias("paper_id"))
