"""Document records: metadata, lookups, entity merging, relation rules, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import strip
from scriptorium.operators import records as M
from scriptorium.plans.scratch import scratch_path
from scriptorium.registry import query
from scriptorium.sources import files

from .base import table, values_sql

_OLD = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE substr(text, 1, 20) END AS title, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 2 = 0 THEN 2000 END AS year FROM documents"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        "doc_id", F.when(i % 3 == 0, "Unknown").otherwise(F.substring("text", 1, 20)).alias("title"), F.when(i % 4 == 0, " ").otherwise(F.concat(F.lit("10.1/"), i)).alias("doi"),
        F.when(i % 2 == 0, 2000).alias("year"), F.array("lang").alias("keywords"), F.concat(F.lit("T"), i).alias("new_title"), F.concat(F.lit("10.9/"), i).alias("new_doi"), (1890 + i % 100).alias("new_year"), F.array("lang", "source").alias("new_keywords"),
    )


@query("metadata_fill", f"SELECT doc_id, coalesce(CASE WHEN trim(title) = '' OR title = 'Unknown' THEN NULL ELSE title END, 'T' || doc_id) AS title, coalesce(CASE WHEN trim(doi) = '' THEN NULL ELSE doi END, '10.9/' || doc_id) AS doi, coalesce(year, CASE WHEN 1890 + doc_id % 100 BETWEEN 1900 AND 2100 THEN 1890 + doc_id % 100 END)::BIGINT AS year, lang || ',' || source AS keywords FROM ({_OLD}) JOIN documents USING (doc_id)")
def metadata_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("title", "doi", "year", "keywords")
    merged = M.fill_metadata({c: F.col(c) for c in names}, {c: F.col(f"new_{c}") for c in names})
    return _versions(spark, sf_dir).select("doc_id", merged["title"].alias("title"), merged["doi"].alias("doi"), merged["year"].cast("long").alias("year"), F.array_join(merged["keywords"], ",").alias("keywords"))


@query("metadata_override", "SELECT doc_id, 'T' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 2000 WHEN 1890 + doc_id % 100 BETWEEN 1900 AND 2100 THEN 1890 + doc_id % 100 END::BIGINT AS year FROM documents")
def metadata_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's title always, its year only where none is known and it is plausible."""
    year = F.coalesce("year", F.when(F.col("new_year").between(1900, 2100), F.col("new_year")))
    return _versions(spark, sf_dir).select("doc_id", F.coalesce("new_title", "title").alias("title"), year.cast("long").alias("year"))


_SCORE = "(CASE WHEN length({t}) >= 12 THEN 4 ELSE 0 END + CASE WHEN length({a}) >= 50 THEN 4 ELSE 0 END + 3 + 1 + CASE WHEN {y} THEN 1 ELSE 0 END)"


@query(
    "metadata_repair",
    f"""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'bad' ELSE substr(text, 1, 30) END AS t1, CASE WHEN doc_id % 5 = 0 THEN '' ELSE substr(text, 31, 80) END AS a1, doc_id % 2 = 0 AS y1, substr(text, 1, 40) AS t0, substr(text, 41, 80) AS a0 FROM documents),
s AS (SELECT *, {_SCORE.format(t='t1', a='a1', y='y1')} AS s1, {_SCORE.format(t='t0', a='a0', y='true')} AS s0 FROM v) SELECT doc_id, CASE WHEN s1 < 8 AND s0 > s1 THEN t0 ELSE t1 END AS title, greatest(s1, CASE WHEN s1 < 8 THEN s0 ELSE s1 END)::BIGINT AS score FROM s""",
)
def metadata_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, one = F.col("doc_id"), F.array(F.lit("x"))
    v = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 5 == 0, "bad").otherwise(F.substring("text", 1, 30)).alias("t1"), F.when(i % 5 == 0, "").otherwise(F.substring("text", 31, 80)).alias("a1"), F.when(i % 2 == 0, 2000).alias("y1"),
        F.substring("text", 1, 40).alias("t0"), F.substring("text", 41, 80).alias("a0"),
    )
    s = v.withColumns({"s1": M.quality_score(F.col("t1"), F.col("a1"), one, one, F.col("y1")), "s0": M.quality_score(F.col("t0"), F.col("a0"), one, one, F.lit(1))})
    worse = (F.col("s1") < 8) & (F.col("s0") > F.col("s1"))
    return s.select("doc_id", F.when(worse, F.col("t0")).otherwise(F.col("t1")).alias("title"), F.when(worse, F.col("s0")).otherwise(F.col("s1")).cast("long").alias("score"))


@query("nul_strip", "SELECT doc_id, length(text)::BIGINT AS n, lang FROM documents")
def nul_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULs are put into nested strings and must all be gone."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.concat("text", F.lit("\u0000")).alias("t"))).alias("parts"), F.concat(F.lit("\u0000"), "lang").alias("lang"))
    return M.strip_nul(d).select("doc_id", F.length(F.col("parts")[0]["t"]).cast("long").alias("n"), "lang")


@query("text_fallback", "SELECT doc_id, length(CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN 'full ' || lang WHEN doc_id % 4 = 2 THEN lang || chr(10) || source ELSE source || chr(10) || lang END)::BIGINT AS n FROM documents")
def text_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("doc_id") % 4, F.lit(None).cast("string")
    section = lambda c: F.struct(F.col(c).alias("content"))
    doc = {"text": F.when(k == 0, F.col("text")).otherwise(" "), "full_text": F.when(k == 1, F.concat(F.lit("full "), "lang")), "sections": F.when(k == 2, F.array(section("lang"), section("source"))), "title": F.col("source"), "abstract": none, "keywords": F.array("lang")}
    return table(spark, sf_dir, "documents").select("doc_id", F.length(M.text_of(doc)).cast("long").alias("n"))


@query("resolve_document_id", "SELECT doc_id AS n, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE nullif(trim(CASE WHEN doc_id % 3 = 1 THEN ' ' ELSE source END), '') END, 'd' || doc_id, 'unknown') AS id FROM documents")
def resolve_document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    file = F.when(i % 3 == 0, None).otherwise(F.when(i % 3 == 1, " ").otherwise(F.col("source")))
    return table(spark, sf_dir, "documents").select(i.alias("n"), F.coalesce(M.given(file), F.concat(F.lit("d"), i), F.lit("unknown")).alias("id"))


@query("presence_scan", "SELECT count(*)::BIGINT AS total, count(text)::BIGINT AS texts, count(*) FILTER (length(text) >= 50)::BIGINT AS abstracts, count(q.quality)::BIGINT AS labelled, round(avg((length(text) >= 50)::INT), 6) AS coverage, avg((length(text) >= 50)::INT) >= 0.95 AS passed FROM documents LEFT JOIN labels q USING (doc_id)")
def presence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    long_enough = F.length("text") >= 50
    share = F.avg(long_enough.cast("int"))
    return d.agg(F.count("*").alias("total"), F.count("text").alias("texts"), F.count_if(long_enough).alias("abstracts"), F.count("quality").alias("labelled"), F.round(share, 6).alias("coverage"), (share >= 0.95).alias("passed"))


@query("topics_methods_dedup", "SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:30], ' ') AS topics FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}]+') AS w FROM documents)")
def topics_methods_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.array_distinct(words), 1, 30), " ").alias("topics"))


_ALIASES = [(1, "Net|CNN | convnet||"), (2, ""), (3, "a|a| b")]


@query("alias_lists", f"SELECT id, array_to_string(list_filter(list_transform(string_split(t, '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS aliases FROM {values_sql(['id', 't'], _ALIASES)}")
def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("t", r"\|"), strip), lambda x: x != "")
    return spark.createDataFrame(_ALIASES, "id int, t string").select("id", F.array_join(parts, ";").alias("aliases"))


@query(
    "fulltext_lookup",
    """WITH p AS (SELECT p_partkey AS id, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM part), a AS (SELECT id, len(w) AS n, unnest(w) AS word FROM p),
b AS (SELECT id AS match, len(w) AS m, unnest(w) AS word FROM p), s AS (SELECT id, match, count(*) / greatest(n, m)::DOUBLE AS score FROM a JOIN b USING (word) WHERE id <> match GROUP BY id, match, n, m)
SELECT id, match, round(score, 6) AS score FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, match) = 1""",
)
def fulltext_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    """The best other entry; a name is its own best match, so two are asked for."""
    found = M.overlap_lookup(p, p, 0.5, k=2).where("id <> match")
    return found.groupBy("id").agg(F.min(F.struct("rank", "match", "score")).alias("f")).select("id", "f.match", F.round("f.score", 6).alias("score"))


@query("title_similarity")
def title_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose lower-cased titles are alike (ratio from 0.8): every hundredth against all, through their rarest words."""
    titles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("title"))
    found = M.similar_titles(titles.where("id % 100 = 0"), titles)
    return found.select("id", "match", F.round("ratio", 6).alias("ratio"))


_FOUND = [(1, "ResNet-50", ["residual net"], 0.8, 0), (1, "resnet 50", [], 0.9, 1), (1, "Residual Net", [], 0.95, 2), (1, "BERT", [], 0.7, 0), (2, "bert", [], 0.6, 1), (2, "BERT", [], 0.6, 0)]


@query("entity_accumulate")
def entity_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(_FOUND, "doc_id int, name string, aliases array<string>, confidence double, section int")
    return M.merge_entities(df).select("doc_id", "name", "confidence")


@query("verify_batches", "SELECT l_orderkey AS paper, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) - 1) // 3 AS batch, l_partkey AS target FROM lineitem")
def verify_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_partkey").alias("target"), "l_linenumber")
    return M.batches(rows, ["paper"], ["target", "l_linenumber"], 3).select("paper", "batch", "target")


_TILES = [(1, 0, 0.0, 0.0, 100.0), (2, 0, 2.0, 103.0, 200.0), (3, 0, 50.0, 103.0, 200.0), (4, 0, 1.0, 199.0, 300.0), (5, 1, 0.0, 100.0, 200.0), (6, 0, 51.0, 400.0, 500.0)]


@query("tile_groups", f"WITH RECURSIVE t AS (SELECT * FROM {values_sql(['tile_id', 'page', 'x0', 'y0', 'y1'], _TILES)}), e AS (SELECT a.tile_id AS a, b.tile_id AS b FROM t a JOIN t b ON a.page = b.page AND a.tile_id <> b.tile_id AND abs(a.x0 - b.x0) < 5 AND (abs(a.y1 - b.y0) < 5 OR abs(b.y1 - a.y0) < 5)), r AS (SELECT tile_id, tile_id AS g FROM t UNION SELECT e.b, g FROM r JOIN e ON e.a = r.tile_id) SELECT tile_id, min(g)::BIGINT AS \"group\" FROM r GROUP BY 1")
def tile_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.tile_groups(spark.createDataFrame(_TILES, "tile_id long, page int, x0 double, y0 double, y1 double"))


@query("positional_zip", "SELECT a.user_id AS doc, a.event_id AS figure, b.o_orderkey AS blob FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) a JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) b ON a.user_id = b.o_custkey AND a.n = b.n")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's figures and blobs by their place in it."""
    doc = Window.partitionBy("doc")
    a = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("figure")).withColumn("n", F.row_number().over(doc.orderBy("figure")))
    b = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("blob")).withColumn("n", F.row_number().over(doc.orderBy("blob")))
    return a.join(b, ["doc", "n"]).select("doc", "figure", "blob")


@query("paper_key_resolution", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'doi:10.1/' || o_orderkey ELSE 'title:t' || o_orderkey % 100 || ':' || CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) ELSE 0 END END AS key FROM orders")
def paper_key_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paper's key is its doi, else title and year with 0 for unknown."""
    i = F.col("o_orderkey")
    doi, year = F.when(i % 3 == 0, F.concat(F.lit("10.1/"), i)), F.when(i % 2 == 0, F.year("o_orderdate"))
    key = F.coalesce(F.concat(F.lit("doi:"), doi), F.concat_ws(":", F.lit("title"), F.concat(F.lit("t"), i % 100), F.coalesce(year, F.lit(0))))
    return table(spark, sf_dir, "orders").select(i.alias("id"), key.alias("key"))


_REFS = [(1, "file=paper_a.pdf page=3 chunk=7", "paper_a.pdf", 3, 7), (2, "PAPER_A, page 4", "paper_a.pdf", 4, 1), (3, "paper_b.pdf page: 9", "paper_a.pdf", 9, 1), (4, "paper_a page=5", "paper_a.pdf", 6, 2)]


@query(
    "gold_reference_match",
    f"""SELECT id, contains(lower(file), regexp_extract(lower(ref), '(?:file=)?([a-z_]+)', 1)) AND (regexp_extract(lower(ref), 'page\\s*[:=]?\\s*(\\d+)', 1) = page::VARCHAR) AND (regexp_extract(lower(ref), 'chunk\\s*[:=]?\\s*(\\d+)', 1) IN ('', chunk::VARCHAR)) AS hit FROM {values_sql(['id', 'ref', 'file', 'page', 'chunk'], _REFS)}""",
)
def gold_reference_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.lower("ref")
    file, page, chunk = F.regexp_extract(ref, r"(?:file=)?([a-z_]+)", 1), F.regexp_extract(ref, r"page\s*[:=]?\s*(\d+)", 1), F.regexp_extract(ref, r"chunk\s*[:=]?\s*(\d+)", 1)
    hit = F.contains(F.lower("file"), file) & (page == F.col("page").cast("string")) & ((chunk == "") | (chunk == F.col("chunk").cast("string")))
    return spark.createDataFrame(_REFS, "id int, ref string, file string, page int, chunk int").select("id", hit.alias("hit"))


# Verbs of use near an entity, as a pattern.
_VERBS = "propose[sd]?|use[sd]?|apply|appli(?:es|ed)|adopt(?:ed)?|employ(?:ed)?|implement(?:ed)?|fine[\\s-]tun(?:e[sd]?|ing)|pre[\\s-]train(?:ed)?"
_RELATIONS = [(1, "We propose a BERT model here.", "bert", 0.85, "method"), (2, "Nothing about it. " + "x" * 300 + " used", "nothing", 0.7, "results"), (3, "GPT is adopted", "gpt", 0.97, "approach x"), (4, "no such name", "zeta", 0.5, "other")]


@query("relation_rules", f"SELECT id, round(least(1.0, least(1.0, c + CASE WHEN strpos(lower(t), n) > 0 AND regexp_matches(substr(t, greatest(1, strpos(lower(t), n) - 250), 500 + length(n)), '(?i){_VERBS}') THEN 0.10 ELSE 0 END) + CASE WHEN regexp_matches(s, '^(method|proposed|approach)') THEN 0.05 ELSE 0 END), 3) AS confidence FROM {values_sql(['id', 't', 'n', 'c', 's'], _RELATIONS)}")
def relation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """+0.10 for a verb of use within 250 characters of the name, +0.05 in a method section, at most 1."""
    at = F.expr("instr(lower(t), n)")
    near = F.substring(F.col("t"), F.greatest(F.lit(1), at - 250), F.lit(500) + F.length("n"))
    used = F.when((at > 0) & near.rlike(f"(?i){_VERBS}"), 0.10).otherwise(0.0)
    section = F.when(F.col("s").rlike("^(method|proposed|approach)"), 0.05).otherwise(0.0)
    df = spark.createDataFrame(_RELATIONS, "id int, t string, n string, c double, s string")
    return df.select("id", F.round(F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("c") + used) + section), 3).alias("confidence"))


_JSON = [(1, '{"a": 1, "b": [1, 2]}'), (2, '```json\n{"a": 2}\n```'), (3, "not json"), (4, '{"a": 3')]


@query("lenient_json", f"SELECT id, try_cast(regexp_extract(t, '\"a\":\\s*(\\d+)', 1) AS BIGINT) AS a FROM {values_sql(['id', 't'], _JSON)}")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fences stripped, missing closing braces added."""
    bare = strip(F.regexp_replace("t", r"(?m)^```(?:json)?\s*$", ""))
    missing = F.greatest(F.lit(0), (F.length(bare) - F.length(F.replace(bare, F.lit("{"), F.lit("")))) - (F.length(bare) - F.length(F.replace(bare, F.lit("}"), F.lit("")))))
    return spark.createDataFrame(_JSON, "id int, t string").select("id", F.from_json(F.concat(bare, F.repeat(F.lit("}"), missing)), "a long").getField("a").alias("a"))


@query("keyword_tokens", "SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-zà-ỹ][a-zà-ỹ0-9]{2,}'), lambda x: NOT list_contains(['the', 'and', 'that', 'les', 'der', 'die', 'que'], x)))::BIGINT AS n FROM documents")
def keyword_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ỹ][a-zà-ỹ0-9]{2,})"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(found, lambda w: ~w.isin("the", "and", "that", "les", "der", "die", "que"))).cast("long").alias("n"))


@query("json_jsonl_csv_text_roundtrip", "SELECT 'jsonl' AS format, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'csv', count(*), sum(n_chars) FROM documents")
def json_jsonl_csv_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, also one of blank or no text, through JSONL, and its numbers through CSV with a header, by way of the shared folder."""
    d = table(spark, sf_dir, "documents")
    jsonl, csv = scratch_path(spark, "jsonl"), scratch_path(spark, "csv")
    d.select(F.col("text"), F.lit("q").alias("query"), F.col("doc_id").cast("string").alias("group_id")).write.json(jsonl)
    quoted = {"header": True, "escape": '"', "multiLine": True}  # a value may hold quotes and line breaks
    d.select("doc_id", "n_chars", "lang").write.options(**quoted).csv(csv)
    a = spark.read.schema("text string, query string, group_id string").json(jsonl).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).select(F.lit("jsonl").alias("format"), "n", "chars")
    b = spark.read.options(**quoted).schema("doc_id long, n_chars long, lang string").csv(csv).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).select(F.lit("csv").alias("format"), "n", "chars")
    return a.unionByName(b)


_FILES = [(1, "a.pdf", "%PDF-1.7 x"), (2, "b.bin", "<!DOCTYPE html><html>"), (3, "c.docx", "zip?"), (4, "d.txt", "plain"), (5, "e.HTM", "no tags"), (6, "noending", "")]


@query("detect_file_type", f"SELECT id, CASE WHEN starts_with(lower(c), '%pdf') THEN 'pdf' WHEN regexp_matches(lower(c), '<!doctype|<html|<head|<body') THEN 'html' WHEN lower(p) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(p), '\\.docx?$') THEN 'docx' WHEN regexp_matches(lower(p), '\\.x?html?$') THEN 'html' ELSE 'unknown' END AS file_type FROM {values_sql(['id', 'p', 'c'], _FILES)}")
def detect_file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(_FILES, "id int, p string, c string")
    return df.select("id", files.file_type(F.col("p"), F.encode("c", "UTF-8")).alias("file_type"))


@query("choose_page_text", "SELECT doc_id, CASE WHEN length(text) > 0.8 * length(text || lang) AND length(text) > 100 THEN 'layer' ELSE 'ocr' END AS chosen FROM documents")
def choose_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = files.page_text(F.col("text"), F.concat("text", "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(chosen == F.col("text"), "layer").otherwise("ocr").alias("chosen"))


@query("bad_title_authors", "SELECT c_custkey AS id, length(trim(c_name)) < 12 OR lower(c_name) IN ('unknown', 'untitled') AS bad_title, (regexp_matches(c_name, '\\d'))::INT >= greatest(1, 1 // 2) AS bad_authors FROM customer")
def bad_title_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array("c_name")
    noise = F.size(F.filter(names, lambda n: n.rlike(r"\d")))
    bad_title = (F.length(F.trim("c_name")) < 12) | F.lower("c_name").isin("unknown", "untitled")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), bad_title.alias("bad_title"), (noise >= F.greatest(F.lit(1), F.floor(F.size(names) / 2))).alias("bad_authors"))


@query("flatten_struct", "SELECT doc_id, lang AS meta_lang, source AS meta_place_source, '[' || n_chars || ']' AS meta_sizes FROM documents")
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", F.struct("source").alias("place"), F.array("n_chars").alias("sizes")).alias("meta"))
    return d.select(*M.flatten(d.schema))


_REGEX_META = [(1, "Received 3 May 2019. Journal of Things, Vol. 2\nAbstract: we do\nKeywords: a b, graph data; xy"), (2, "No year here\nKeywords: one")]


@query("regex_metadata", f"SELECT id, try_cast(regexp_extract(t, '\\b((?:19|20)\\d{{2}})\\b', 1) AS BIGINT) AS year, regexp_extract(t, '(Journal of [A-Z][a-z]+)', 1) AS journal, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_extract(t, '(?i)keywords?\\s*:\\s*([^\\n]+)', 1), '[,;]'), lambda x: trim(x)), lambda x: length(x) > 2 AND length(x) < 80), '|') AS keywords FROM {values_sql(['id', 't'], _REGEX_META)}")
def regex_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.transform(F.split(F.regexp_extract("t", r"(?i)keywords?\s*:\s*([^\n]+)", 1), "[,;]"), strip), lambda x: (F.length(x) > 2) & (F.length(x) < 80))
    return spark.createDataFrame(_REGEX_META, "id int, t string").select("id", F.regexp_extract("t", r"\b((?:19|20)\d{2})\b", 1).try_cast("long").alias("year"), F.regexp_extract("t", r"(Journal of [A-Z][a-z]+)", 1).alias("journal"), F.array_join(words, "|").alias("keywords"))


@query("best_lookup_match", "SELECT o_orderkey % 100 AS paper, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders WHERE o_totalprice >= 50 GROUP BY 1")
def best_lookup_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice >= 50")
    return o.groupBy((F.col("o_orderkey") % 100).alias("paper")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("best"))


def chunk_at_periods(docs: DataFrame, most: int = 2000) -> DataFrame:
    """(doc_id, chunk, text): pieces of at most ``most`` characters, cut at the last period past 60 % of that."""
    first = int(0.6 * most) + 1  # characters before the period at least
    ends = f".{{{first},{most - 1}}}\\.|" if first < most else ""
    piece = f"(?s)(?=.{{{most + 1}}})(?:{ends}.{{{most}}})|.{{1,{most}}}"
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(piece), 0)).alias("chunk", "text"))


@query("period_chunks")
def period_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_at_periods(table(spark, sf_dir, "documents")).select("doc_id", "chunk", F.length("text").alias("n"))
