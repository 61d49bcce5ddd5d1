"""Queries over texts: cleaning, quality, chunks, search by count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.registry import query

from .base import table, values_sql

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _duck_clean(x: str, aggressive: bool) -> str:
    x = f"translate({x}, '{T.OCR_FROM}', '{T.OCR_TO}')"
    for a, b in T.LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"""translate({x}, '{T.QUOTES_FROM}', '{T.QUOTES_TO.replace("'", "''")}')"""
    x = f"regexp_replace({x}, '{T.INVISIBLE}', '', 'g')"
    x = f"regexp_replace({x}, '([\\p{{L}}\\p{{N}}_])-\\n\\s*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    if aggressive:
        x = f"regexp_replace({x}, '([a-z,])\\n([a-z(])', '\\1 \\2', 'g')"
    x = f"replace({x}, chr(9), ' ')"
    for p in [T.PAGE_NUMBER, T.COPYRIGHT, T.PREPRINT, *([T.LONE_URL, T.LONE_EMAIL] if aggressive else [])]:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _STRIP.format(x)


@query("clean_text_basic", f"SELECT doc_id, length(c)::BIGINT AS n, md5(c) AS digest FROM (SELECT doc_id, {_duck_clean('text', False)} AS c FROM documents)")
def clean_text_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("c"))
    return c.select("doc_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


@query("clean_text_aggressive", f"SELECT doc_id, length(c)::BIGINT AS n, md5(c) AS digest FROM (SELECT doc_id, {_duck_clean('text', True)} AS c FROM documents)")
def clean_text_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text"), True).alias("c"))
    return c.select("doc_id", F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


_ROUGH = [
    (1, "phương phāp tōt ﬁrst ofﬀer ‘q’ “r” — a–b… x y​z"),
    (2, "meth-\nod and state-\n  of the art\nPage 3 of 10\nbody\n- 4 -\n3/10\n[7]\nend"),
    (3, "Copyright 2020 Someone\nkeep me\narXiv:1706.03762 v5\nUnder review at a place\nkeep, too\n\n\n\nlast  one"),
    (4, "see\nhttps://example.org/a?b=c\nme@example.org\nthe end,\nof it\tall"),
]


@query("clean_text_literals", f"SELECT id, {_duck_clean('t', False)} AS basic, {_duck_clean('t', True)} AS aggressive FROM {values_sql(['id', 't'], _ROUGH)}")
def clean_text_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(_ROUGH, "id int, t string")
    return df.select("id", T.clean_text(F.col("t")).alias("basic"), T.clean_text(F.col("t"), True).alias("aggressive"))


@query(
    "ocr_and_quote_maps",
    f"""SELECT id, translate(t, '{T.OCR_FROM}', '{T.OCR_TO}') AS fixed, regexp_replace(t, '([\\p{{L}}\\p{{N}}_])-\\n\\s*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS joined FROM {values_sql(['id', 't'], _ROUGH)}""",
)
def ocr_and_quote_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(_ROUGH, "id int, t string")
    return df.select("id", T.fix_ocr_diacritics(F.col("t")).alias("fixed"), T.dehyphenate(F.col("t")).alias("joined"))


def running_headers(sections: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, line) for lines of 4 to 119 characters that stand in at least ``least`` sections of a document."""
    lines = sections.select("doc_id", "section", F.explode(F.split("content", "\n")).alias("line")).select("doc_id", "section", T.strip(F.col("line")).alias("line"))
    kept = lines.where((F.length("line") > 3) & (F.length("line") < 120)).distinct()
    return kept.groupBy("doc_id", "line").agg(F.count("*").alias("sections")).where(F.col("sections") >= least)


_SECTIONS_SQL = "SELECT doc_id, i // 5 AS section, string_agg(l, chr(10) ORDER BY i) AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY doc_id, i // 5"


def pseudo_sections(docs: DataFrame, lines: int = 5) -> DataFrame:
    """(doc_id, section, content): every ``lines`` lines of a text."""
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l")).withColumn("section", F.expr(f"i div {lines}"))
    return line.groupBy("doc_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "l"))), lambda x: x.l), "\n").alias("content"))


@query(
    "running_header_lines",
    f"""WITH s AS ({_SECTIONS_SQL}), l AS (SELECT DISTINCT doc_id, section, {_STRIP.format('line')} AS line FROM (SELECT doc_id, section, unnest(string_split(content, chr(10))) AS line FROM s))
SELECT doc_id, line, count(*)::BIGINT AS sections FROM l WHERE length(line) > 3 AND length(line) < 120 GROUP BY ALL HAVING count(*) >= 3""",
)
def running_header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_headers(pseudo_sections(table(spark, sf_dir, "documents")))


_MOJI = """least(1.0, (n - length(regexp_replace(k, '[ÃÂÐÑ�]', '', 'g'))) / n::DOUBLE + 2.2 * greatest(0.0,
  (n - length(regexp_replace(k, '[À-ÿ]', '', 'g'))) / n::DOUBLE - (n - length(regexp_replace(k, '[^\\x{00}-\\x{FF}]', '', 'g'))) / n::DOUBLE))"""


@query(
    "noise_quality_scores",
    f"""WITH k AS (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS k, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS toks FROM documents),
t AS (SELECT doc_id, b, length(b) AS n, lower(b) AS low FROM (SELECT doc_id, trim(unnest(toks), '.,;:!?"''()[]{{}}<>|`~') AS b FROM k)),
f AS (SELECT doc_id, avg(CASE WHEN n > 0 AND (regexp_matches(b, '[ÃÂÐÑ�]') OR n - length(regexp_replace(b, '[À-ÿ]', '', 'g')) >= 2
  OR (n - length(regexp_replace(b, '\\p{{L}}', '', 'g')) > 0 AND ((length(regexp_replace(b, '\\p{{L}}', '', 'g')) - (n - length(regexp_replace(b, '\\p{{N}}', '', 'g')))) / n::DOUBLE > 0.35
   OR (n >= 8 AND NOT regexp_matches(low, '[aeiouyàáâãäåèéêëìíîïòóôõöùúûüýăđơưạ-ỹ]'))))) THEN 1.0 ELSE 0.0 END) AS noisy FROM t GROUP BY doc_id)
SELECT k.doc_id, round(m, 6) AS mojibake, round(coalesce(noisy, 0), 6) AS noisy, round(0.7 * m + 0.3 * coalesce(noisy, 0), 6) AS score
FROM (SELECT doc_id, CASE WHEN n > 0 THEN {_MOJI} ELSE 0.0 END AS m FROM (SELECT doc_id, k, length(k) AS n FROM k)) k LEFT JOIN f USING (doc_id)""",
)
def noise_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    both = table(spark, sf_dir, "documents").select("doc_id", T.mojibake_ratio(c).alias("m"), T.noisy_ratio(c).alias("n"))
    return both.select("doc_id", F.round("m", 6).alias("mojibake"), F.round("n", 6).alias("noisy"), F.round(T.ocr_score(F.col("m"), F.col("n")), 6).alias("score"))


_NAMES = [(1, "Nguyễn Văn Ánh"), (2, "  Crème   Brûlée "), (3, "Škoda Łódź ﬁn"), (4, "e\u0301t\u00e9 Ǆ")]
_PLAIN = [(1, "Nguyen Van Anh"), (2, "  Creme   Brulee "), (3, "Skoda Łodz fin"), (4, "ete DZ")]


@query("accent_strip_names", f"SELECT a.id, b.t AS kept_case, trim(regexp_replace(lower(b.t), '\\s+', ' ', 'g')) AS normal FROM {values_sql(['id', 't'], _NAMES)} JOIN (SELECT * FROM {values_sql(['id', 't'], _PLAIN)}) b USING (id)".replace("AS lit(id, t) JOIN", "AS a(id, t) JOIN"))
def accent_strip_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vietnamese, Slavic and decomposed letters and ligatures, against their plain forms written out."""
    df = spark.createDataFrame(_NAMES, "id int, t string")
    return df.select("id", T.strip_accents(F.col("t")).alias("kept_case"), T.normal_name(F.col("t")).alias("normal"))


@query(
    "running_headers_dropped",
    f"""WITH s AS ({_SECTIONS_SQL}), l AS (SELECT DISTINCT doc_id, section, {_STRIP.format('line')} AS line FROM (SELECT doc_id, section, unnest(string_split(content, chr(10))) AS line FROM s)),
f AS (SELECT doc_id, line FROM l WHERE length(line) > 3 AND length(line) < 120 GROUP BY ALL HAVING count(*) >= 3), g AS (SELECT doc_id, list(line) AS fs FROM f GROUP BY 1)
SELECT doc_id, section::BIGINT AS section, md5(coalesce(array_to_string(list_filter(string_split(content, chr(10)), lambda x: NOT list_contains(coalesce(fs, []), {_STRIP.format('x')})), chr(10)), '')) AS digest FROM s LEFT JOIN g USING (doc_id)""",
)
def running_headers_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each section without its document's running headers."""
    sections = pseudo_sections(table(spark, sf_dir, "documents"))
    furniture = running_headers(sections).groupBy("doc_id").agg(F.collect_list("line").alias("furniture"))
    none = F.array().cast("array<string>")
    kept = T.drop_lines(F.col("content"), F.coalesce("furniture", none))
    return sections.join(furniture, "doc_id", "left").select("doc_id", F.col("section").cast("long").alias("section"), F.md5(kept).alias("digest"))


@query("exact_duplicate_docs", "SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first_id, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents QUALIFY count(*) OVER (PARTITION BY md5(text)) > 1")
def exact_duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    groups = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return docs.join(groups, "h").select("doc_id", "first_id", "copies")


@query(
    "chunk_fixed_overlap",
    """SELECT doc_id, i::BIGINT AS chunk, length(substr(text, 3100 * i + 1, 3500))::BIGINT AS n, md5(substr(text, 3100 * i + 1, 3500)) AS digest
FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 3500) / 3100.0), 0)::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0)""",
)
def chunk_fixed_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.fixed_chunks(F.col("text"), 3500, 400)).alias("chunk", "c"))
    return chunks.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


def section_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, text): a title chunk and one chunk per filled section; the abstract only without both.

    docs: doc_id, title, abstract, sections array<struct<name, content>>.
    """
    title = docs.where("coalesce(title, '') <> ''").select("doc_id", F.lit(0).alias("chunk_id"), F.col("title").alias("text"))
    parts = docs.select("doc_id", F.posexplode("sections").alias("i", "s")).where("coalesce(s.content, '') <> ''")
    body = parts.select("doc_id", (F.col("i") + 1).alias("chunk_id"), F.concat_ws("\n", F.expr("nullif(s.name, '')"), "s.content").alias("text"))
    found = title.unionByName(body)
    # a title alone counts only where sections were given
    only_title = docs.where("size(sections) = 0").select("doc_id")
    found = found.join(only_title, "doc_id", "left_anti")
    spare = docs.where("size(sections) = 0").select("doc_id", F.lit(0).alias("chunk_id"), F.concat_ws("\n", F.expr("nullif(title, '')"), F.expr("nullif(abstract, '')")).alias("text"))
    return found.unionByName(spare.where("text <> ''"))


@query(
    "section_chunks_with_fallback",
    f"""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, substr(text, 1, 200) AS abstract FROM documents),
s AS (SELECT doc_id, section, content FROM ({_SECTIONS_SQL}) WHERE doc_id % 7 <> 0),
f AS (SELECT doc_id, 0 AS chunk_id, title AS text FROM d WHERE title <> '' AND doc_id % 7 <> 0
 UNION ALL SELECT doc_id, section + 1, 'Part ' || section || chr(10) || content FROM s WHERE content <> ''
 UNION ALL SELECT doc_id, 0, CASE WHEN title <> '' THEN title || chr(10) || abstract ELSE abstract END FROM d WHERE doc_id % 7 = 0)
SELECT doc_id, chunk_id::BIGINT AS chunk_id, md5(text) AS digest FROM f WHERE text <> ''""",
)
def section_chunks_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    parts = pseudo_sections(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "content"))).alias("p"))
    named = F.transform("p", lambda x: F.struct(F.concat(F.lit("Part "), x.section).alias("name"), x.content.alias("content")))
    nested = docs.join(parts, "doc_id").select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("title"), F.substring("text", 1, 200).alias("abstract"), F.when(F.col("doc_id") % 7 == 0, F.slice(named, 1, 0)).otherwise(named).alias("sections"))
    return section_chunks(nested).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.md5("text").alias("digest"))


@query(
    "local_count_search",
    """SELECT doc_id, chunk, hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, chunk) AS r FROM
(SELECT doc_id, i::BIGINT AS chunk, ((length(lower(l)) - length(replace(lower(l), 'the', ''))) // 3)::BIGINT AS hits FROM
 (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)) WHERE hits > 0) WHERE r <= 3""",
)
def local_count_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    hits = lines.select("doc_id", F.col("i").cast("long").alias("chunk"), T.count_of(F.col("l"), F.lit("the")).alias("hits")).where("hits > 0")
    order = Window.partitionBy("doc_id").orderBy(F.desc("hits"), "chunk")
    return hits.withColumn("r", F.row_number().over(order)).where("r <= 3").select("doc_id", "chunk", "hits")


@query(
    "search_recent_docs",
    """WITH d AS (SELECT doc_id, text FROM documents ORDER BY doc_id DESC LIMIT 30)
SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'tion', ''))) // 4)::BIGINT AS hits FROM d WHERE contains(lower(text), 'tion') ORDER BY hits DESC, doc_id LIMIT 10""",
)
def search_recent_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy(F.desc("doc_id")).limit(30)
    hits = newest.select("doc_id", T.count_of(F.col("text"), F.lit("tion")).alias("hits")).where("hits > 0")
    return hits.orderBy(F.desc("hits"), "doc_id").limit(10)


@query(
    "norm_text_and_escape",
    f"""SELECT doc_id, md5({_STRIP.format("regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')")}) AS normal,
  md5(regexp_replace(text, '([+\\-&|!(){{}}\\[\\]^"~*?:\\\\/])', '\\\\\\1', 'g')) AS escaped,
  md5(lower(regexp_replace(text, '[-_\\s]', '', 'g'))) AS entity FROM documents""",
)
def norm_text_and_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.squeeze(c)).alias("normal"), F.md5(T.escape_query(c)).alias("escaped"), F.md5(T.entity_key(c)).alias("entity"))


@query("accent_strip", f"SELECT doc_id, md5({_STRIP.format(chr(0)).replace(chr(0), 'regexp_replace(lower(strip_accents(text)), $$[ \\t\\n\\r\\f\\v]+$$, $$ $$, $$g$$)')}) AS normal FROM documents")
def accent_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normal_name(F.col("text"))).alias("normal"))


@query(
    "extractive_lead",
    f"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace({_STRIP.format('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')[1:6] AS s FROM documents),
e AS (SELECT doc_id, i, x, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY i) + i - 1 AS upto FROM (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM s)),
b AS (SELECT doc_id, min(i) AS over FROM e WHERE upto > 900 GROUP BY doc_id)
SELECT s.doc_id, md5(coalesce(string_agg(x, ' ' ORDER BY i), '')) AS digest FROM s LEFT JOIN b USING (doc_id) LEFT JOIN e ON e.doc_id = s.doc_id AND (over IS NULL OR i < over) GROUP BY s.doc_id""",
)
def extractive_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = table(spark, sf_dir, "documents").select("doc_id", T.lead_summary(F.col("text")).alias("t"))
    return lead.select("doc_id", F.md5("t").alias("digest"))


@query("token_estimate", "SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'))::BIGINT AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).cast("long").alias("tokens"))


@query(
    "quality_gate_by_label",
    """SELECT quality, count(*)::BIGINT AS docs, count(*) FILTER (length(trim(text)) >= 50)::BIGINT AS long_enough, round(avg((length(text) >= 200)::INT), 6) AS share,
CASE WHEN avg((length(text) >= 200)::INT) >= 0.98 THEN 'PASS' WHEN quality = 1 THEN 'FAIL' ELSE 'WARN' END AS verdict FROM documents JOIN labels USING (doc_id) GROUP BY quality""",
)
def quality_gate_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    found = joined.groupBy("quality").agg(F.count("*").alias("docs"), F.count_if(F.length(F.trim("text")) >= 50).alias("long_enough"), F.avg((F.length("text") >= 200).cast("int")).alias("s"))
    verdict = F.when(F.col("s") >= 0.98, "PASS").when(F.col("quality") == 1, "FAIL").otherwise("WARN")
    return found.select("quality", "docs", "long_enough", F.round("s", 6).alias("share"), verdict.alias("verdict"))
