"""Sections, tables, figures, formulas, references and authors, over literal fixtures and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import structure as S
from scriptorium.functions.text import strip
from scriptorium.registry import query

from .base import table, values_sql

_LINES = [(1, "1. Introduction"), (2, "2.3 RELATED WORK"), (3, "Conclusion and Future Work"), (4, "we propose a thing."), (5, "Results"), (6, "x = y + 1"), (7, "IV. Evaluation of Models"), (8, "A. Proposed Method"), (9, "ab"), (10, "JOURNAL OF THINGS"), (11, "ALL CAPS HEADING"), (12, "References."), (13, "Phương pháp"), (14, "3.2.1 Deep Network"), (15, "plain words here")]


def _lit(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_TYPE_SQL = "'other'"
for _w in sorted(S.SECTION_TYPES, key=lambda w: (len(w), w)):
    _TYPE_SQL = f"CASE WHEN contains(p, '{_w}') THEN '{S.SECTION_TYPES[_w]}' ELSE {_TYPE_SQL} END"


@query("infer_section_type", f"SELECT id, {_TYPE_SQL} AS section_type, greatest(len(string_split(regexp_extract(t, '^(\\d+(?:\\.\\d+)?(?:\\.\\d+)?)', 1), '.')), 1)::BIGINT AS level FROM (SELECT id, t, trim(regexp_replace(regexp_replace(lower(t), '^\\d+[\\.\\d]*\\s*', ''), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')) AS p FROM {values_sql(['id', 't'], _LINES)})")
def infer_section_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lit(spark, _LINES, "id int, t string").select("id", S.section_type(F.col("t")).alias("section_type"), S.heading_level(F.col("t")).cast("long").alias("level"))


_NO = " OR ".join(f"starts_with(lower(s), '{p}')" for p in S.NO_HEADING)
_HEADINGS = ", ".join(f"'{h}'" for h in S.HEADINGS)


@query(
    "heading_rules",
    f"""SELECT id, length(s) BETWEEN 3 AND 120 AND regexp_matches(s, '\\p{{L}}') AND NOT ({_NO}) AND NOT regexp_matches(s, '[=+*<>]') AND NOT (regexp_matches(s, '[.,;:]$') AND trim(lower(s), '.') NOT IN ('references', 'tài liệu tham khảo'))
AND (regexp_matches(s, '^(?:\\d+\\.(?:\\d+\\.?)*)\\s+[^\\n]{{2,}}') OR regexp_matches(s, '^\\d+\\s+[A-ZĐ][^\\n]{{2,}}') OR regexp_matches(s, '^(?:[IVXLCDM]+\\.)\\s+[^\\n]{{2,}}') OR regexp_matches(s, '^[A-Z]\\.\\s+[A-ZĐ][^\\n]{{2,}}') OR lower(s) IN ({_HEADINGS})
 OR (regexp_matches(s, '\\p{{Lu}}') AND NOT regexp_matches(s, '[\\p{{Ll}}\\p{{Lo}}]') AND contains(s, ' '))) AS heading FROM (SELECT id, trim(t) AS s FROM {values_sql(['id', 't'], _LINES)})""",
)
def heading_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lit(spark, _LINES, "id int, t string").select("id", S.is_heading(F.col("t")).alias("heading"))


_PAPER = [(1, "Abstract\nWe study many things in this work.\n1. Introduction\nIntro text that is long enough to keep.\n1.1 Background\nMore text that is long enough to keep.\nReferences\n[1] A. Author. A title. 2019. doi 10.1234/abc.5\n[2] B. Author. Another title, 2020."), (2, "no headings at all\n\nsecond block of text that has more than fifty characters in it, surely\n\nthird")]


@query("section_split_headings")
def section_split_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading starts a section; sections keep at least 20 characters; the parent is the nearest earlier lower level."""
    lines = _lit(spark, _PAPER, "id int, t string").select("id", F.posexplode(F.split("t", "\n")).alias("i", "line")).withColumn("h", S.is_heading(F.col("line")))
    order = Window.partitionBy("id").orderBy("i")
    part = lines.withColumn("part", F.sum(F.col("h").cast("int")).over(order))
    body = part.groupBy("id", "part").agg(F.max(F.when(F.col("h"), F.col("line"))).alias("name"), F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("i", "line", "h"))), lambda x: ~x.h), lambda x: x.line), "\n").alias("content"))
    kept = body.where("name is not null").where(F.length(strip(F.col("content"))) >= 20).withColumn("level", S.heading_level(F.col("name")))
    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(*[F.when(F.col("level") > v, F.last(F.when(F.col("level") == v, F.col("name")), ignorenulls=True).over(before)) for v in (2, 1)])
    return kept.withColumn("parent", above).select("id", (F.row_number().over(Window.partitionBy("id").orderBy("part")) - 1).alias("ord"), "name", "level", S.section_type(F.col("name")).alias("section_type"), "parent", "content")


@query("paragraph_split", f"SELECT id, substr(string_split(b, chr(10))[1], 1, 80) AS name, length(b)::BIGINT AS n FROM (SELECT id, trim(unnest(regexp_split_to_array(t, '\\n\\s*\\n')), ' ' || chr(10)) AS b FROM {values_sql(['id', 't'], _PAPER)}) WHERE length(b) >= 50")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _lit(spark, _PAPER, "id int, t string").select("id", F.explode(S.paragraphs(F.col("t"))).alias("p"))
    return p.select("id", "p.name", F.length("p.content").cast("long").alias("n"))


@query("reference_parse", f"SELECT id, raw, nullif(regexp_extract(raw, '\\b((?:19|20)\\d{{2}})\\b', 1), '')::BIGINT AS year, regexp_extract(raw, '(10\\.\\d{{4,9}}/[^\\s,;]+)', 1) AS doi FROM (SELECT id, trim(regexp_replace(unnest(regexp_split_to_array(regexp_extract(t, '(?is)(?:^|\\n)\\s*references\\s*\\n(.*)$', 1), '(?:^|\\n)\\s*(?:\\[\\d+\\]|\\d+\\.)\\s+')), '\\s+', ' ', 'g')) AS raw FROM {values_sql(['id', 't'], _PAPER)}) WHERE raw <> ''")
def reference_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lit(spark, _PAPER, "id int, t string").select("id", F.explode(S.references(F.col("t"))).alias("r"))
    return r.select("id", "r.raw", F.col("r.year").cast("long").alias("year"), "r.doi")


_CELLS = [(1, "73.2%"), (2, "3.14"), (3, "17.6e9"), (4, "1e5"), (5, "42"), (6, "-7"), (7, "N/A"), (8, "--"), (9, ""), (10, " BERT  base "), (11, "***"), (12, "+1.5 %"), (13, "12a"), (14, "none")]


@query(
    "table_cell_types",
    f"""WITH c AS (SELECT id, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t FROM {values_sql(['id', 't'], _CELLS)}),
k AS (SELECT id, t, CASE WHEN t = '' OR regexp_matches(t, '{S.NULL_CELL}') THEN 'null' WHEN regexp_matches(t, '{S.PERCENT}') THEN 'percent' WHEN regexp_matches(t, '{S.FLOAT}') OR regexp_matches(t, '{S.SCIENTIFIC}') THEN 'float' WHEN regexp_matches(t, '{S.INTEGER}') THEN 'int' ELSE 'string' END AS kind FROM c)
SELECT id, kind, CASE kind WHEN 'percent' THEN round(try_cast(regexp_extract(t, '{S.PERCENT}', 1) AS DOUBLE) / 100, 6) WHEN 'float' THEN try_cast(t AS DOUBLE) WHEN 'int' THEN try_cast(t AS DOUBLE) END AS num, CASE WHEN kind = 'string' THEN t END AS str FROM k""",
)
def table_cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lit(spark, _CELLS, "id int, t string").select("id", F.inline(F.array(S.cell(F.col("t")))))


@query("table_headers_fix")
def table_headers_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, ["Method", "84.2"], [["a", "1"]]), (2, [], [["Model", "F1"], ["b", "2"]]), (3, ["1", "2.5"], [["3", "4"]]), (4, [], []), (5, ["-", "n/a"], [["x", "y"]])]
    fixed = _lit(spark, rows, "id int, headers array<string>, data array<array<string>>").select("id", S.fix_headers(F.col("headers"), F.col("data")).alias("f"))
    return fixed.select("id", F.concat_ws("|", "f.headers").alias("headers"), F.size("f.data").alias("n_rows"))


_CAPTIONS = [(1, "Figure 3: Overview of the proposed architecture", "image"), (2, "Fig. 2 — Training loss curve on CIFAR-10", "image"), (3, "Confusion matrix of results", "image"), (4, "A photo of us", "photo"), (5, "", "chart"), (6, "Table 1: BLEU scores comparison on WMT14 dataset, F1 and kg", "image"), (7, "x" * 130, "image")]
_FIG = "CASE WHEN coalesce(kind, '') IN ('', 'image') THEN 'image' ELSE kind END"
for _k in reversed(S.FIGURE_WORDS):
    _FIG = "CASE WHEN " + " OR ".join(f"contains(lower(c), '{w}')" for w in S.FIGURE_WORDS[_k]) + f" THEN '{_k}' ELSE {_FIG} END"
_CAP = f"SELECT id, kind, trim(regexp_replace(trim(regexp_replace(trim(c), '(?i)^(fig(ure)?\\.?\\s*\\d+[.:\\-—\\s]+)', '')), '^[:\\-—\\s]+', '')) AS c FROM {values_sql(['id', 'c', 'kind'], _CAPTIONS)}"


@query("figure_type", f"SELECT id, c AS caption, {_FIG} AS figure_type, upper(({_FIG})[1]) || ({_FIG})[2:] || CASE WHEN c = '' THEN ' from paper' ELSE ': ' || CASE WHEN length(c) <= 120 THEN c ELSE substr(c, 1, 117) || '...' END END AS alt_text FROM ({_CAP})")
def figure_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _lit(spark, _CAPTIONS, "id int, c string, kind string").select("id", S.clean_caption(F.col("c")).alias("caption"), "kind")
    c = c.select("id", "caption", S.figure_type(F.col("caption"), F.col("kind")).alias("figure_type"))
    return c.withColumn("alt_text", S.alt_text(F.col("caption"), F.col("figure_type")))


def _stop(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(
    "keyword_extract",
    f"""SELECT id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:10], ' ') AS keywords FROM (SELECT id, list_filter(regexp_extract_all(lower(c), '[a-zA-Z][a-zA-Z0-9\\-]*'), lambda x: NOT list_contains({_stop(S.STOP_WORDS)}, x) AND (length(x) > 2 OR list_contains({_stop(S.SHORT_TERMS)}, x))) AS w FROM {values_sql(['id', 'c', 'kind'], _CAPTIONS)})""",
)
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lit(spark, _CAPTIONS, "id int, c string, kind string").select("id", F.array_join(S.caption_keywords(F.col("c"), S.SHORT_TERMS), " ").alias("keywords"))


_MATH = [(1, "\\frac{1}{2} \\alpha + \\beta", "equation"), (2, "\\begin{pmatrix}a & b\\end{pmatrix}", "block"), (3, "<math display=\"block\"><mi>x</mi></math>", "inline"), (4, "x := y", "inline"), (5, "a \\\\ b", "inline"), (6, "x + y", "odd"), (7, "$ A  + B $", "inline"), (8, "\\sqrt{x} \\leq \\infty", "inline")]


def _plain_sql(x: str) -> str:
    for a, b in S.PLAIN_MATH:
        x = f"regexp_replace({x}, '{a}', '{b.replace('$', chr(92))}', 'g')"
    return x


@query(
    "formula_classify",
    f"""SELECT id, CASE WHEN regexp_matches(raw, '<math|<mrow|<mi') THEN 'mathml' WHEN regexp_matches(raw, '[\\\\$]') THEN 'latex' ELSE 'unknown' END AS format,
CASE WHEN regexp_matches(raw, '<math|<mrow|<mi') THEN CASE WHEN regexp_matches(raw, 'display=["'']block["'']') THEN 'block' ELSE 'inline' END WHEN regexp_matches(raw, '{'|'.join(S.DEFINITION_SIGNS)}') THEN 'definition' WHEN regexp_matches(raw, '{'|'.join(S.MATRIX_SIGNS)}') THEN 'matrix' WHEN regexp_matches(raw, '{'|'.join(S.SYSTEM_SIGNS)}') THEN 'system'
 WHEN kind IN ('equation', 'block', 'inline', 'matrix', 'system', 'definition') THEN kind ELSE 'inline' END AS formula_type, substr(trim({_plain_sql('raw')}), 1, 200) AS display, lower(trim(regexp_replace(raw, '\\s+', '', 'g'), '$')) AS key FROM {values_sql(['id', 'raw', 'kind'], _MATH)}""",
)
def formula_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return _lit(spark, _MATH, "id int, raw string, kind string").select("id", S.formula_format(raw).alias("format"), S.formula_type(raw, F.col("kind")).alias("formula_type"), S.formula_text(raw).alias("display"), S.formula_key(raw).alias("key"))


_MATH_TEXT = [(1, "Let $x+1$ and $$a = b$$ with $y$ but \\begin{equation}c $z$\\end{equation} end."), (2, "no math"), (3, "$$p$$ $$q$$")]


@query("formula_extract", f"SELECT id, array_to_string(regexp_extract_all(t, '(?s)\\$\\$(.+?)\\$\\$', 1), '|') AS blocks, array_to_string(regexp_extract_all(regexp_replace(t, '(?is)\\\\begin\\{{equation\\*?\\}}.+?\\\\end\\{{equation\\*?\\}}|\\$\\$.+?\\$\\$', ' ', 'g'), '(?s)\\$([^$]+?)\\$', 1), '|') AS inlines FROM {values_sql(['id', 't'], _MATH_TEXT)}")
def formula_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _lit(spark, _MATH_TEXT, "id int, t string").select("id", F.array_join(S.block_formulas(t), "|").alias("blocks"), F.array_join(S.inline_formulas(t), "|").alias("inlines"))


@query("author_clean")
def author_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, ["John Smith1,*", "john smith†", "Smith, J. A.", "N/A", "12"]), (2, ["Nguyễn Văn An", "HNG MN", "a b", "Jane Doe email: x@y.z", "Xã Hội Học Viện"]), (3, []), (4, ["John Smith", "JOHN SMITH", "Unknown", "Lee, K"])]
    return _lit(spark, rows, "id int, a array<string>").select("id", F.array_join(S.clean_authors(F.col("a")), "; ").alias("authors"))


@query("author_valid_top10", "SELECT lower(c_mktsegment) AS author, max(n)::BIGINT AS n FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL) GROUP BY 1 ORDER BY n DESC, author LIMIT 10")
def author_valid_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").count()
    valid = n.where((F.length("c_mktsegment") <= 60) & ~F.col("c_mktsegment").rlike(r"[\d@]"))
    return valid.groupBy(F.lower("c_mktsegment").alias("author")).agg(F.max("count").alias("n")).orderBy(F.desc("n"), "author").limit(10)


_NAMES = [(1, "Figure 3"), (2, "[1, 2]"), (3, "abc"), (4, "ImageNet"), (5, "Table II"), (6, "1234"), (7, "Bảng 2"), (8, " glue benchmark ")]


@query("noise_evidence", f"SELECT id, length(s) < 4 OR regexp_matches(s, '^\\s*[\\[(]\\s*[\\d,;\\s]+\\s*[\\])]\\s*$') OR NOT regexp_matches(s, '[a-zA-ZÀ-ỹ]') OR regexp_matches(s, '(?i)^(hình|figure|fig|bảng|table|tbl|phụ lục|appendix|sơ đồ|chart)\\s*[\\d_\\-.a-z]*$') AS noise FROM (SELECT id, trim(t) AS s FROM {values_sql(['id', 't'], _NAMES)})")
def noise_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lit(spark, _NAMES, "id int, t string").select("id", S.noise_evidence(F.col("t")).alias("noise"))


_KINDS = [(1, "method|algorithm"), (2, "study|experiment"), (3, "study| model"), (4, None), (5, "tourism_model"), (6, "Methodology"), (7, "results"), (8, "Experiment setup")]
_ALLOWED = ["method", "model", "algorithm", "task", "framework", "architecture", "theory", "dataset"]
_CONF = "0.65"
for _k in reversed(S.SECTION_CONFIDENCE):
    _CONF = f"CASE WHEN starts_with(trim(lower(coalesce(t, ''))), '{_k}') THEN {S.SECTION_CONFIDENCE[_k]} ELSE {_CONF} END"


@query("category_resolve", f"SELECT id, coalesce(list_filter(list_transform(string_split(coalesce(t, ''), '|'), lambda x: trim(x)), lambda x: list_contains({_stop(_ALLOWED)}, x))[1], 'concept') AS category, {_CONF}::DOUBLE AS confidence FROM {values_sql(['id', 't'], _KINDS)}")
def category_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lit(spark, _KINDS, "id int, t string").select("id", S.resolve_part(F.col("t"), _ALLOWED, "concept").alias("category"), S.section_confidence(F.col("t")).alias("confidence"))


_VENUES = [(1, "Proceedings of ACL"), (2, "arXiv preprint"), (3, "Nature"), (4, "A Workshop on Things"), (5, "NAACL")]


@query("venue_type", f"SELECT id, CASE WHEN regexp_matches(lower(t), 'conference|proceedings|workshop|acl|emnlp|naacl|coling') THEN 'conference' WHEN regexp_matches(lower(t), 'arxiv|preprint') THEN 'preprint' ELSE 'journal' END AS venue FROM {values_sql(['id', 't'], _VENUES)}")
def venue_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lit(spark, _VENUES, "id int, t string").select("id", S.venue_type(F.col("t")).alias("venue"))


@query("html_generic_metadata", "SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*\\slang=\"([^\"]*)\"', 1) AS lang, length(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1))::BIGINT AS h1 FROM pages")
def html_generic_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(h, r'(?i)<html[^>]*\slang="([^"]*)"', 1).alias("lang"), F.length(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1)).cast("long").alias("h1"))


@query("html_text_blocks")
def html_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, block, tag, n_chars): headings, paragraphs and list items of each page's article, in order."""
    from scriptorium.sources.html import text_blocks

    blocks = text_blocks(table(spark, sf_dir, "pages").select("page_id", "html"))
    return blocks.select("page_id", "block", "tag", F.length("text").alias("n_chars"))
