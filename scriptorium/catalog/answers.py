"""Question answering: groundedness, verdicts, answer classes, latency and summary metrics over conversations and events."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import strip
from scriptorium.registry import query

from .base import table, values_sql

#: What the SQL's \s stands for.
_SPACE = re.compile(r"[\t\n\f\r ]+")
#: A user turn is a question's context, the assistant turn after it the answer.
_QA = "SELECT a.conv_id, a.turn, u.text AS context, a.text AS answer FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'"


def _qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    questions = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    return answers.join(questions, ["conv_id", "turn"])


def answer_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([0-9a-zà-ỹ]+)"), 1), lambda t: F.length(t) >= 3))


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), 1))


def groundedness(answer: Column, context: Column) -> Column:
    """Share of the answer's tokens that the context has; 0 for an answer without tokens."""
    tokens = answer_tokens(answer)
    return F.when(F.size(tokens) > 0, F.size(F.array_intersect(tokens, answer_tokens(context))) / F.size(tokens)).otherwise(0.0)


def unsupported(answer: Column, context: Column) -> Column:
    """Share of the answer's sentences that are not part of the context; 0 without sentences."""
    parts = F.filter(F.transform(F.split(F.lower(answer), r"[.!?;\n]+"), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, F.size(F.filter(parts, lambda s: ~F.contains(F.lower(context), s))) / F.size(parts)).otherwise(0.0)


_TOK = "list_distinct(list_filter(regexp_extract_all(lower({}), '[0-9a-zà-ỹ]+'), lambda t: length(t) >= 3))"
_GROUND = f"""SELECT conv_id, turn, context, answer, CASE WHEN len(t) > 0 THEN len(list_intersect(t, {_TOK.format('context')})) / len(t)::DOUBLE ELSE 0.0 END AS g, CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: NOT contains(lower(context), x))) / len(s)::DOUBLE ELSE 0.0 END AS h
FROM (SELECT *, {_TOK.format('answer')} AS t, list_filter(list_transform(regexp_split_to_array(lower(answer), '[.!?;\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM ({_QA}))"""


@query("groundedness", f"SELECT conv_id, turn, round(g, 4) AS grounded, round(h, 4) AS hallucinated FROM ({_GROUND})")
def groundedness_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = F.col("answer"), F.col("context")
    return _qa(spark, sf_dir).select("conv_id", "turn", F.round(groundedness(a, c), 4).alias("grounded"), F.round(unsupported(a, c), 4).alias("hallucinated"))


@query("unsupported_numbers", f"SELECT conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(answer, '\\d+(?:[.,]\\d+)?')), lambda x: NOT list_contains(regexp_extract_all(context, '\\d+(?:[.,]\\d+)?'), x)))::BIGINT AS n FROM ({_QA})")
def unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qa(spark, sf_dir).select("conv_id", "turn", F.size(F.array_except(numbers(F.col("answer")), numbers(F.col("context")))).cast("long").alias("n"))


def verdict(recall: Column, grounded: Column, precision: Column, length: Column, hallucinated: Column) -> Column:
    """struct<score, verdict>: 0.40 recall + 0.25 grounded + 0.20 precision + 0.15 length."""
    score = 0.40 * recall + 0.25 * grounded + 0.20 * precision + 0.15 * length
    return F.struct(score.alias("score"), F.when((score >= 0.75) & (hallucinated <= 0.20), "PASS").when(score >= 0.55, "WARN").otherwise("FAIL").alias("verdict"))


@query(
    "rag_verdict",
    f"""SELECT conv_id, turn, round(s, 4) AS score, CASE WHEN s >= 0.75 AND h <= 0.20 THEN 'PASS' WHEN s >= 0.55 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM
(SELECT conv_id, turn, h, 0.40 * (conv_id % 3 > 0)::INT + 0.25 * g + 0.20 * (conv_id % 4) / 3.0 + 0.15 * least(1.0, length(trim(answer)) / 80.0) AS s FROM ({_GROUND}))""",
)
def rag_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = F.col("answer"), F.col("context")
    v = verdict((F.col("conv_id") % 3 > 0).cast("int"), groundedness(a, c), (F.col("conv_id") % 4) / 3.0, F.least(F.lit(1.0), F.length(F.trim(a)) / 80.0), unsupported(a, c))
    return _qa(spark, sf_dir).select("conv_id", "turn", v.alias("v")).select("conv_id", "turn", F.round("v.score", 4).alias("score"), "v.verdict")


# What says that a question is not answered.
REFUSALS = r"không\s+(thể|co)\s+trả\s+lời|không\s+đủ\s+thông\s+tin|không\s+tìm\s+thấy|không\s+có\s+thông\s+tin|chưa\s+có\s+dữ\s+liệu|\bcannot\s+answer\b|\binsufficient\s+information\b"


def answer_body(c: Column) -> Column:
    """The answer before its list of sources."""
    return strip(F.regexp_replace(c, r"(?is)(\bnguồn\b|\bsource\b)\s*:.*$", ""))


def answer_class(c: Column) -> Column:
    body = answer_body(F.coalesce(c, F.lit("")))
    return F.when(body == "", "empty").when(F.lower(body).rlike(REFUSALS), "not_answered").otherwise("answered")


_ANSWERS = [(1, "a", "", 0), (2, "a", "I cannot answer this", 0), (3, "a", "Yes.\nSource: doc1", 1), (4, "b", "insufficient information here", 1), (5, "b", "Source: x", 1), (6, "b", "Không tìm thấy", 0), (7, "b", "Plain answer", 1)]
_CLASS = f"CASE WHEN b = '' THEN 'empty' WHEN regexp_matches(lower(b), '{REFUSALS}') THEN 'not_answered' ELSE 'answered' END"
_BODY = f"(SELECT id, sys, ok, trim(regexp_replace(t, '(?is)(\\bnguồn\\b|\\bsource\\b)\\s*:.*$', ''), ' ' || chr(10)) AS b, t FROM {values_sql(['id', 'sys', 't', 'ok'], _ANSWERS)})"


@query("answerability_rates", f"SELECT sys, count(*)::BIGINT AS n, round(count(*) FILTER (k = 'answered') / count(*)::DOUBLE, 6) AS answered, round(count(*) FILTER (k = 'not_answered') / count(*)::DOUBLE, 6) AS not_answered, round(count(*) FILTER (k = 'empty') / count(*)::DOUBLE, 6) AS empty FROM (SELECT sys, {_CLASS} AS k FROM {_BODY}) GROUP BY sys")
def answerability_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = spark.createDataFrame(_ANSWERS, "id int, sys string, t string, ok int").select("sys", answer_class(F.col("t")).alias("k"))
    rates = [F.round(F.count_if(F.col("k") == v) / F.count("*"), 6).alias(v) for v in ("answered", "not_answered", "empty")]
    return k.groupBy("sys").agg(F.count("*").alias("n"), *rates)


@query(
    "citation_class_rates",
    f"""SELECT sys, round(c / n, 6) AS correct, round(w / n, 6) AS wrong, round(o / n, 6) AS none, round(c / n - w / n, 6) AS grounded, round(least(1, greatest(0, 1 - w / n - 0.5 * o / n)), 6) AS score FROM
(SELECT sys, count(*)::DOUBLE AS n, count(*) FILTER (s AND ok = 1) AS c, count(*) FILTER (s AND ok = 0) AS w, count(*) FILTER (NOT s) AS o FROM (SELECT sys, ok, regexp_matches(t, '(?i)source\\s*:') AS s FROM {_BODY}) GROUP BY sys)""",
)
def citation_class_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_ANSWERS, "id int, sys string, t string, ok int").withColumn("s", F.col("t").rlike(r"(?i)source\s*:"))
    n = F.count("*")
    r = rows.groupBy("sys").agg((F.count_if(F.col("s") & (F.col("ok") == 1)) / n).alias("c"), (F.count_if(F.col("s") & (F.col("ok") == 0)) / n).alias("w"), (F.count_if(~F.col("s")) / n).alias("o"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.col("w") - 0.5 * F.col("o")))
    return r.select("sys", F.round("c", 6).alias("correct"), F.round("w", 6).alias("wrong"), F.round("o", 6).alias("none"), F.round(F.col("c") - F.col("w"), 6).alias("grounded"), F.round(score, 6).alias("score"))


@query("latency_percentiles", "SELECT event_type, count(*)::BIGINT AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"))


@query("module_rollup", "SELECT coalesce(module, 'all') AS module, coalesce(sys, 'all') AS sys, coalesce(kind, 'all') AS kind, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM (SELECT 'm' || user_id % 3 AS module, 's' || event_id % 2 AS sys, event_type AS kind, value FROM events) GROUP BY ROLLUP (module, sys, kind)")
def module_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.col("user_id") % 3).alias("module"), F.concat(F.lit("s"), F.col("event_id") % 2).alias("sys"), F.col("event_type").alias("kind"), "value")
    names = ["module", "sys", "kind"]
    return e.rollup(*names).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(*[F.coalesce(c, F.lit("all")).alias(c) for c in names], "n", "mean")


@query("mean_metrics", "SELECT event_type AS mode, round(avg(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END), 6) AS metric, count(*)::BIGINT AS n FROM events GROUP BY 1")
def mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing metric counts as 0 over all rows."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("metric"))
    return e.groupBy("mode").agg(F.round(F.avg(F.coalesce("metric", F.lit(0.0))), 6).alias("metric"), F.count("*").alias("n"))


_RATINGS = [("d1", "lead", "4", "5"), ("d2", "lead", "x", "3"), ("d3", "lead", "2", "3"), ("d4", "llm", "5", "5"), ("d5", "llm", "6", "1"), ("d6", "llm", None, "2"), ("d7", "llm", "3", "4.5")]


@query("human_eval_avg", f"SELECT mode, count(*)::BIGINT AS n, round(avg(a), 6) AS fluency, round(avg(b), 6) AS coverage, round((avg(a) + avg(b)) / 2, 6) AS overall FROM (SELECT mode, try_cast(f AS DOUBLE) AS a, try_cast(c AS DOUBLE) AS b FROM {values_sql(['doc_id', 'mode', 'f', 'c'], _RATINGS)}) WHERE a BETWEEN 1 AND 5 AND b BETWEEN 1 AND 5 GROUP BY mode")
def human_eval_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame(_RATINGS, "doc_id string, mode string, f string, c string").select("mode", F.col("f").try_cast("double").alias("a"), F.col("c").try_cast("double").alias("b"))
    valid = r.where("a BETWEEN 1 AND 5 AND b BETWEEN 1 AND 5")
    return valid.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("fluency"), F.round(F.avg("b"), 6).alias("coverage"), F.round((F.avg("a") + F.avg("b")) / 2, 6).alias("overall"))


def rouge_n(answers: pd.Series, contexts: pd.Series, sizes: Sequence[int] = (1, 2)) -> pd.DataFrame:
    """F1 of clipped n-gram counts of lower-cased texts, a column for each size; linear in the words."""

    def counted(words: list[str], n: int) -> Counter:
        return Counter(words if n == 1 else zip(*[words[i:] for i in range(n)], strict=False))

    def one(a: list[str], b: list[str], n: int) -> float:
        x, y = counted(a, n), counted(b, n)
        few, many = (x, y) if len(x) <= len(y) else (y, x)
        total = max(0, len(a) - n + 1) + max(0, len(b) - n + 1)
        return 2.0 * sum(min(c, many[g]) for g, c in few.items() if g in many) / total if total else 0.0

    rows = []
    for a, b in zip(answers, contexts, strict=True):
        x, y = _SPACE.split(a or ""), _SPACE.split(b or "")
        x, y = [w for w in x if w], [w for w in y if w]
        rows.append([one(x, y, n) for n in sizes])
    return pd.DataFrame(rows, columns=[f"rouge_{n}" for n in sizes], dtype="float64")


ROUGE_SQL = (
    "WITH q AS (" + _QA + "), " + ", ".join(
        f"{p}{n} AS (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS g FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda x: x <> '') AS w FROM q)) GROUP BY ALL)"
        for p, c in (("a", "answer"), ("b", "context")) for n in (1, 2)
    ) + ", " + ", ".join(
        f"s{n} AS (SELECT q.conv_id, q.turn, coalesce(m.n, 0) AS m, coalesce(x.n, 0) + coalesce(y.n, 0) AS t FROM q LEFT JOIN (SELECT a{n}.conv_id, a{n}.turn, sum(least(a{n}.n, b{n}.n)) AS n FROM a{n} JOIN b{n} USING (conv_id, turn, g) GROUP BY ALL) m USING (conv_id, turn) LEFT JOIN (SELECT conv_id, turn, sum(n) AS n FROM a{n} GROUP BY ALL) x USING (conv_id, turn) LEFT JOIN (SELECT conv_id, turn, sum(n) AS n FROM b{n} GROUP BY ALL) y USING (conv_id, turn))"
        for n in (1, 2)
    ) + " SELECT conv_id, turn, round(CASE WHEN s1.t > 0 THEN 2.0 * s1.m / s1.t ELSE 0 END, 6) AS rouge_1, round(CASE WHEN s2.t > 0 THEN 2.0 * s2.m / s2.t ELSE 0 END, 6) AS rouge_2 FROM s1 JOIN s2 USING (conv_id, turn)"
)


def rouge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer's n-grams are counted once, in Arrow batches cut into slices of few rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = rouge_n(part.column(2).to_pandas(), part.column(3).to_pandas())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(found[c]) for c in found]], names=["conv_id", "turn", *found])

    q = _qa(spark, sf_dir).select("conv_id", "turn", F.lower("answer").alias("a"), F.lower("context").alias("b"))
    kinds = dict(q.dtypes)
    scores = q.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, rouge_1 double, rouge_2 double")
    return scores.select("conv_id", "turn", *[F.round(f"rouge_{n}", 6).alias(f"rouge_{n}") for n in (1, 2)])


@query("rouge_1_2", ROUGE_SQL)
def rouge_1_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rouge_scores(spark, sf_dir)


@query("rouge_l")
def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of the longest common subsequence; the subsequence is a per-row Arrow function."""

    @F.pandas_udf("double")
    def score(answers: pd.Series, contexts: pd.Series) -> pd.Series:
        def one(a: list[str], b: list[str]) -> float:
            row = [0] * (len(b) + 1)
            for x in a:
                before = 0
                for j, y in enumerate(b, 1):
                    before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
            return 2.0 * row[-1] / (len(a) + len(b)) if a or b else 0.0

        return pd.Series([one((a or "").lower().split(), (b or "").lower().split()) for a, b in zip(answers, contexts, strict=True)])

    return _qa(spark, sf_dir).select("conv_id", "turn", F.round(score("answer", "context"), 6).alias("rouge_l"))


@query("sanitize_output", f"SELECT id, trim(regexp_replace(regexp_replace(t, '(?s)^.*(?:Final answer:|Answer:)', ''), '(?im)^(?:let me think|reasoning:)[^\\n]*\\n?', '', 'g'), ' ' || chr(10)) AS body FROM {values_sql(['id', 't'], [(1, 'Reasoning: x' + chr(10) + 'Answer: yes'), (2, 'let me think' + chr(10) + 'plain'), (3, 'a Final answer: b')])}")
def sanitize_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(1, "Reasoning: x\nAnswer: yes"), (2, "let me think\nplain"), (3, "a Final answer: b")], "id int, t string")
    tail = F.regexp_replace("t", r"(?s)^.*(?:Final answer:|Answer:)", "")
    return df.select("id", strip(F.regexp_replace(tail, r"(?im)^(?:let me think|reasoning:)[^\n]*\n?", "")).alias("body"))


_SUMMARY = [(1, "1. Goal: a\n2. Method: b\n3. Result: c"), (2, "- x\n- y"), (3, "para one\n\npara two"), (4, "single")]


@query("parse_summary_sections", f"""SELECT id, len(CASE WHEN len(regexp_extract_all(t, '(?m)^\\d+\\.\\s')) >= 2 THEN regexp_extract_all(t, '(?m)^\\d+\\.\\s') WHEN len(regexp_extract_all(t, '(?m)^[-*]\\s')) >= 2 THEN regexp_extract_all(t, '(?m)^[-*]\\s') ELSE list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda x: x <> '') END)::BIGINT AS n FROM {values_sql(['id', 't'], _SUMMARY)}""")
def parse_summary_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    numbered, bullets = F.filter(F.split(t, r"(?m)^\d+\.\s"), lambda x: strip(x) != ""), F.filter(F.split(t, r"(?m)^[-*]\s"), lambda x: strip(x) != "")
    many = lambda p: F.size(F.regexp_extract_all(t, F.lit(f"({p})"), 1)) >= 2
    parts = F.when(many(r"(?m)^\d+\.\s"), numbered).when(many(r"(?m)^[-*]\s"), bullets).otherwise(F.filter(F.split(t, r"\n\s*\n"), lambda x: x != ""))
    return spark.createDataFrame(_SUMMARY, "id int, t string").select("id", F.size(parts).cast("long").alias("n"))


@query("structured_summary", f"SELECT id, upper(k) AS section, trim(v) AS content FROM (SELECT id, regexp_extract(l, '^\\d+\\.\\s*([A-Za-z]+):', 1) AS k, regexp_extract(l, '^\\d+\\.\\s*[A-Za-z]+:(.*)$', 1) AS v FROM (SELECT id, unnest(string_split(t, chr(10))) AS l FROM {values_sql(['id', 't'], _SUMMARY)})) WHERE k <> ''")
def structured_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame(_SUMMARY, "id int, t string").select("id", F.explode(F.split("t", "\n")).alias("l"))
    k, v = F.regexp_extract("l", r"^\d+\.\s*([A-Za-z]+):", 1), F.regexp_extract("l", r"^\d+\.\s*[A-Za-z]+:(.*)$", 1)
    return lines.select("id", F.upper(k).alias("section"), strip(v).alias("content")).where("section <> ''")
