"""The corpus pipeline: language, shared lines, near-duplicates, mixture, bins.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
it kept, and returns the columns of documents (the last: where each piece of
each document is packed).  Every stage is written as Parquet and read again.

Defined results: a row without text, or without a letter, goes at the language
stage; rows without an id are rows like others.  Rows that repeat an id and its
text are copies, of which the first by its other columns stays; different texts
under one id are different documents, and none is lost for its id.  Very long
texts are read whole.  A document whose lines are all shared goes on with an
empty text, and the last stage gives it no bin.  Ties go by id, then by text.  An
empty table gives an empty table at every stage; extra columns pass through, and
none clashes with a stage's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import langid, line_dedup, minhash, mixing, packing
from scriptorium.llm.columns import small
from scriptorium.plans.scratch import stored

#: The most repeated source is read so many times; every document at least once.
MAX_REPEATS = 1.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near enough to a language's centroid."""
    return langid.predict(docs, langid.fit(docs)).where("not rejected").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows the text."""
    found = line_dedup.dedup_lines(docs, min_docs=10)
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return found.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the least id."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 or doc_id is null")
    repeated = stored(ids.select(F.col("doc_id").alias("of"), F.lit(True).alias("repeated")), "repeated_ids")
    several = not repeated.isEmpty()
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("key"), F.col("text").alias("words"))
    if several:
        # an id that several rows have names none of them: each of its texts is a document of its own
        own = F.when(F.col("repeated"), F.xxhash64(F.lit("text of an id"), "key", "words")).otherwise(F.col("key"))
        keyed = stored(keyed.join(small(repeated), F.col("key").eqNullSafe(F.col("of")), "left").select("row", own.alias("key"), "words"), "keyed")
    found = stored(minhash.near_duplicates(keyed, id_col="key", text_col="words").select("key", "kept"), "near_duplicates")
    out = keyed.join(found.where("not kept").select("key").distinct(), "key", "left_anti")
    if several:
        one = F.col("row.doc_id").eqNullSafe(F.col("of"))
        first = out.join(small(repeated), one, "left_semi").groupBy("key").agg(F.min("row").alias("row"))
        out = out.join(small(repeated), one, "left_anti").select("key", "row").unionByName(first)
    return out.select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weight of its source asks for."""
    return mixing.mix(docs, max_repeats=MAX_REPEATS).select("row.*")


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin_id, bin_offset; repeats of a text never share a bin."""
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("bins", bins)]
#: Language identification and the near-duplicate search are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
