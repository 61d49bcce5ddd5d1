"""Line dedup: lines whose key many documents share lose all their occurrences.

DataFrame functions only.  A line's key is the line stripped of
``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased, held as a 128-bit hash.
Only (document, hash) rows are counted, pre-aggregated before each shuffle; the
text itself moves once, to meet the positions of its own document's dropped
lines, and is put together again by position.

Defined results: null or empty text is one empty line.  Documents are told
apart by doc_id; rows that repeat a doc_id count once, rows without one count
as one document together.  A key in exactly ``min_docs`` documents is dropped.
Keys shorter than ``min_key_chars`` are never dropped.  A text that loses all
lines becomes ''; very long texts are read whole, at a cost in proportion to
their lines.  An empty table gives an empty table.  All other columns are kept in
``row``, so none clashes with the result's.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.scratch import stored

from .columns import small

SPACE = " \t\n\x0b\x0c\r"
#: The table of shared lines is broadcast up to so many rows (16 bytes each); a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def _hashed(df: DataFrame) -> DataFrame:
    """One row per line: id, doc (hash of the text), at (its position), a, b (hash of the key), n (key length)."""
    key = key_of(F.col("line"))
    h = F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"), F.char_length(key).alias("n"))
    lines = df.select("id", F.xxhash64("text").alias("doc"), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    return lines.select("id", "doc", "at", h.alias("h")).select("id", "doc", "at", "h.a", "h.b", "h.n")


def shared_lines(docs: DataFrame, min_docs: int, min_key_chars: int) -> DataFrame:
    """(a, b): hashes of the keys that at least ``min_docs`` documents hold."""
    per_doc = _hashed(docs).where(F.col("n") >= min_key_chars).select("a", "b", "id").distinct()
    return per_doc.groupBy("a", "b").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("a", "b")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_key_chars: int = 1) -> DataFrame:
    """``docs`` with the shared lines gone from its text, as ``row`` (all its columns), ``text``, ``n_lines``, ``n_dropped``."""
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    narrow = base.select("id", "text")
    shared = stored(shared_lines(narrow, min_docs, min_key_chars), "shared_lines")
    shared = small(shared, BROADCAST_ROWS)
    hits = _hashed(narrow).join(shared, ["a", "b"]).groupBy("id", "doc").agg(F.collect_set("at").alias("gone"))
    hits = stored(hits, "dropped_lines").select(F.col("id").alias("hit_id"), F.col("doc").alias("hit_doc"), "gone")
    joined = base.withColumn("doc", F.xxhash64("text")).join(hits, (F.col("doc") == F.col("hit_doc")) & F.col("id").eqNullSafe(F.col("hit_id")), "left")
    lines = joined.select("row", "gone", lines_of(F.col("text")).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i)))
    out = lines.select("row", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select("row", F.array_join("kept", "\n").alias("text"), "n_lines", F.when(F.col("n_dropped") > 0, F.col("n_dropped")).otherwise(0).cast("long").alias("n_dropped"))
