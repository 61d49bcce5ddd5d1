"""Token-ID output: ids of whole texts in ascending document order, as grammar-compressed shards.

The file format is Parquet with one row per shard: ``part`` and ``block`` give
the order, ``first_token`` the ids before it within its part, ``docs`` its
document ids, and the binary columns its Re-Pair grammar (little-endian uint32:
``rules`` two per rule, ``lengths`` one per rule, ``symbols``, ``doc_symbols``
the symbol offsets of its documents, ``marks`` the ids before every 512th
symbol, by which any range of ids is decoded without the rest).  Spark's own writer commits the files, so
any store Spark knows will do and lost or repeated tasks leave no trace.

Defined results: null text encodes as empty; the end id follows every document.
Documents without doc_id come first; rows that repeat a doc_id are ordered by a
hash of their text, so ties among equal rows do not show.  A very long document
is a shard alone.  An empty table gives an empty folder of shards; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .kernel import pieces, utf8
from .repair import Grammar, compress, expand
from .tokens import encoder

#: Ids after which a shard is closed (a longer document is a shard alone).
SHARD_TOKENS = 500_000
#: Bytes of the table (as Catalyst estimates them) for one writing task.
TASK_BYTES = 64 << 20
SHARD_SCHEMA = "part int, block int, first_token long, n_tokens long, base long, docs array<long>, doc_symbols binary, rules binary, lengths binary, symbols binary, marks binary"
_SHARD = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int64()), ("docs", pa.list_(pa.int64()))]
    + [(n, pa.binary()) for n in ("doc_symbols", "rules", "lengths", "symbols", "marks")]
)


def _row(part: int, block: int, first: int, docs: list, ids: list[np.ndarray], lengths: list[np.ndarray], base: int) -> pa.RecordBatch:
    off = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
    g = compress(np.concatenate(ids), off, base)
    raw = [np.ascontiguousarray(x.astype("<u4")).tobytes() for x in (g.doc_symbols, g.rules, g.lengths, g.symbols, g.marks)]
    values = [[part], [block], [first], [int(off[-1])], [base], [docs], *[[x] for x in raw]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _SHARD, strict=True)], schema=_SHARD)


def _writer(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        base = max(len(enc.width), end_id + 1)
        part, block, first = TaskContext.get().partitionId(), 0, 0
        docs, ids, lengths, held = [], [], [], 0
        for batch in batches:
            for piece in pieces(batch, 1):
                found, off = enc.encode(*utf8(piece.column(1)), end_id)
                docs += piece.column(0).to_pylist()
                ids.append(found)
                lengths.append(np.diff(off))
                held += len(found)
                if held >= SHARD_TOKENS:
                    yield _row(part, block, first, docs, ids, lengths, base)
                    first, block = first + held, block + 1
                    docs, ids, lengths, held = [], [], [], 0
        if docs:
            yield _row(part, block, first, docs, ids, lengths, base)

    return run


def _partitions(docs: DataFrame) -> int:
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // TASK_BYTES) if size < 1 << 60 else least  # a plan without statistics claims more than any table has


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode every text and write the shards below ``path``; ``partitions`` defaults to one per TASK_BYTES, the shuffle partitions at least."""
    n = partitions or _partitions(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    placed = rows.repartitionByRange(n, F.asc_nulls_first("id"), "tie").sortWithinPartitions(F.asc_nulls_first("id"), "tie")
    placed.select("id", "text").mapInArrow(_writer(tokenizer, end_id), SHARD_SCHEMA).write.parquet(path)


def grammar_of(row: dict) -> Grammar:
    read = {n: np.frombuffer(row[n], "<u4") for n in ("doc_symbols", "rules", "lengths", "symbols", "marks")}
    return Grammar(row["base"], read["rules"].reshape(-1, 2), read["lengths"], read["symbols"], read["doc_symbols"].astype(np.int64), read["marks"])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            g = grammar_of(row)
            ids = expand(g, g.symbols)
            off = np.concatenate([[0], np.cumsum(g.width(g.symbols))])[g.doc_symbols]
            raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            names = ["doc_id", "part", "start", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array([row["part"]] * len(crc), pa.int32()), pa.array(off[:-1] + row["first_token"]), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=names)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the shards below ``path``."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # one row per part, as many as the writing job had partitions: small enough for one task and a broadcast
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    rows = shards.mapInArrow(_reader, "doc_id long, part int, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
