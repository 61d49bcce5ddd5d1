"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, components.

Vectors with equal components collapse to a class with one representative and a
count.  A representative's signs under BITS projections per table give its
bucket in each table; bits and tables follow from the number of classes and the
recall wanted.  What meets in a bucket are ids and signatures (all the signs, a
few dozen bytes), not vectors.  A bucket of more than BLOCK classes is cut into
blocks by a hash of the id, and each pair of its blocks is one unit of work.

Within a unit, pairs whose signatures differ in more places than linked vectors
ever do are passed over, and a pair is taken in the first table only that has it
in one bucket.  The few pairs left meet their vectors, each pair once, and are
verified by the exact cosine in double precision.  A unit with more than DENSE
pairs a member (groups of thousands of near copies) is not written out as pairs:
its vectors are fetched and compared as a block, and each vector gives its
number of links and one edge to its local component.

Defined results: a vector that is null, zero, or holds a null or non-finite
component links with nothing; so do vectors of different lengths.  Components of
any finite size count: vectors are scaled before norms are taken.  A cosine
equal to the threshold links.  Rows that repeat an id have the links of their
own vector each, and equal vectors under one id count once.  Rows without an id
link with nothing (component null, kept true).  An empty table gives an empty
table; very long vectors are read whole; other columns are ignored, whatever
their names.  Ids are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.components import connected_components
from scriptorium.plans.scratch import drop_stored, stored

from .columns import small

#: Classes in a block at most (about), and the chance that a linked pair shares no bucket.
BLOCK = 1024
MISS = 1e-5
#: Classes in a random bucket (about), from which the number of bits follows.
PER_BUCKET = 256
#: Candidate pairs a member from which a unit is compared as a block of vectors.
DENSE = 8


def plan(classes: int, cosine: float) -> tuple[int, int]:
    """(bits, tables) for so many classes."""
    bits = max(4, math.ceil(math.log2(max(classes, 2) / PER_BUCKET)))
    same = (1 - math.acos(min(cosine, 1.0)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - same))) if same < 1 else 1


def most_different(signs: int, cosine: float) -> int:
    """Signs in which a linked pair differs at most, but for a chance of MISS / 100."""
    p = math.acos(max(-1.0, min(cosine, 1.0))) / math.pi
    tail, k = 0.0, signs
    while k > 0:
        tail += math.exp(math.lgamma(signs + 1) - math.lgamma(k + 1) - math.lgamma(signs - k + 1) + k * math.log(max(p, 1e-300)) + (signs - k) * math.log1p(-p))
        if tail > MISS / 100:
            return k
        k -= 1
    return 0


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([dim, bits, tables]).standard_normal((dim, bits * tables))


def _matrix(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    """The vectors at ``rows``, all of length ``dim``, each scaled to a largest component of 1."""
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    return x / np.abs(x).max(1, keepdims=True)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.diff(column.offsets.to_numpy())
    for dim in np.unique(lengths):
        yield int(dim), np.flatnonzero(lengths == dim)


_CODED = "id long, a long, b long, dim int, signs binary"


def _coder(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_length(batch.column(3)):
                signs = np.packbits((_matrix(batch.column(3), rows, dim) @ planes(dim, bits, tables)) > 0, axis=1)
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.full(len(rows), dim, np.int32)), pa.array([x.tobytes() for x in signs], pa.binary())], names=["id", "a", "b", "dim", "signs"])

    return run


def _raw(column: pa.Array) -> np.ndarray:
    """(rows, bytes) of a column of signatures."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _codes(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) buckets of signatures."""
    one = np.unpackbits(signs, axis=1)[:, : bits * tables].reshape(len(signs), tables, bits)
    return one.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def _placer(bits: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _codes(_raw(batch.column(2)), bits, tables) + (batch.column(1).to_numpy().astype(np.int64) << 40)[:, None]  # another length, another bucket
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), t, np.int32)), pa.array(codes[:, t]), batch.column(0), batch.column(2)], names=["tab", "code", "rep", "signs"])

    return run


_UNIT = ("tab", "code", "lo", "hi")


def _units(act: Callable[[pa.RecordBatch], pa.RecordBatch | None]):
    """Run ``act`` on each unit's rows; units come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            out = act(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            if out is not None and out.num_rows:
                yield out

        for batch in batches:
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _UNIT], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b <= a:
                    continue
                if held and (k[a] != key).any():
                    yield from close()
                    held = []
                key = k[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from close()

    return run


def _fresh(codes: np.ndarray, table: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share no bucket in an earlier table."""
    return ~(codes[a, :table] == codes[b, :table]).any(1)


_FOUND = "x long, y long, tab int, code long, lo int, hi int, side int"


def _finder(bits: int, tables: int, most: int):
    """Candidate pairs (x, y) of a unit, or its members (y null) if they are many."""

    def act(t: pa.RecordBatch) -> pa.RecordBatch | None:
        n = t.num_rows
        if n < 2:
            return None
        raw, side = _raw(t.column("signs")), t.column("side").to_numpy()
        wide = np.zeros((n, -(-raw.shape[1] // 8) * 8), np.uint8)
        wide[:, : raw.shape[1]] = raw
        words = wide.view(np.uint64)
        table, ids = t.column("tab")[0].as_py(), t.column("rep").to_numpy()
        codes = _codes(raw, bits, tables)
        across = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        xs, ys, found = [], [], 0
        for at in range(0, n, 256):
            apart = np.zeros((min(256, n - at), n), np.uint16)
            for w in range(words.shape[1]):
                apart += np.bitwise_count(words[at : at + 256, w, None] ^ words[None, :, w])
            a, b = np.nonzero(apart <= most)
            a += at
            keep = (side[a] < side[b]) if across else (a < b)
            a, b = a[keep], b[keep]
            keep = _fresh(codes, table, a, b)
            xs.append(a[keep])
            ys.append(b[keep])
            found += int(keep.sum())
            if found > DENSE * n:
                names = ["x", "y", *_UNIT, "side"]
                return pa.RecordBatch.from_arrays([t.column("rep"), pa.nulls(n, pa.int64()), *[t.column(c) for c in _UNIT], t.column("side")], names=names)
        x, y = np.concatenate(xs), np.concatenate(ys)
        none = pa.nulls(len(x), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), none, pa.nulls(len(x), pa.int64()), none, none, none], names=["x", "y", *_UNIT, "side"])

    return _units(act)


def _pair_verifier(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_length(batch.column("vx")):
                x, y = _matrix(batch.column("vx"), rows, dim), _matrix(batch.column("vy"), rows, dim)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                y /= np.linalg.norm(y, axis=1, keepdims=True)
                linked = rows[np.einsum("ij,ij->i", x, y) >= cosine]
                yield batch.select(["x", "y", "cx", "cy"]).take(pa.array(linked))

    return run


def _block_verifier(bits: int, tables: int, cosine: float):
    """(rep, links counted here, least id of its local component) of a unit compared as a block."""

    def act(t: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, side, copies = t.column("rep").to_numpy(), t.column("side").to_numpy(), t.column("copies").to_numpy()
        n, table = len(ids), t.column("tab")[0].as_py()
        dim = len(t.column("vector")[0])
        x = _matrix(t.column("vector"), np.arange(n), dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        close = (x @ x.T) >= cosine
        np.fill_diagonal(close, False)
        if t.column("lo")[0].as_py() != t.column("hi")[0].as_py():
            close &= side[:, None] != side[None, :]
        a, b = np.nonzero(close)
        if not len(a):
            return None
        root = np.arange(n)
        while True:  # least label, over the pairs of this unit
            low = root.copy()
            np.minimum.at(low, a, root[b])
            low = low[low]
            if (low == root).all():
                break
            root = low
        codes = _codes(_raw(t.column("signs")), bits, tables)
        fresh = np.concatenate([_fresh(codes, table, a[i : i + 100_000], b[i : i + 100_000]) for i in range(0, len(a), 100_000)])
        links = np.bincount(a[fresh], copies[b[fresh]], n).astype(np.int64)
        least = ids.copy()
        np.minimum.at(least, root, ids)
        least = least[root]
        some = (links > 0) | (least != ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(least[some])], names=["rep", "links", "least"])

    return _units(act)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept) per row: links are pairs with at least this cosine."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("given"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda v: v != 0), F.lit(False))
    # -0.0 and 0.0 are one component
    rows = rows.select("id", "given", F.transform("vector", lambda v: v + F.lit(0.0)).alias("vector"), good.alias("good"))
    keyed = rows.where("good").select("id", F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), F.col("vector")).alias("b"), "vector", "given")
    bits, tables = plan(keyed.agg(F.approx_count_distinct("a").alias("n")).first()["n"], cosine)

    coded = stored(keyed.select("id", "a", "b", "vector").mapInArrow(_coder(bits, tables), _CODED), "vector_codes")
    classes = coded.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies"), F.first("dim").alias("dim"), F.first("signs").alias("signs"))
    classes = stored(classes.withColumn("least", F.col("rep")), "vector_classes")
    # an id with several vectors is the least of several classes, which need a name each
    shared = stored(classes.groupBy("least").count().where("count > 1").select("least", F.lit(True).alias("shared")), "shared_names")
    several = not shared.isEmpty()
    if several:
        named = F.when(F.col("shared"), F.xxhash64("a", "b")).otherwise(F.col("least"))
        classes = stored(classes.join(small(shared), "least", "left").withColumn("rep", named).drop("shared"), "vector_classes")

    placed = classes.select("rep", "dim", "signs").mapInArrow(_placer(bits, tables), "tab int, code long, rep long, signs binary")
    large = placed.groupBy("tab", "code").count().where(F.col("count") > BLOCK).select("tab", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = small(stored(large, "large_buckets"))
    units = placed.join(large, ["tab", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    units = units.withColumn("side", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("rep", "tab"), F.col("blocks")).cast("int")))
    units = units.select("rep", "signs", "tab", "code", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    # the diagonal unit holds its own block once; an off-diagonal unit holds two blocks and takes the pairs across
    units = units.select("rep", "signs", "tab", "code", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    work = units.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    found = stored(work.mapInArrow(_finder(bits, tables, most_different(bits * tables, cosine)), _FOUND), "vector_candidates")

    pairs, dense = found.where("y is not null").select("x", "y"), found.where("y is null").drop("y").withColumnRenamed("x", "rep")
    wanted = pairs.select(F.col("x").alias("rep")).union(pairs.select("y")).union(dense.select("rep")).distinct()
    chosen = classes.join(wanted, "rep", "left_semi").select("rep", "least", "a", "b", "copies", "signs")
    held = keyed.select(F.col("id").alias("least"), "a", "b", F.col("given").alias("vector")).join(chosen, ["least", "a", "b"]).dropDuplicates(["rep"])
    held = stored(held.select("rep", "copies", "signs", "vector"), "vectors_wanted")
    x = held.select(F.col("rep").alias("x"), F.col("copies").alias("cx"), F.col("vector").alias("vx"))
    y = held.select(F.col("rep").alias("y"), F.col("copies").alias("cy"), F.col("vector").alias("vy"))
    linked = stored(pairs.join(x, "x").join(y, "y").select("x", "y", "cx", "cy", "vx", "vy").mapInArrow(_pair_verifier(cosine), "x long, y long, cx long, cy long"), "vector_links")
    counts = linked.select(F.col("x").alias("rep"), F.col("cy").alias("links")).unionByName(linked.select(F.col("y").alias("rep"), F.col("cx").alias("links")))
    edges = linked.select("x", "y")
    if not dense.isEmpty():
        block = dense.join(held, "rep").repartition(*_UNIT).sortWithinPartitions(*_UNIT).select(*_UNIT, "side", "rep", "copies", "signs", "vector")
        more = stored(block.mapInArrow(_block_verifier(bits, tables, cosine), "rep long, links long, least long"), "block_links")
        counts = counts.unionByName(more.select("rep", "links"))
        edges = edges.unionByName(more.where("rep <> least").select(F.col("rep").alias("x"), F.col("least").alias("y")))

    between = counts.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(edges, "x", "y").withColumnRenamed("node", "rep")
    totals = classes.select("a", "b", "rep", "least", "copies").join(between, "rep", "left").join(component, "rep", "left")
    totals = totals.select("a", "b", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    totals = stored(totals, "vector_totals")
    if several:
        first = totals.groupBy("component_id").agg(F.min("least").alias("first"))
        totals = totals.join(first, "component_id").select("a", "b", "n_links", F.col("first").alias("component_id"))
    drop_stored(held)
    found_rows = coded.select("id", "a", "b").join(totals, ["a", "b"]).select("id", "n_links", "component_id")
    rest = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = found_rows.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
