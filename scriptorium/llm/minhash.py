"""MinHash near-dedup: one-permutation sketches, banded buckets, star-shaped candidate edges.

Whole texts become sets of word shingles.  Equal sets collapse to a class with
one representative, so groups of copies cost one row each.  Every class gets
one permutation's minima in 256 bins, empty bins filled by optimal
densification, cut into 42 bands of 6.  In each bucket every class is first
linked to one centre only (drawn afresh per band), so a bucket of m classes makes
m - 1 candidate edges.  Edges are confirmed on the full sets: first each class's
most frequent partner, then all edges that still join different components.
Buckets that still hold several components are then finished exactly, without a
row for each pair: their members meet in blocks, by one byte of each bin.  Pairs
in one component, pairs of an earlier band, and pairs whose bytes agree in far
fewer places than a link's do are passed over.  Where few pairs are left they
are confirmed one by one; where many are (families of texts near the threshold)
the block's texts are fetched and compared as a product of incidence matrices.

Defined results: null text, or text without words: an empty set, linked with
nothing.  A very long text is read whole, and a similarity equal to the
threshold links.  Rows with the same doc_id are one node with all their sets.
Rows without doc_id link with nothing; component_id is null and kept true.  An
empty table gives an empty table.  Extra columns are ignored, whatever their
names.  Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.components import connected_components, merged_components
from scriptorium.plans.scratch import drop_stored, stored

from .columns import small
from .kernel import FOLD, mix, pieces, shingle_sets, span_hashes, utf8

BINS, BANDS, ROWS = 256, 42, 6
_rng = np.random.default_rng(11)
#: For each bin the order in which an empty one asks the others for their minimum.
_PROBES = np.array([_rng.permutation(BINS) for _ in range(BINS)])
_WEIGHTS = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The BINS minima of a sorted distinct non-empty set of 64-bit hashes.

    The hash order is the permutation and a hash's top byte its bin, so a bin's
    minimum is the first hash of its run.
    """
    bins = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = shingles[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        donors = _PROBES[empty, full[_PROBES[empty]].argmax(1)]
        out[empty] = out[donors]
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(n, BINS) sketches -> (n, BANDS) bucket keys."""
    used = mix(sketches[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS), 5)
    return mix((used * _WEIGHTS).sum(2, dtype=np.uint64), 6).view(np.int64)


_SKETCHED = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("bytes", pa.binary())])


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                data, off = utf8(part.column(1))
                sets = shingle_sets(FOLD[data], off, k)
                n = np.array([len(x) for x in sets], np.int64)
                some = np.flatnonzero(n)
                sums = np.zeros((2, len(sets)), np.uint64)
                sketches = np.zeros((len(some), BINS), np.uint64)
                for j, i in enumerate(some):
                    sums[0, i], sums[1, i] = mix(sets[i], 21).sum(), mix(sets[i], 22).sum()
                    sketches[j] = sketch(sets[i])
                keys = band_keys(sketches).reshape(-1)
                counts = np.where(n > 0, BANDS, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(keys, pa.int64()))
                low = iter(mix(sketches[:, : BANDS * ROWS], 51).astype(np.uint8))
                raw = pa.array([next(low).tobytes() if x else None for x in n], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), bands, raw], schema=_SKETCHED)

    return run


#: Up to so many candidate ids their Bloom filter (16 bits each) goes to every task; more are found by a join.
BLOOM_IDS = 4_000_000
_BLOOM_HASHES = 4


def _bloom(ids: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word and bit of each of an id's places in a filter of ``words`` 64-bit words."""
    for j in range(_BLOOM_HASHES):
        h = mix(ids.astype(np.int64).view(np.uint64), 31 + j)
        yield ((h >> np.uint64(6)) % np.uint64(words)).astype(np.int64), h & np.uint64(63)


def _of_ids(text: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``text`` whose id is wanted, and perhaps a few more (Bloom filter); the text is not shuffled."""
    n = wanted.count()
    if n > BLOOM_IDS:
        return text.join(wanted, "id", "left_semi")
    words = max(1024, n // 4)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w, (np.uint64(1) << b).view(np.int64)) for w, b in _bloom(batch.column(0).to_numpy(), words)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["word", "bits"])

    rows = wanted.mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(words, np.uint64)
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    sent = text.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy()
            for w, b in _bloom(ids, words):
                keep &= (sent.value[w] >> b & np.uint64(1)).astype(bool)
            if keep.any():
                yield batch.filter(pa.array(keep))

    return text.mapInArrow(run, "id long, text string")


def _confirmer(k: int, percent: int):
    def sets_of(ids: pa.Array, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
        """The sets of the distinct (id, text) in a block and each row's index among them."""
        data, off = utf8(texts)
        keys = mix(ids.to_numpy().view(np.uint64), 41) ^ span_hashes(data, off[:-1], off[1:])
        _, first, index = np.unique(keys, return_index=True, return_inverse=True)
        one = texts.take(pa.array(first))
        data, off = utf8(one)
        return shingle_sets(FOLD[data], off, k), index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 3):
                sets_x, at_x = sets_of(part.column(0), part.column(2))
                sets_y, at_y = sets_of(part.column(1), part.column(3))
                keep = np.zeros(part.num_rows, bool)
                for i, (a, b) in enumerate(zip(at_x, at_y, strict=True)):
                    x, y = sets_x[a], sets_y[b]
                    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        continue
                    both = np.concatenate([x, y])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    keep[i] = 100 * shared >= percent * (len(both) - shared)
                yield part.select([0, 1]).filter(pa.array(keep))

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (x, y) that are links, by the full sets of their texts; distinct pairs of ids with one text each stay distinct."""
    x = texts.select(F.col("id").alias("x"), F.col("text").alias("text_x"))
    y = texts.select(F.col("id").alias("y"), F.col("text").alias("text_y"))
    both = pairs.select("x", "y").join(y, "y").join(x, "x").select("x", "y", "text_x", "text_y")
    return both.mapInArrow(_confirmer(k, percent), "x long, y long")


#: Members in a block (about) of a bucket that is finished, and pairs a member from which the block's texts are fetched.
BLOCK, DENSE = 1024, 1
_UNIT = ("band", "bucket", "lo", "hi")


def least_equal(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Bytes (of BANDS * ROWS) in which a linked pair agrees at least, but for a chance of about 1e-8; a small set is as few draws as it has shingles."""
    n, p = BANDS * ROWS, percent / 100
    spread = np.sqrt(p * (1 - p) / np.minimum(n, np.maximum(shingles, 1)))
    return np.maximum(ROWS, np.floor(n * (p - 5.6 * spread)))


def _units(act):
    """Run ``act`` on each unit's rows; units come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in _UNIT], 1)
            cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1), len(k)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b <= a:
                    continue
                if held and (k[a] != key).any():
                    yield from act(pa.Table.from_batches(held))
                    held = []
                key = k[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield from act(pa.Table.from_batches(held))

    return run


def _open_pairs(t: pa.Table, percent: int) -> np.ndarray:
    """(n, n) upper triangle: the unit's pairs that a link is still possible for and no earlier band has."""
    n = t.num_rows
    low = np.frombuffer(b"".join(t["bytes"].to_pylist()), np.uint8).reshape(n, BANDS * ROWS)
    own, sizes, side = (t[c].to_numpy() for c in ("own", "n_shingles", "side"))
    band = t["band"][0].as_py()
    out = own[:, None] != own[None, :]
    out &= 100 * np.minimum(sizes[:, None], sizes[None, :]) >= percent * np.maximum(sizes[:, None], sizes[None, :])
    out &= (side[:, None] < side[None, :]) if t["lo"][0].as_py() != t["hi"][0].as_py() else np.triu(np.ones((n, n), bool), 1)
    least = least_equal(sizes, percent)
    for i in np.flatnonzero(out.any(1)):
        some = np.flatnonzero(out[i])
        same = low[some] == low[i]
        good = same.sum(1) >= np.minimum(least[some], least[i])
        good[good] &= ~same[good, : band * ROWS].reshape(int(good.sum()), band, ROWS).all(2).any(1)
        out[i, some[~good]] = False
    return out


_OPEN = "x long, y long, band int, bucket long, lo int, hi int, side int, own long, n_shingles long, bytes binary"


def _finder(percent: int):
    """A unit's open pairs (x, y), or its members (y null) if the pairs are many."""

    def act(t: pa.Table) -> Iterator[pa.RecordBatch]:
        if t.num_rows < 2:
            return
        a, b = np.nonzero(_open_pairs(t, percent))
        ids = t["rep"].to_numpy()
        names = ["x", "y", *_UNIT, "side", "own", "n_shingles", "bytes"]
        if len(a) > DENSE * t.num_rows:
            t = t.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([t.column("rep"), pa.nulls(t.num_rows, pa.int64()), *[t.column(c) for c in names[2:]]], names=names)
        elif len(a):
            nulls = [pa.nulls(len(a), kind) for kind in (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), *nulls], names=names)

    return _units(act)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """(n, n) sizes of the sets' intersections, by incidence matrices over slices of the shingles that several sets have."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable")
    hashes, rows = hashes[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
    counts = np.diff(first, append=len(hashes))
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)
    several = np.repeat(counts > 1, counts)
    column, rows = column[several], rows[several]
    out = np.zeros((n, n), np.float32)
    width = max(1, min(8192, 16_000_000 // max(n, 1)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, width), np.float32)
        part[rows[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def _block_verifier(k: int, percent: int):
    """Edges (x, y) that span the links of a unit compared as a block."""

    def act(t: pa.Table) -> Iterator[pa.RecordBatch]:
        open_ = _open_pairs(t, percent)
        data, off = utf8(t["text"].combine_chunks())
        sets = shingle_sets(FOLD[data], off, k)
        sizes = np.array([len(s) for s in sets], np.float32)
        shared = shared_counts(sets)
        a, b = np.nonzero(open_ & (100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)) & (shared > 0))
        root = np.arange(t.num_rows)
        kept = []
        for i, j in zip(a.tolist(), b.tolist(), strict=True):  # a spanning forest of the links
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            if i != j:
                root[max(i, j)] = min(i, j)
                kept.append((i, j))
        if kept:
            ids = t["rep"].to_numpy()
            x, y = np.array(kept).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], names=["x", "y"])

    return _units(act)


def _finish_buckets(members: DataFrame, low: DataFrame, component: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``component`` (node, component) once every two ``members`` (band, bucket, rep, n_shingles) of a bucket are in one component or have been ruled out or compared.

    low: rep, bytes.
    """
    at = ["band", "bucket"]
    placed = members.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(*at, "rep", "n_shingles", F.coalesce("component", "rep").alias("own"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy(*at).agg(F.min("own").alias("a"), F.max("own").alias("b"), F.count("*").alias("n")).where("a <> b")
    mixed = stored(mixed.select(*at, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "unfinished")
    if mixed.isEmpty():
        drop_stored(placed)
        return component
    side = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("rep", "band"), F.col("blocks")).cast("int"))
    still = stored(placed.join(small(mixed), at).withColumn("side", side), "unfinished_members")
    drop_stored(placed)
    units = still.join(low, "rep").select(*at, "rep", "n_shingles", "own", "bytes", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select(*at, "rep", "n_shingles", "own", "bytes", "side", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"))
    found = stored(units.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(_finder(percent), _OPEN), "open_pairs")
    drop_stored(still)
    pairs = found.where("y is not null").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    links = _confirmed(pairs, texts, k, percent)
    dense = found.where("y is null").drop("y").withColumnRenamed("x", "rep")
    if not dense.isEmpty():
        block = dense.join(texts.withColumnRenamed("id", "rep"), "rep").repartition(*_UNIT).sortWithinPartitions(*_UNIT)
        links = links.unionByName(block.mapInArrow(_block_verifier(k, percent), "x long, y long"))
    links = stored(links, "links")
    drop_stored(found)
    if links.isEmpty():
        return component
    return stored(merged_components(component, links, "x", "y"), "components")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row per row of ``docs``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of
    their shingle sets; component_id is the smallest id reachable by links.
    """
    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = stored(text.mapInArrow(_sketcher(shingle_words), "id long, n_shingles long, set_a long, set_b long, bands array<long>, bytes binary"), "sketched")
    named = sketched.where("id is not null and n_shingles > 0")
    key = ["set_a", "set_b", "n_shingles"]
    classes = named.groupBy(*key).agg(F.min(F.struct("id", "bands", "bytes")).alias("one")).select(*key, F.col("one.id").alias("rep"), F.col("one.bands").alias("bands"), F.col("one.bytes").alias("bytes"))
    classes = stored(classes, "classes")
    whole, sketched = sketched, stored(sketched.select("id", *key), "sets")
    named = sketched.where("id is not null and n_shingles > 0")
    drop_stored(whole)

    buckets = classes.select("rep", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    # a centre by its id under a mask of the band: eight bytes a row give the draw and the id
    mask = F.xxhash64("band")
    drawn = F.col("rep").bitwiseXOR(mask)
    stars = buckets.groupBy("band", "bucket").agg(F.min(drawn).alias("o"), F.min_by("n_shingles", drawn).alias("n_centre"), F.count("*").alias("m")).where("m > 1")
    stars = stars.select("band", "bucket", F.col("o").bitwiseXOR(mask).alias("centre"), "n_centre")
    members = stored(buckets.join(stars, ["band", "bucket"]), "members")
    # the bands are not read again
    whole, classes = classes, stored(classes.drop("bands"), "classes")
    drop_stored(whole)
    edges = (
        members.where("rep <> centre")
        .where(100 * F.least("n_shingles", "n_centre") >= percent * F.greatest("n_shingles", "n_centre"))
        .groupBy("rep", "centre")
        .agg(F.count("*").alias("shared"))
    )
    edges = stored(edges, "candidates")
    wanted = edges.select(F.col("rep").alias("id")).union(edges.select(F.col("centre").alias("id"))).distinct()
    texts = _of_ids(text, stored(wanted, "wanted"))
    repeated = named.groupBy("id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b"), F.count("*").alias("n")).where("n > 1")
    repeated = stored(repeated, "repeated")
    if not repeated.isEmpty():
        texts = texts.dropDuplicates(["id", "text"])
    texts = stored(texts, "texts")

    best = edges.groupBy("rep").agg(F.max(F.struct("shared", F.col("centre").alias("y"))).alias("b")).select(F.col("rep").alias("x"), "b.y")
    links = stored(_confirmed(best, texts, shingle_words, percent), "links")
    # rows of one doc_id with different sets are one node: their classes' representatives are linked
    reps = classes.select(*key, "rep")
    if not repeated.isEmpty():
        several = named.join(repeated.where("a <> b").select("id"), "id", "left_semi").join(reps, key).select("id", "rep").distinct()
        least = several.groupBy("id").agg(F.min("rep").alias("y"))
        links = links.unionByName(several.join(least, "id").where("rep <> y").select(F.col("rep").alias("x"), "y"))
    first = stored(connected_components(links, "x", "y"), "components")

    def at(end: str) -> DataFrame:
        return first.select(F.col("node").alias(end), F.col("component").alias(f"{end}_at"))

    rest = (
        edges.select(F.col("rep").alias("x"), F.col("centre").alias("y"))
        .join(at("x"), "x", "left")
        .join(at("y"), "y", "left")
        .where("coalesce(x_at, x) <> coalesce(y_at, y)")
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct()
    )
    more = stored(_confirmed(rest, texts, shingle_words, percent), "links")
    component = first
    if not more.isEmpty():
        component = stored(merged_components(first, more, "x", "y"), "components")
    component = _finish_buckets(members.select("band", "bucket", "rep", "n_shingles"), classes.select("rep", "bytes"), component, texts, shingle_words, percent)
    drop_stored(members)
    drop_stored(texts)

    of_class = reps.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    found = sketched.select("id", *key).join(of_class, key, "left")
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    found = found.withColumn("component_id", F.when(alone, F.col("id")).otherwise(F.col("component_id")))
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
