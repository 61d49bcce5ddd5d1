"""Best-fit packing of documents into bins of a fixed number of tokens, under conflicts.

A document longer than a bin is cut into whole bins and a rest, so nothing is
lost.  Pieces are dealt to groups of about GROUP by a hash (so every group gets
its share of a hot text's copies and of the texts that can stand beside them)
and each group is packed, largest first.  Open bins are kept in order of their
residual room, each with two bitmaps: the duplicate clusters it holds, and for
each source ``max_per_source`` slots.  A piece starts at its successor, the
tightest bin with room, and goes on until a bin holds neither its cluster nor a
full set of its source; without one it opens a bin.  Clusters and sources with
many pieces in a group have an index of their own, from which bins that conflict
with them are left out, so no search walks past the bins that a hot source has
filled.

Defined results: documents without words need no room (bin null, n_tokens 0).
A very long document takes bins of its own and a rest.  A null source, or null
text, conflicts with nothing on that account.  Texts that are equal form a
cluster, as do the pieces of one text; a hash collision could only add a
conflict.  Rows that repeat an id are packed each.  Ties go by cluster, id and
piece.  An empty table gives an empty table; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.plans.scratch import stored

from .columns import word_count

CAPACITY = 2048
MAX_PER_SOURCE = 2
#: Pieces that are packed together (about); bins never span groups.
GROUP = 8192


#: Share of a group's pieces from which a cluster or source has an index of its own.
HOT_SHARE = 1 / 32


class _Bins:
    """Open bins by residual room: one index of all, and one for each hot (cluster, source) without the bins that conflict with it."""

    def __init__(self, kinds: Sequence[tuple]):
        self.open: dict[tuple, list[tuple[int, int]]] = {kind: [] for kind in [(None, None), *kinds]}
        self.clusters: list[int] = []
        self.sources: list[int] = []
        self.used: list[int] = []

    def drop(self, room: int, b: int) -> None:
        for index in self.open.values():
            at = bisect_left(index, (room, b))
            if at < len(index) and index[at] == (room, b):
                index.pop(at)


def best_fit(sizes: Sequence[int], clusters: Sequence, sources: Sequence, capacity: int, max_per_source: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece, in the order given (largest first for best results); None conflicts with nothing."""
    often = Counter(c for c in clusters if c is not None)
    bit = {c: 1 << i for i, c in enumerate(c for c, n in often.items() if n > 1)}
    first = {s: max_per_source * i for i, s in enumerate(dict.fromkeys(s for s in sources if s is not None))}
    slots = (1 << max_per_source) - 1
    least = max(16, HOT_SHARE * len(sizes))
    hot_clusters = {c for c, n in often.items() if n >= least}
    hot_sources = {s for s, n in Counter(sources).items() if s is not None and n >= least}
    kinds = {(c if c in hot_clusters else None, s if s in hot_sources else None) for c, s in zip(clusters, sources, strict=True)} - {(None, None)}
    bins = _Bins(sorted(kinds, key=str))

    def conflicts(b: int, mine: int, full: int) -> bool:
        return bool(bins.clusters[b] & mine) or bool(full and bins.sources[b] & full == full)

    def bits(cluster, source) -> tuple[int, int]:
        return bit.get(cluster, 0), slots << first[source] if source is not None else 0

    masks = {kind: bits(*kind) for kind in bins.open}
    out, offsets = [], []
    for size, cluster, source in zip(sizes, clusters, sources, strict=True):
        mine, full = bits(cluster, source)
        index = bins.open[cluster if cluster in hot_clusters else None, source if source in hot_sources else None]
        at = bisect_left(index, (size, -1))
        while at < len(index) and conflicts(index[at][1], mine, full):
            at += 1
        if at < len(index):
            room, b = index[at]
            bins.drop(room, b)
        else:
            room, b = capacity, len(bins.used)
            bins.clusters.append(0)
            bins.sources.append(0)
            bins.used.append(0)
        out.append(b)
        offsets.append(bins.used[b])
        bins.used[b] += size
        bins.clusters[b] |= mine
        if full:
            taken = (bins.sources[b] >> first[source]) & slots
            bins.sources[b] |= (~taken & (taken + 1)) << first[source]
        if room > size:
            for kind, index in bins.open.items():
                if not conflicts(b, *masks[kind]):
                    insort(index, (room - size, b))
    return out, offsets


def _packer(capacity: int, max_per_source: int):
    names = ["id", "piece", "first_token", "n_tokens", "bin", "bin_offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            bins, offsets = best_fit(t["n_tokens"].to_pylist(), t["cluster"].to_pylist(), t["source"].to_pylist(), capacity, max_per_source)
            columns = [t[c].combine_chunks() for c in names[:4]]
            return pa.RecordBatch.from_arrays([*columns, pa.array([(group << 20) | b for b in bins], pa.int64()), pa.array(offsets, pa.int64())], names=names)

        for batch in batches:
            g = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b <= a:
                    continue
                if held and g[a] != group:
                    yield close()
                    held = []
                group = int(g[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    return run


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    max_per_source: int = MAX_PER_SOURCE,
) -> DataFrame:
    """(id_col, piece, first_token, n_tokens, bin_id, bin_offset): where each piece of each document's words goes."""
    own = F.xxhash64(F.col(text_col)) if cluster is None else cluster
    sized = docs.select(F.col(id_col).alias("id"), F.when(F.col(text_col).isNotNull(), own).alias("cluster"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("words"))
    # the number tells rows that repeat an id apart, so that they are not all dealt to one group
    sized = stored(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    count = F.ceil(F.col("words") / capacity)
    pieces = sized.where("words > 0").select("id", "cluster", "source", "words", "row", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"))
    pieces = pieces.select("id", "cluster", "source", "piece", "row", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece") * capacity).alias("n_tokens"))
    groups = max(1, math.ceil((sized.agg(F.sum(count).alias("n")).first()["n"] or 0) / GROUP))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "piece", "row"), F.lit(groups))).repartition("group")
    dealt = dealt.sortWithinPartitions("group", F.desc("n_tokens"), "cluster", "id", "piece", "source", "row")
    id_type = sized.schema["id"].dataType.simpleString()
    packed = dealt.mapInArrow(_packer(capacity, max_per_source), f"id {id_type}, piece long, first_token long, n_tokens long, bin long, bin_offset long")
    none = F.lit(None).cast("long")
    empty = sized.where("words = 0").select("id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("n_tokens"), none.alias("bin"), none.alias("bin_offset"))
    return packed.unionByName(empty).select(F.col("id").alias(id_col), "piece", "first_token", "n_tokens", F.col("bin").alias("bin_id"), "bin_offset")
