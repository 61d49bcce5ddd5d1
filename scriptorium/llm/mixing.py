"""Mixing sources to target weights by temperature, as budgeted block permutations.

DataFrame functions only.  A source with token share p gets the weight
p ** exponent, normalised.  The exponent in [0, 1] is bisected until the weights
have the entropy asked for, or until the most repeated source is read
``max_repeats`` times; each round evaluates 63 exponents in one aggregation of
the source table, which is six bisections.  The budget is by default the least
at which every source is read once in full, so no document is lost.

A source's documents fall into blocks by a hash.  Each epoch is a permutation
of the blocks and, within a block, of its documents (``place`` sorts an epoch).
Whole epochs take all rows; the last takes blocks in their order up to the
budget and, of the block where it ends, documents in theirs.  Only sums per
source and per block are shuffled.  Sums along the permutation are taken in two
steps, over ranges of the order and within each, so a window sees at most the
ranges of a source, one range's blocks, or the documents of one block.

Defined results: a null source is a source of its own.  Null or empty text has
no tokens; a source without tokens is read once.  Identical rows stand or fall
together, and ties in the order are theirs alone.  A very long document is read
whole or not at all: a budget is exceeded by less than one document (or one
group of identical rows).  An empty table gives an empty table; all columns are
kept in ``row``, so none clashes with the result's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.plans.scratch import stored

from .columns import small, word_count

#: Documents in a block (about).
BLOCK_DOCS = 1024
#: Leading hexadecimal digits of a block's place that make a range of the order: 4,096 ranges a source.
_RANGE_DIGITS = 3
_STEPS, _ROUNDS = 64, 5


def solve_exponent(sources: DataFrame, *, max_repeats: float | None = None, entropy: float | None = None) -> float:
    """The exponent for ``sources`` (tokens per source): least with repeats within the limit, or with the entropy (nats) asked for."""
    if (max_repeats is None) == (entropy is None):
        raise ValueError("give max_repeats or entropy")
    total = sources.agg(F.sum("tokens").alias("t")).first()["t"]
    if not total:
        return 1.0
    share = F.col("tokens") / total
    shares = sources.where("tokens > 0")
    low, high = 0.0, 1.0
    for _ in range(_ROUNDS):
        tried = [low + (high - low) * i / _STEPS for i in range(1, _STEPS)]
        if entropy is None:
            # repeats of source s, if each is read once at least: (p_s / p_max) ** (exponent - 1)
            most = [F.max(F.pow(share, F.lit(a - 1))).alias(f"x{i}") for i, a in enumerate(tried)]
            least = [F.min(F.pow(share, F.lit(a - 1))).alias(f"y{i}") for i, a in enumerate(tried)]
            row = shares.agg(*most, *least).first()
            fits = [row[f"x{i}"] / row[f"y{i}"] <= max_repeats for i in range(len(tried))]
        else:
            # entropy of q_s = p_s ** a / z: log z - sum(p ** a * a * log p) / z
            sums = [F.sum(F.pow(share, F.lit(a))).alias(f"x{i}") for i, a in enumerate(tried)]
            logs = [F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"y{i}") for i, a in enumerate(tried)]
            row = shares.agg(*sums, *logs).first()
            fits = [math.log(row[f"x{i}"]) - a * row[f"y{i}"] / row[f"x{i}"] <= entropy for i, a in enumerate(tried)]
        # both fall as the exponent grows: the first that fits ends the bracket
        at = fits.index(True) if True in fits else len(tried)
        low, high = (tried[at - 1] if at else low), (tried[at] if at < len(tried) else high)
    return round(high, 9)


def plan(sources: DataFrame, exponent: float, budget_tokens: int | None = None) -> DataFrame:
    """(source, docs, tokens, weight, budget, epochs, rest): whole epochs of each source and the tokens of its last, partial one."""
    z = sources.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(exponent))).alias("z")).first()["z"] or 1.0
    weighed = sources.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / z).otherwise(0.0))
    if budget_tokens is None:
        budget = weighed.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight")).alias("b")).first()["b"] or 0.0
    else:
        budget = float(budget_tokens)
    allotted = F.round(F.lit(budget) * F.col("weight")).cast("long")
    if budget_tokens is None:
        allotted = F.greatest(allotted, F.col("tokens"))  # rounding must not cost a document
    epochs = F.when(F.col("tokens") == 0, 1).otherwise(F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))).cast("long")
    return weighed.withColumn("budget", allotted).withColumn("epochs", epochs).withColumn("rest", F.when(F.col("tokens") == 0, 0).otherwise(F.col("budget") - F.col("epochs") * F.col("tokens")))


def _order(*of: str | Column) -> Column:
    """A pseudo-random sort key, as 16 hexadecimal digits."""
    return F.lpad(F.hex(F.xxhash64(F.lit("order"), *of)), 16, "0")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    max_repeats: float | None = None,
    entropy: float | None = None,
    budget_tokens: int | None = None,
) -> DataFrame:
    """One row per reading of a document: ``row`` (all its columns), n_tokens, epoch, block, place.

    Sorting by (epoch, place) within a source gives its reading order.
    """
    base = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("n_tokens"),
        F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col)).alias("h"),
    )
    sized = stored(base.select("source", "n_tokens", "h"), "sized")
    sources = stored(sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "sources")
    chosen = plan(sources, solve_exponent(sources, max_repeats=max_repeats, entropy=entropy), budget_tokens)
    chosen = chosen.select(F.col("source").alias("of"), "epochs", "rest", F.ceil(F.col("docs") / BLOCK_DOCS).alias("blocks"))
    chosen = small(stored(chosen, "mix_plan"))

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.join(chosen, F.col("source").eqNullSafe(F.col("of")), "inner").withColumn("block", F.pmod("h", "blocks")).drop("of", "blocks")

    placed = in_blocks(sized)
    # where each block stands in its source's partial epoch
    blocks = placed.groupBy("source", "block", "epochs", "rest").agg(F.sum("n_tokens").alias("t"))
    order = _order("source", "epochs", "block")
    blocks = stored(blocks.select("*", order.alias("order"), F.substring(order, 1, _RANGE_DIGITS).alias("range")), "mix_order")
    ranges = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.groupBy("source", "range").agg(F.sum("t").alias("t")).select(F.col("source").alias("of"), F.col("range").alias("of_range"), F.coalesce(F.sum("t").over(ranges), F.lit(0)).alias("start"))
    blocks = blocks.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("of_range"))).drop("of", "of_range")
    along = Window.partitionBy("source", "range").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.col("start") + F.coalesce(F.sum("t").over(along), F.lit(0)))
    partial = F.when(F.col("rest") == 0, 0).when(F.col("before") + F.col("t") <= F.col("rest"), 1).when(F.col("before") < F.col("rest"), 2).otherwise(0)
    blocks = stored(blocks.withColumn("partial", partial).where("partial > 0").select(F.col("source").alias("of"), F.col("block").alias("of_block"), "partial", "before"), "mix_blocks")

    def with_blocks(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
        return rows.join(found, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block")), how).drop("of", "of_block")

    # of the block in which the budget ends, one per source, its documents one by one
    edge = with_blocks(placed, small(blocks.where("partial = 2")), "inner").groupBy("source", "block", "epochs", "rest", "before", "h").agg(F.sum("n_tokens").alias("t"))
    inside = Window.partitionBy("source").orderBy(_order("source", "epochs", "h"), "h").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("upto", F.col("before") + F.coalesce(F.sum("t").over(inside), F.lit(0))).where("upto < rest")
    edge = small(stored(edge.select(F.col("source").alias("e_source"), F.col("h").alias("e_h")), "mix_edge"))

    rows = with_blocks(in_blocks(base), small(blocks), "left")
    rows = rows.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("h") == F.col("e_h")), "left")
    copies = F.col("epochs") + F.when((F.col("partial") == 1) | F.col("e_h").isNotNull(), 1).otherwise(0)
    rows = rows.withColumn("copies", copies.cast("int")).where("copies > 0")
    read = rows.select("row", "source", "n_tokens", "h", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))
    place = F.concat_ws(":", _order("source", F.col("epoch").cast("long"), "block"), "block", _order("source", F.col("epoch").cast("long"), "h"))
    return read.select("row", "n_tokens", "epoch", "block", place.alias("place"))
