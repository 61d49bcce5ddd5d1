"""Retrieval, answer and recommendation metrics over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def rank_metrics(hits: DataFrame, keys: list[str], k: int, relevant: Column | None = None) -> DataFrame:
    """Per key, from rows (rank, rel 0/1 and any label): p@k with both denominators, r@k, hit@k, mrr, ndcg of both kinds.

    ``relevant`` is the number of relevant items of a key (default: those among
    the hits); ``ndcg_list`` sorts the hits' own labels for its ideal, ``ndcg_set``
    takes min(k, relevant) ones.
    """
    ideal = F.size(F.filter("labels", lambda x: x.rel > 0))
    grouped = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "rel"))).alias("labels"), F.max(relevant if relevant is not None else F.lit(None).cast("int")).alias("total"))
    top = F.filter("labels", lambda x: x.rank <= k)
    good = F.size(F.filter(top, lambda x: x.rel > 0))
    total = F.coalesce("total", ideal)
    dcg = F.aggregate(top, F.lit(0.0), lambda s, x: s + F.when(x.rel > 0, _gain(x.rank)).otherwise(0.0))

    def best(n: Column) -> Column:
        return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + _gain(i))).otherwise(0.0)

    def ratio(ideal_gain: Column) -> Column:
        return F.when(ideal_gain > 0, dcg / ideal_gain).otherwise(0.0)

    first = F.array_min(F.transform(F.filter("labels", lambda x: x.rel > 0), lambda x: x.rank))
    return grouped.select(
        *keys,
        (good / k).alias("precision_k"),
        (good / F.greatest(F.lit(1), F.least(F.lit(k), F.size("labels")))).alias("precision_n"),
        F.when(total > 0, good / total).otherwise(0.0).alias("recall"),
        (good > 0).cast("int").alias("hit"),
        F.coalesce(1 / first, F.lit(0.0)).alias("mrr"),
        ratio(best(F.least(F.lit(k), ideal))).alias("ndcg_list"),
        ratio(best(F.least(F.lit(k), total))).alias("ndcg_set"),
    )


def prf(predicted: DataFrame, gold: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """True and false positives and misses of two edge sets, per ``group`` and overall (group columns null)."""
    p, g = predicted.select(*keys).distinct().withColumn("p", F.lit(1)), gold.select(*keys).distinct().withColumn("g", F.lit(1))
    both = p.join(g, keys, "full_outer")
    n = both.rollup(*group).agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    n = n.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return n.withColumn("f1", f1)
