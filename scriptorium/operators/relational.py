"""Set-based forms of the listing, counting and latest-row operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(docs: DataFrame, user_id: int | None) -> DataFrame:
    """Rows not deleted, of one user unless ``user_id`` is None (an administrator)."""
    live = docs.where(~F.col("is_deleted"))
    return live if user_id is None else live.where(F.col("user_id") == user_id)


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int, most: int = 50) -> DataFrame:
    """One page of a total order; number from 1, size clamped to 1..most."""
    size = min(max(size, 1), most)
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def value_counts(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def with_counts(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with how many rows of ``other`` share its key, 0 where none do."""
    counts = other.groupBy(key).agg(F.count("*").alias(name))
    return df.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def profile(df: DataFrame) -> DataFrame:
    """(column_name, total, nulls, distinct_values) for every column, in one pass."""
    parts = []
    for c in df.columns:
        parts += [F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.count_distinct(F.col(c).cast("string")).alias(f"d_{c}")]
    row = df.agg(F.count("*").alias("total"), *parts)
    one = [F.struct(F.lit(c).alias("column_name"), F.col("total"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("distinct_values")) for c in df.columns]
    return row.select(F.inline(F.array(*one)))


def advise(profile: DataFrame) -> DataFrame:
    """A profile with what to do about each column: empty ones go, constant ones want a look, the rest stay."""
    filled = F.col("total") - F.col("nulls")
    return profile.withColumn("advice", F.when(filled == 0, "drop: empty").when((F.col("distinct_values") == 1) & (F.col("total") > 1), "review: constant").otherwise("keep"))
