"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.plans.broadcasts import small  # noqa: F401  the operators' own name for it

SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as long; null text has none."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed.isNull() | (trimmed == ""), 0).otherwise(F.size(F.split(trimmed, "[ \t-\r]+", -1))).cast("long")
