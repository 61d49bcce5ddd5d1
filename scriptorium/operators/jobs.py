"""A job queue and its workers as rows: claim, recovery, heartbeats and guarded transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The transitions a document's status may make.
TRANSITIONS = {"pending": ["running"], "running": ["done", "failed", "pending"], "failed": ["pending"], "done": []}


def claim(jobs: DataFrame, by: list[str]) -> DataFrame:
    """The oldest pending job of each type, to be set running; the least id wins ties."""
    first = Window.partitionBy(*by).orderBy("created_at", "job_id")
    return jobs.where("status = 'pending'").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("status", F.lit("running"))


def recover(jobs: DataFrame, now: Column, minutes: int = 10, retries: int = 3) -> DataFrame:
    """Running jobs older than ``minutes`` with retries left are pending again, once more retried."""
    stuck = (F.col("status") == "running") & (F.col("started_at") < now - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("retry") < retries)
    return jobs.withColumns({"retry": F.when(stuck, F.col("retry") + 1).otherwise(F.col("retry")), "status": F.when(stuck, "pending").otherwise(F.col("status"))})


def allowed(old: Column, new: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    return F.coalesce(F.array_contains(table[old], new), F.lit(False))
