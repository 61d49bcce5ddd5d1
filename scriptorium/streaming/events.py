"""Event streams: windowed counts, last heartbeats, sessions, and de-duplication under a watermark.

Each function takes a streaming (or batch) DataFrame of events (event_id, ts,
user_id, event_type, value) and returns one; :func:`drain` runs a stream over
the files there are and returns the table it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.plans.scratch import scratch_path

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The events below ``path`` (one Parquet file or a folder of them) as a stream with session-zone timestamps."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(EVENTS)
    stream = reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path) if not name.endswith(".parquet") else reader.parquet(f"{folder}/{name}*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def status_windows(events: DataFrame, window: str = "1 day", late: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def distinct_events(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def last_heartbeat(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drain(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run ``stream`` over all that is there and return its result; ``complete`` results are small by contract."""
    out, state = scratch_path(spark, "stream_out"), scratch_path(spark, "stream_state")
    if mode == "complete":
        def replace(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(out)

        run = stream.writeStream.outputMode("complete").foreachBatch(replace)
    else:
        run = stream.writeStream.outputMode(mode).format("parquet").option("path", out)
    run.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
