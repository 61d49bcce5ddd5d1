"""Jobs, workers and event streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import jobs as J
from scriptorium.registry import query
from scriptorium.streaming import events as S

from .base import table

_STATUS = {"signup": "pending", "view": "running", "click": "pending", "purchase": "done", "error": "failed"}
_JOBS = "SELECT event_id AS job_id, ts AS created_at, ts AS started_at, user_id % 5 AS job_type, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items()) + " END AS status, event_id % 5 AS retry FROM events"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("job_id"), F.col("ts").alias("created_at"), F.col("ts").alias("started_at"), (F.col("user_id") % 5).alias("job_type"), names[F.col("event_type")].alias("status"), (F.col("event_id") % 5).alias("retry"))


@query("job_claim_fifo", f"SELECT job_type, job_id, 'running' AS status FROM ({_JOBS}) WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY job_type ORDER BY created_at, job_id) = 1")
def job_claim_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.claim(_jobs(spark, sf_dir), ["job_type"]).select("job_type", "job_id", "status")


@query("job_recover", f"SELECT job_id, CASE WHEN s THEN 'pending' ELSE status END AS status, (retry + s::INT)::BIGINT AS retry FROM (SELECT *, status = 'running' AND started_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE AND retry < 3 AS s FROM ({_JOBS}))")
def job_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recover(_jobs(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("job_id", "status", "retry")


@query("worker_last_heartbeat", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY 1")
def worker_last_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_heartbeat(table(spark, sf_dir, "events")).select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query(
    "state_transitions",
    f"""WITH s AS (SELECT job_type, lag(status) OVER w AS old, status AS new FROM ({_JOBS}) WINDOW w AS (PARTITION BY job_type ORDER BY created_at, job_id))
SELECT old, new, count(*)::BIGINT AS n, (old = 'pending' AND new = 'running') OR (old = 'running' AND new IN ('done', 'failed', 'pending')) OR (old = 'failed' AND new = 'pending') AS allowed FROM s WHERE old IS NOT NULL GROUP BY ALL""",
)
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("status").over(Window.partitionBy("job_type").orderBy("created_at", "job_id"))
    s = _jobs(spark, sf_dir).select(before.alias("old"), F.col("status").alias("new")).where("old is not null")
    return s.groupBy("old", "new").agg(F.count("*").alias("n")).withColumn("allowed", J.allowed(F.col("old"), F.col("new")))


@query("failure_cascade", f"SELECT job_type AS doc_id, max((status = 'failed')::INT)::BIGINT AS failed FROM ({_JOBS}) GROUP BY 1")
def failure_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).groupBy(F.col("job_type").alias("doc_id")).agg(F.max((F.col("status") == "failed").cast("long")).alias("failed"))


@query("stream_status_windows", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_status_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = S.drain(spark, S.status_windows(S.read(spark, f"{sf_dir}/events.parquet")), "complete")
    return done.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_heartbeat_dedup", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_heartbeat_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drain(spark, S.last_heartbeat(S.read(spark, f"{sf_dir}/events.parquet")), "complete").select("user_id", "event_id")


@query("stream_sessions", """WITH g AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 6 HOUR OR ts = lag(ts) OVER w + INTERVAL 6 HOUR, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = S.drain(spark, S.sessions(S.read(spark, f"{sf_dir}/events.parquet")), "complete")
    return done.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("session_liveness", "SELECT user_id, count(*)::BIGINT AS events, date_diff('day', min(ts), max(ts))::BIGINT AS days FROM events GROUP BY 1")
def session_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("days"))
