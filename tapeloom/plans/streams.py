"""Streams over the given tables, run to their end, beside the SQL of what they come to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import checkpoint, shared_folder
from tapeloom.sources import bindings as B
from tapeloom.sources import versions
from tapeloom.streaming import streams

from .history import HISTORY, MOST, REQUESTS, WINDOW_S
from .registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    schema = B.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet*")


JOB = """j AS (SELECT user_id || '-' || dayofyear(ts) // 7 AS job_id, event_id AS seq, ts AS "at",
  CASE WHEN event_id % 4 = 0 AND event_type = 'purchase' THEN 'completed' WHEN event_id % 4 = 0 AND event_type = 'error' THEN 'error' WHEN event_type IN ('view', 'purchase') THEN 'fusing' ELSE 'pending' END AS status, CAST(40 * (event_id // 2 % 2) AS INT) AS progress FROM events)"""


@query("WITH " + JOB + """, l AS (SELECT *, lag(status) OVER w AS s, lag(progress) OVER w AS p, coalesce(sum(CASE WHEN status IN ('completed', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY "at", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM j WINDOW w AS (PARTITION BY job_id ORDER BY "at", seq))
SELECT job_id, seq, status, progress FROM l WHERE ended = 0 AND (s IS NULL OR s <> status OR p <> progress)""")
def progress_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of jobs (a user's events of a week) as a stream that tells changes only, up to a job's end."""
    kind, k = F.col("event_type"), F.col("event_id")
    status = F.when((k % 4 == 0) & (kind == "purchase"), "completed").when((k % 4 == 0) & (kind == "error"), "error").when(kind.isin("view", "purchase"), "fusing").otherwise("pending")
    job = F.concat(F.col("user_id"), F.lit("-"), F.expr("dayofyear(ts) div 7"))
    rows = _events(spark, sf_dir).select(job.alias("job_id"), k.alias("seq"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"), (F.expr("event_id div 2") % 2 * 40).cast("int").alias("progress"))
    return streams.all_now(streams.progress_changes(rows)).select("job_id", "seq", "status", "progress")


@query("WITH " + HISTORY + " SELECT username, max(event_id) AS event_id, arg_max(type, event_id) AS type FROM h GROUP BY username")
def history_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of events upserted into a table of each user's last one, by micro-batches that can be done again."""
    folder = f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}"
    rows = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("username"), "event_id", F.col("event_type").alias("type"))
    streams.upserting(rows, "username", ["event_id"], folder).trigger(availableNow=True).start().awaitTermination()
    out = checkpoint(streams.upserted(spark, folder, "username string, event_id long, type string", "username", ["event_id"]))
    versions.delete(spark, folder)
    return out


@query("WITH RECURSIVE " + REQUESTS + f""", o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, request_id) AS i FROM r),
walk AS (
  SELECT client, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS request_id, CAST([] AS DOUBLE[]) AS times, false AS allowed FROM (SELECT DISTINCT client FROM o)
  UNION ALL
  SELECT x.client, x.i, x.request_id, CASE WHEN len(x.recent) < {MOST} THEN list_append(x.recent, x.t) ELSE x.recent END, len(x.recent) < {MOST}
  FROM (SELECT o.*, list_filter(w.times, lambda y: y > o.t - {WINDOW_S}) AS recent FROM walk w JOIN o ON o.client = w.client AND o.i = w.i + 1) x)
SELECT client, request_id, allowed FROM walk WHERE i > 0""")
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests limited as they come: ten a week and client, with state that goes when it is past."""
    requests = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("client"), F.col("event_id").alias("request_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return streams.all_now(streams.rate_limit(requests, WINDOW_S, MOST)).select("client", "request_id", "allowed")


@query("SELECT date_trunc('day', ts) AS day, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def history_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by day and kind as they come."""
    rows = _events(spark, sf_dir).select(F.col("event_type").alias("type"), F.col("ts").cast("timestamp").alias("timestamp"))
    counted = streams.all_now(streams.history_counts(rows, "1 day"), "complete")
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("day"), "type", "n")
