"""The engine's logical tables, read from the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(turns: DataFrame) -> DataFrame:
    """segments (video_id, seg_idx, text, words, duration, start, end) of (conv_id, turn, text).

    Half a second for a word; a pause of 2.5 s before every fourth turn.
    """
    by = Window.partitionBy("video_id").orderBy("turn")
    earlier = F.coalesce(F.sum("duration").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pauses = F.count(F.when((F.col("turn") % 4 == 0) & (F.col("turn") > 0), 1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = turns.select(F.col("conv_id").cast("string").alias("video_id"), "turn", "text", T.word_count(F.col("text")).alias("words")).withColumn("duration", F.col("words") * F.lit(0.5))
    rows = rows.withColumn("start", earlier + pauses * F.lit(2.5))
    return rows.select("video_id", F.col("turn").cast("int").alias("seg_idx"), "text", "words", "duration", "start", (F.col("start") + F.col("duration")).alias("end"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(table(spark, sf_dir, "conversations"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, sentence_index, embedding): a label is a video."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("sentence_index"), "embedding")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, username, type, video_id, value, timestamp)."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return events.select("event_id", F.col("user_id").cast("string").alias("username"), F.col("event_type").alias("type"), k.alias("video_id"), "value", F.col("ts").cast("timestamp").alias("timestamp"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_key, username, email, role); the balance stands for what must not be shown."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_key"), F.col("c_name").alias("username"), F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@mail")).alias("email"), F.col("c_mktsegment").alias("role"), F.col("c_acctbal").alias("secret"))


def cache_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, size, last_accessed)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderdate").cast("timestamp").alias("last_accessed"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, status, progress, target_minutes, n_videos, created_at)."""
    o = table(spark, sf_dir, "orders")
    status = F.element_at(F.create_map(*map(F.lit, ("F", "completed", "O", "pending", "P", "fusing"))), F.col("o_orderstatus"))
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.coalesce(status, F.lit("error")).alias("status"), (F.col("o_orderkey") % 101).cast("int").alias("progress"),
        (F.col("o_custkey") % 25).cast("int").alias("target_minutes"), (F.col("o_orderkey") % 13).cast("int").alias("n_videos"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )
