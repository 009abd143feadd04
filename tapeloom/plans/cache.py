"""Queries over cache entries and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import tables
from tapeloom.sources import bindings as B

from .registry import query

ENTRIES = "e AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS size, CAST(o_orderdate AS TIMESTAMP) AS last_accessed FROM orders)"
JOBS = """j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' WHEN 'P' THEN 'fusing' ELSE 'error' END AS status, CAST(o_orderkey % 101 AS INT) AS progress,
CAST(o_custkey % 25 AS INT) AS target_minutes, CAST(o_orderkey % 13 AS INT) AS n_videos, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders)"""
CAP, CUTOFF = 2_000_000_000, "1996-01-01"
STEPS = ("pending", "fusing", "completed")


@query("WITH " + ENTRIES + f""" SELECT id, size, last_accessed < TIMESTAMP '{CUTOFF}' OR sum(size) OVER () - coalesce(sum(size) OVER (ORDER BY last_accessed, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > {CAP} AS evicted FROM e WHERE size > 0""")
def cache_lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = B.cache_entries(spark, sf_dir).where("size > 0")
    return tables.evict(entries, CAP, F.lit(CUTOFF).cast("timestamp")).select("id", "size", "evicted")


@query("WITH " + ENTRIES + " SELECT CAST(year(last_accessed) AS INT) AS year, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes, round(sum(size) / 1048576.0, 2) AS mb, round(100.0 * count(*) FILTER (WHERE id % 4 = 0) / count(*), 1) AS hit_rate FROM e GROUP BY 1")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by year: size, and the share of hits (every fourth id), 0 without requests."""
    hits = F.count_if(F.col("id") % 4 == 0)
    rows = B.cache_entries(spark, sf_dir).groupBy(F.year("last_accessed").alias("year"))
    rate = F.when(F.count("*") > 0, F.round(100.0 * hits / F.count("*"), 1)).otherwise(0.0)
    return rows.agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"), F.round(F.sum("size") / 1048576.0, 2).alias("mb"), rate.alias("hit_rate"))


@query("WITH " + ENTRIES + ", p AS (SELECT CASE id % 3 WHEN 0 THEN 'temp' WHEN 1 THEN 'cache' ELSE 'audio' END AS place, size FROM e) SELECT place, count(*) AS removed, CAST(sum(size) AS BIGINT) AS freed FROM p GROUP BY place UNION ALL SELECT 'all', count(*), CAST(sum(size) AS BIGINT) FROM p")
def cleanup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three places frees, and all together."""
    place = F.when(F.col("id") % 3 == 0, "temp").when(F.col("id") % 3 == 1, "cache").otherwise("audio")
    per = B.cache_entries(spark, sf_dir).groupBy(place.alias("place")).agg(F.count("*").alias("removed"), F.sum("size").alias("freed"))
    return per.unionByName(per.agg(F.lit("all").alias("place"), F.sum("removed").cast("long").alias("removed"), F.sum("freed").cast("long").alias("freed")))


@query("WITH " + ENTRIES + ", d AS (SELECT CASE WHEN id % 2 = 0 THEN 'merge_' ELSE 'keep_' END || id AS name, size, last_accessed AS mtime FROM e) SELECT CAST(date_trunc('month', mtime) AS DATE) AS month, count(*) AS expired, round(sum(size) / 1048576.0, 4) AS freed_mb FROM d WHERE starts_with(name, 'merge_') AND mtime < TIMESTAMP '2000-01-01' - INTERVAL 24 HOUR GROUP BY 1")
def temp_dir_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories with a prefix that are over a day old."""
    d = B.cache_entries(spark, sf_dir).select(F.concat(F.when(F.col("id") % 2 == 0, "merge_").otherwise("keep_"), "id").alias("name"), "size", F.col("last_accessed").alias("mtime"))
    old = d.where(F.col("name").startswith("merge_") & (F.col("mtime") < F.lit("2000-01-01").cast("timestamp") - F.expr("interval 24 hours")))
    return old.groupBy(F.trunc("mtime", "month").alias("month")).agg(F.count("*").alias("expired"), F.round(F.sum("size") / 1048576.0, 4).alias("freed_mb"))


@query("WITH " + JOBS + " SELECT job_id, CASE WHEN job_id % 3 = 0 THEN 'running' WHEN job_id % 2 = 0 THEN status ELSE 'not found' END AS status, CASE WHEN job_id % 3 = 0 THEN 'memory' WHEN job_id % 2 = 0 THEN 'store' END AS found_in FROM j")
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's state from memory, else from the store, else not found."""
    asked = B.jobs(spark, sf_dir).select("job_id")
    memory = asked.where("job_id % 3 = 0").select("job_id", F.lit("running").alias("m"))
    store = B.jobs(spark, sf_dir).where("job_id % 2 = 0").select("job_id", F.col("status").alias("s"))
    rows = asked.join(memory, "job_id", "left").join(store, "job_id", "left")
    return rows.select("job_id", F.coalesce("m", "s", F.lit("not found")).alias("status"), F.when(F.col("m").isNotNull(), "memory").when(F.col("s").isNotNull(), "store").alias("found_in"))


@query("WITH " + JOBS + " SELECT job_id, status, progress, target_minutes, epoch_us(created_at) AS created_us FROM j")
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.jobs(spark, sf_dir).select("job_id", "status", "progress", "target_minutes", F.unix_micros("created_at").alias("created_us"))


@query("WITH " + JOBS + " SELECT status, count(*) AS jobs, status IN ('pending', 'fusing') AS active FROM j GROUP BY status")
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.jobs(spark, sf_dir).groupBy("status").agg(F.count("*").alias("jobs")).withColumn("active", F.col("status").isin("pending", "fusing"))


@query("""SELECT CAST(user_id AS VARCHAR) AS job_id, arg_max(event_type, (ts, event_id)) FILTER (WHERE event_type <> 'error') AS status, arg_max(event_id % 101, (ts, event_id)) FILTER (WHERE event_id % 5 <> 0) AS progress,
epoch_us(max(ts)) AS updated_us FROM events GROUP BY user_id""")
def job_progress_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of changes as one record a job: null fields don't overwrite, the time of change always does."""
    h = B.history(spark, sf_dir)
    log = h.select(F.col("username").alias("job_id"), "timestamp", "event_id", F.when(F.col("type") != "error", F.col("type")).alias("status"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 101).alias("progress"), F.unix_micros("timestamp").alias("updated_us"))
    return tables.last_values(log, "job_id", ["timestamp", "event_id"], ["status", "progress", "updated_us"])


@query("WITH " + JOBS + """ SELECT job_id, CASE WHEN n_videos < 1 THEN 'no_videos' WHEN n_videos > 10 THEN 'too_many_videos' WHEN target_minutes < 5 OR target_minutes > 20 THEN 'bad_duration' END AS error,
30 * n_videos + 60 AS estimated_seconds FROM j""")
def job_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, m = F.col("n_videos"), F.col("target_minutes")
    error = F.when(n < 1, "no_videos").when(n > 10, "too_many_videos").when(~m.between(5, 20), "bad_duration")
    return B.jobs(spark, sf_dir).select("job_id", error.alias("error"), (30 * n + 60).alias("estimated_seconds"))


@query("WITH " + JOBS + " SELECT job_id, CASE WHEN job_id % 2 = 0 THEN '/api/v1/merge/' || job_id || '/audio' END AS audio_url, CASE WHEN job_id % 5 = 0 THEN '/api/v1/merge/' || job_id || '/video' END AS video_url, CAST(CASE WHEN job_id % 7 = 0 THEN 0 ELSE n_videos END AS INT) AS videos FROM j WHERE status = 'completed'")
def job_result_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed jobs: a link where there is a file, and empty lists for missing ones."""
    j = B.jobs(spark, sf_dir).where("status = 'completed'")
    ids = F.when(F.col("job_id") % 7 != 0, F.when(F.col("n_videos") > 0, F.sequence(F.lit(1), F.col("n_videos"))))
    link = lambda every, what: F.when(F.col("job_id") % every == 0, F.concat(F.lit("/api/v1/merge/"), "job_id", F.lit(f"/{what}")))
    return j.select("job_id", link(2, "audio").alias("audio_url"), link(5, "video").alias("video_url"), F.size(F.coalesce(ids, F.array().cast("array<int>"))).alias("videos"))


@query("WITH " + JOBS + " SELECT job_id, CASE WHEN n_videos > 0 THEN 5 + CAST(trunc((progress % (n_videos + 1)) * 1.0 / n_videos * 35) AS INT) ELSE 5 END AS percent FROM j")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of a job in its first stage, by videos done."""
    n, done = F.col("n_videos"), F.col("progress") % (F.col("n_videos") + 1)
    return B.jobs(spark, sf_dir).select("job_id", F.when(n > 0, 5 + (done * 1.0 / n * 35).cast("int")).otherwise(5).alias("percent"))


@query("WITH " + JOBS + """, s AS (SELECT unnest(['pending', 'fusing', 'completed']) AS step, unnest([1, 2, 3]) AS k), c AS (SELECT job_id, status, list_position(['pending', 'fusing', 'completed'], status) AS place FROM j)
SELECT job_id, step, CASE WHEN k < place THEN 'complete' WHEN k = place THEN 'active' ELSE 'pending' END AS state, CASE status WHEN 'pending' THEN 5 WHEN 'fusing' THEN 3 WHEN 'completed' THEN 0 ELSE 10 END AS poll_seconds FROM c, s""")
def job_step_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step of a job as complete, active or pending by its place, and how often to ask."""
    at = F.array_position(F.array(*map(F.lit, STEPS)), F.col("status"))
    steps = F.posexplode(F.array(*map(F.lit, STEPS)))
    poll = F.when(F.col("status") == "pending", 5).when(F.col("status") == "fusing", 3).when(F.col("status") == "completed", 0).otherwise(10)
    rows = B.jobs(spark, sf_dir).select("job_id", at.alias("at"), poll.alias("poll_seconds"), steps.alias("k", "step"))
    state = F.when(F.col("k") + 1 < F.col("at"), "complete").when(F.col("k") + 1 == F.col("at"), "active").otherwise("pending")
    return rows.select("job_id", "step", state.alias("state"), "poll_seconds")


@query("SELECT CAST(c.conv_id AS VARCHAR) AS video_id, CAST(c.turn AS INT) AS seg_idx FROM conversations c WHERE c.conv_id NOT IN (SELECT e.vec_id FROM embeddings e WHERE e.label = 0)")
def failed_source_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of videos that didn't fail to load (those whose vector has label 0)."""
    failed = B.table(spark, sf_dir, "embeddings").where("label = 0").select(F.col("vec_id").cast("string").alias("video_id"))
    return B.segments(spark, sf_dir).join(failed, "video_id", "left_anti").select("video_id", "seg_idx")


@query("WITH " + ENTRIES + """ SELECT id, size, CASE WHEN id % 4 = 0 THEN epoch_us(TIMESTAMP '2001-02-03 04:05:06' + INTERVAL (id % 1000) SECOND) WHEN id % 4 = 1 THEN epoch_us(TIMESTAMP '2000-01-01 00:00:00' + INTERVAL (id % 1000) SECOND) ELSE epoch_us(last_accessed) END AS accessed_us
FROM e WHERE id % 7 <> 3""")
def cache_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached files with when they were used: by their metadata (last_accessed, else downloaded_at), else by the file's time.

    Metadata is missing or unreadable for some; directories without a file don't count.
    """
    e = B.cache_entries(spark, sf_dir)
    k = F.col("id")
    iso = lambda base: F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(base).cast("timestamp")) + k % 1000), "yyyy-MM-dd'T'HH:mm:ss")
    noted = F.when(k % 4 == 0, F.to_json(F.struct(iso("2001-02-03 04:05:06").alias("last_accessed"), F.lit("1999-01-01T00:00:00").alias("downloaded_at")))).when(k % 4 == 1, F.to_json(F.struct(iso("2000-01-01 00:00:00").alias("downloaded_at"))))
    metadata = e.select("id", F.coalesce(noted, F.when(k % 4 == 2, F.lit('{"last_accessed": "yesterday"}'))).alias("json")).where("json is not null")
    files = e.where("id % 7 <> 3").select("id", "size", F.col("last_accessed").alias("mtime"))
    used = F.try_to_timestamp(F.coalesce(F.get_json_object("json", "$.last_accessed"), F.get_json_object("json", "$.downloaded_at")))
    return files.join(metadata, "id", "left").select("id", "size", F.unix_micros(F.coalesce(used, "mtime")).alias("accessed_us"))


@query("WITH " + JOBS + """ SELECT job_id, CASE WHEN v NOT IN ('alloy', 'echo', 'fable') THEN 'bad_voice' WHEN job_id % 9 = 0 THEN 'empty_text' WHEN job_id % 9000 > 5000 THEN 'long_text' END AS error FROM (SELECT job_id, (['alloy', 'echo', 'fable', 'none'])[job_id % 4 + 1] AS v FROM j)""")
def voice_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to speak a text: a known voice, and a text that is neither empty nor too long."""
    k = F.col("job_id")
    rows = B.jobs(spark, sf_dir).select("job_id", F.get(F.array(*map(F.lit, ("alloy", "echo", "fable", "none"))), (k % 4).cast("int")).alias("voice"), F.when(k % 9 == 0, 0).otherwise(k % 9000).alias("chars"))
    error = F.when(~F.col("voice").isin("alloy", "echo", "fable"), "bad_voice").when(F.col("chars") == 0, "empty_text").when(F.col("chars") > 5000, "long_text")
    return rows.select("job_id", error.alias("error"))
