"""Streams against their batch forms, and readers on hand-made rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tapeloom.sources import readers
from tapeloom.streaming import streams

REQUESTS = "client string, request_id long, t double"


def plain_limit(times, window, most):
    kept, out = [], []
    for t in times:
        kept = [x for x in kept if x > t - window]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out


def run(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return query


def test_rate_limit_keeps_state_over_batches(spark, tmp_path):
    rows = [(c, i, float(3 * i + len(c))) for i in range(30) for c in ("a", "bb")]
    for k in range(3):
        part = [r for r in rows if r[1] // 10 == k]
        spark.createDataFrame(part, REQUESTS).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    read = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run(streams.rate_limit(read, 20.0, 3), "limited", "append")
    out = spark.table("limited").toPandas()
    for client, part in out.groupby("client"):
        part = part.sort_values("request_id")
        assert list(part["allowed"]) == plain_limit(list(part["t"]), 20.0, 3), client
    assert len(out) == 60 and 0 < out["allowed"].sum() < 60


def test_counts_and_latest_jobs(spark, tmp_path):
    at = pd.Timestamp("2024-01-01 10:10:00")
    events = pd.DataFrame({"type": ["view", "view", "click"], "timestamp": [at, at + pd.Timedelta(minutes=5), at + pd.Timedelta(hours=1)]})
    spark.createDataFrame(events).coalesce(1).write.parquet(str(tmp_path / "events"))
    read = spark.readStream.schema("type string, timestamp timestamp").parquet(str(tmp_path / "events"))
    run(streams.history_counts(read), "counted", "complete")
    assert {(r["type"], r["n"]) for r in spark.table("counted").collect()} == {("view", 2), ("click", 1)}
    jobs = "job_id long, status string, progress int, updated_at timestamp"
    spark.sql("select 1L job_id, 'fusing' status, 40 progress, timestamp'2024-01-01 00:00:01' updated_at union all select 1L, 'completed', 100, timestamp'2024-01-01 00:00:02'").coalesce(1).write.parquet(str(tmp_path / "jobs"))
    read = spark.readStream.schema(jobs).parquet(str(tmp_path / "jobs"))
    run(streams.latest_jobs(read), "latest", "update")
    assert [(r["job_id"], r["status"], r["progress"]) for r in spark.table("latest").collect()] == [(1, "completed", 100)]
    assert streams.ended_jobs(spark.table("latest")).count() == 1


def test_readers_on_odd_rows(spark):
    json = '{"events":[{"tStartMs":1500,"dDurationMs":500,"segs":[{"utf8":"a"},{"utf8":" b"}]},{"tStartMs":9},{"segs":[{"utf8":" "}]}]}'
    rows = spark.createDataFrame([(1, json), (2, None), (3, "not json")], "k long, x string")
    assert [tuple(r)[2:] for r in readers.subtitles(rows, "k", "x").collect()] == [("a b", 1.5, 0.5)]
    xml = '<transcript><text start="1" dur="2">a &amp; b\nc</text><text start="4">d</text></transcript>'
    rows = spark.createDataFrame([(1, xml), (2, None)], "k long, x string")
    assert [tuple(r)[2:] for r in readers.timed_text(rows, "k", "x").orderBy("seg_idx").collect()] == [("a & b c", 1.0, 2.0), ("d", 4.0, 0.0)]
    clips = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 1.0), (3, 2.0, 1.0), (4, None, 1.0)], "k long, start double, end double")
    good, rejected = readers.validated(clips)
    assert [r["k"] for r in good.collect()] == [1] and rejected.where(F.col("reason").isNotNull()).count() == 3
