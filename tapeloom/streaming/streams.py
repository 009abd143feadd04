"""Structured Streaming: rate limiting and job progress with state, windowed counts, an upserted table."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.operators import tables
from tapeloom.session import checkpoint, shared_folder
from tapeloom.sources import versions

#: States after which a job doesn't change again.
ENDED = ("completed", "error", "partial_success", "cancelled")
#: Groups that a stream's keys are dealt out into. It must stay the same as long as a stream's checkpoint is used.
GROUPS = 256


def rate_limit(requests: DataFrame, window: float, most: int, late: str = "1 hour") -> DataFrame:
    """(client, request_id, t, allowed) of a stream (client, request_id, t): as folds.rate_limit, with state per client.

    State is the times of allowed requests within the window: `most` at most; it goes once the stream's time is past the
    window. Requests are taken in order of t within a micro-batch; over batches, the result is the batch one if a
    client's requests arrive in order. Those that come more than `late` after later ones are dropped.
    """

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0] if state.exists else ())
        rows = pd.concat(list(frames)).sort_values(["t", "request_id"])
        allowed = []
        for t in rows["t"]:
            while times and times[0] <= t - window:
                times.popleft()
            allowed.append(len(times) < most)
            if allowed[-1]:
                times.append(t)
        state.update((list(times),))
        ends = int((max([*times, rows["t"].iloc[-1]]) + window) * 1000) + 1
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "request_id": rows["request_id"], "t": rows["t"], "allowed": allowed})

    timed = requests.withColumn("at", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).withWatermark("at", late)
    return timed.groupBy("client").applyInPandasWithState(run, "client string, request_id long, t double, allowed boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def progress_changes(snapshots: DataFrame, idle: float = 86400.0, late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """(job_id, seq, at, status, progress) of a stream of snapshots (the same): those that differ from the job's last one.

    After a snapshot in one of the ENDED states a job is silent. What is known of a job goes once nothing has come for
    `idle` seconds of the stream's time: a job that comes again then is a new one. Snapshots are taken in order of
    (at, seq) within a micro-batch; those later than `late` are dropped.

    Jobs are dealt out into `groups` by a hash, so that Python is called once for each of these in a micro-batch and not
    for each job. A group's state holds its live jobs: their last status and progress, and when they are forgotten.
    """
    known = ["job_id", "status", "progress", "ends"]

    def run(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = state.getCurrentWatermarkMs()
        before = pd.DataFrame(dict(zip(known, state.get, strict=True)) if state.exists else {k: [] for k in known}).astype({"job_id": object, "status": object, "progress": "Int64", "ends": "int64"})
        parts = [f for f in frames if len(f)]
        after = before
        if parts:
            rows = pd.concat(parts, ignore_index=True).astype({"progress": "Int64"}).sort_values(["job_id", "at", "seq"], ignore_index=True)
            here = before[before["job_id"].isin(rows["job_id"])]
            rows = pd.concat([here[["job_id", "status", "progress"]].assign(old=True), rows.assign(old=False)], ignore_index=True).sort_values("job_id", kind="stable", ignore_index=True)  # what is known comes first
            job = pd.factorize(rows["job_id"], use_na_sentinel=False)[0]
            first, last = (np.r_[True, job[1:] != job[:-1]], np.r_[job[1:] != job[:-1], True])
            status, progress = rows["status"].fillna("").to_numpy(), rows["progress"].fillna(-1).to_numpy("int64")
            same = np.r_[False, (status[1:] == status[:-1]) & (progress[1:] == progress[:-1])] & ~first
            ended = np.isin(status.astype(str), ENDED).astype(np.int64)
            upto = np.cumsum(ended) - ended
            silent = upto > upto[first][np.cumsum(first) - 1]  # an end came before in its job
            told = rows[~(same | silent | rows["old"].to_numpy())]
            now = rows[["job_id", "status", "progress"]][~silent].drop_duplicates("job_id", keep="last")
            ends = (rows["at"][last].dt.as_unit("us").astype("int64") // 1000 + int(idle * 1000)).to_numpy()
            after = pd.concat([before[~before["job_id"].isin(rows["job_id"])], now.assign(ends=np.maximum(ends, past + 1))], ignore_index=True)
            yield told[["job_id", "seq", "at", "status", "progress"]]
        after = after[after["ends"] >= past]
        if not len(after):
            state.remove()
            return
        state.update((after["job_id"].tolist(), after["status"].tolist(), [None if p is pd.NA else int(p) for p in after["progress"]], after["ends"].tolist()))
        state.setTimeoutTimestamp(max(int(after["ends"].min()), past + 1))

    kinds = "job_id string, seq long, at timestamp, status string, progress int"
    dealt = snapshots.withWatermark("at", late).withColumn("dealt", F.pmod(F.xxhash64("job_id"), F.lit(groups)))
    return dealt.groupBy("dealt").applyInPandasWithState(run, kinds, "jobs array<string>, status array<string>, progress array<int>, ends array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def history_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, type, n) of a stream (type, timestamp): events by kind and window; those later than `late` don't count."""
    return events.withWatermark("timestamp", late).groupBy(F.window("timestamp", width), "type").agg(F.count("*").alias("n"))


def latest_jobs(snapshots: DataFrame) -> DataFrame:
    """(job_id, status, progress, updated_at) of a stream of job snapshots: the latest of each, for update mode."""
    last = F.max_by(F.struct("status", "progress", "updated_at"), F.col("updated_at")).alias("s")
    return snapshots.groupBy("job_id").agg(last).select("job_id", "s.*")


def ended_jobs(snapshots: DataFrame) -> DataFrame:
    """Snapshots of jobs that won't change again."""
    return snapshots.where(F.col("status").isin(*ENDED))


def upserting(rows: DataFrame, key: str, order: list[str], folder: str) -> DataStreamWriter:
    """A writer of a stream into a table that holds the latest row of each key: see `upserted`.

    A micro-batch writes its own latest rows as the version of its number. A batch that is done again after a failure
    writes the same version again, so each row counts once; what a batch costs doesn't grow with the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        versions.write(tables.latest(batch, key, order), folder, number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/stream")


def upserted(spark, folder: str, schema: str, key: str, order: list[str]) -> DataFrame:
    """The table that `upserting` writes: of each key, the latest row over all versions."""
    rows = versions.read(spark, folder, schema)
    return tables.latest(rows, key, order).select(*rows.columns)


def all_now(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now: run to its end, each micro-batch a version, and kept as a checkpoint."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, number: versions.write(batch, folder, number) and None)
    writer.option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start().awaitTermination()
    out = checkpoint(versions.read(spark, folder, stream.schema))
    versions.delete(spark, folder)
    return out
