"""An index of text vectors that is written, appended to, recovered and searched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import text as T
from tapeloom.operators.embedding import Embedder, embedded
from tapeloom.sources import versions

SCHEMA = "video_id string, place long, text string, embedding array<float>"
#: Questions of a search at most: their vectors are sent to all tasks.
MOST_QUESTIONS = 10_000


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The index as far as its versions are sound; empty if there is none."""
    return versions.read(spark, folder, SCHEMA)


def append(texts: DataFrame, folder: str, embedder: Embedder, least_words: int = 3) -> int:
    """Adds the texts (video_id, place, text) of videos that the index doesn't hold, those of `least_words` words or more.

    The number of texts added; no version is written if there is none.
    """
    spark = texts.sparkSession
    known = load(spark, folder).select("video_id").distinct()
    new = texts.select(F.col("video_id").cast("string"), F.col("place").cast("long"), "text").where(T.word_count(F.col("text")) >= least_words).join(known, "video_id", "left_anti")
    return 0 if new.isEmpty() else versions.write(embedded(new, embedder), folder, versions.following(spark, folder))


def search(index: DataFrame, questions: DataFrame, embedder: Embedder, k: int = 10) -> DataFrame:
    """(question, rank, video_id, place, score): of all texts, the k most like each question (question, text), from 1 to 50.

    Every vector is held against every question (exact); a task gives its own k best of each, from which the k best are
    taken. Questions are sent to all tasks, so there may be MOST_QUESTIONS of them.
    """
    k = min(max(k, 1), 50)
    asked = questions.select(F.col("question").cast("long").alias("question"), F.coalesce("text", F.lit("")).alias("text")).limit(MOST_QUESTIONS + 1).collect()
    if len(asked) > MOST_QUESTIONS:
        raise ValueError(f"more than {MOST_QUESTIONS} questions at once")
    ids = np.array([r["question"] for r in asked], np.int64)
    sent = index.sparkSession.sparkContext.broadcast(embedder.encode([r["text"] for r in asked]) if asked else np.empty((0, embedder.dimension)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        best: list[list[tuple[float, str, int]]] = [[] for _ in ids]
        for batch in batches:
            lists = batch.column(2)
            v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, q.shape[1])
            videos, places = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            scores = np.round(q @ v.T, 4) + 0.0
            for i, row in enumerate(scores):
                least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -2.0
                best[i] = sorted([*best[i], *((-row[j], videos[j], places[j]) for j in np.flatnonzero(row >= least))])[:k]
        rows = [(i, v, p, -s) for i, found in zip(ids.tolist(), best, strict=True) for s, v, p in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["question", "video_id", "place", "score"])

    near = index.select("video_id", "place", "embedding").mapInArrow(run, "question long, video_id string, place long, score double")
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "video_id", "place"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("question", F.col("rank").cast("long").alias("rank"), "video_id", "place", "score")
