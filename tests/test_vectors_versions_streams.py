"""Embedders, the vector index and its recovery, merges, nearest values, summaries by rounds, and streams that restart."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions.stopwords import STOP_WORDS
from tapeloom.operators import embedding, summaries, tables, vector_index
from tapeloom.sources import readers, versions
from tapeloom.streaming import streams

# ---- vectors


def plain_vector(text, dimension, weights=None):
    v = np.zeros(dimension)
    for w in re.findall(r"\w+", text.lower()):
        marked = f"<{w}>"
        for f in ["=" + w, *(marked[i : i + 3] for i in range(len(marked) - 2))]:
            h = int(hashlib.md5(f.encode()).hexdigest()[:8], 16)
            v[h % dimension] += (1 - 2 * (h // dimension % 2)) * (1.0 if weights is None else weights[h % embedding.BUCKETS])
    return v / max(np.linalg.norm(v), 1e-9)


def test_hashing_as_a_plain_one(spark):
    texts = ["The cat sat", "", "é ﬁ 日本 x_1", "the the the", " ... "]
    e = embedding.HashingEmbedder(48)
    assert np.allclose(e.encode(texts), [plain_vector(t, 48) for t in texts])
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "k long, text string").repartition(3)
    weighted = embedding.HashingEmbedder(48).fitted(frame)
    n_the = sum("the" in t.lower().split() for t in texts)
    bucket = int(hashlib.md5(b"=the").hexdigest()[:8], 16) % embedding.BUCKETS
    assert weighted.weights[bucket] == pytest.approx(np.log(7 / (1 + n_the)) + 1)
    out = {r["k"]: r["embedding"] for r in embedding.embedded(frame, weighted).collect()}
    assert all(np.allclose(out[i], plain_vector(t, 48, weighted.weights), atol=1e-6) for i, t in enumerate(texts)) and not any(out[5])


def test_likeness_to_the_own_summary_by_any_embedder(spark):
    class Lengths:
        """Another embedder: a text is as like another as their lengths agree."""

        dimension = 2

        def encode(self, texts):
            angle = np.array([len(t) for t in texts], float) / 10
            return np.stack([np.cos(angle), np.sin(angle)], axis=1)

    rows = spark.createDataFrame([(1, "abc"), (1, None), (2, "abcde"), (3, "abc"), (None, "x")], "job long, text string").repartition(2)
    told = spark.createDataFrame([(1, ["abcd", "abcdefgh"]), (2, ["a"]), (3, [])], "job long, sentences array<string>")
    out = {(r["job"], r["text"]): r["best"] for r in embedding.likeness(rows, "job", told, Lengths()).collect()}
    assert out[1, "abc"] == pytest.approx(np.cos(0.1)) and out[1, None] == pytest.approx(np.cos(0.4)) and out[2, "abcde"] == pytest.approx(np.cos(0.4))
    assert out[3, "abc"] is None and out[None, "x"] is None


def test_stop_words():
    assert len(STOP_WORDS) == 318 and {"the", "wherever", "nevertheless", "yourselves", "cannot"} <= set(STOP_WORDS)


# ---- the index


def test_index_grows_and_recovers(spark, tmp_path):
    folder, e = str(tmp_path / "index"), embedding.HashingEmbedder(32)
    texts = lambda *rows: spark.createDataFrame(list(rows), "video_id string, place long, text string")
    assert vector_index.load(spark, folder).collect() == []
    assert vector_index.append(texts(("a", 0, "one two three"), ("a", 1, "too short")), folder, e) == 1
    assert vector_index.append(texts(("a", 2, "known videos stay as they are"), ("b", 0, "four five six"), ("c", 0, "seven eight nine ten")), folder, e) == 2
    assert vector_index.append(texts(("a", 3, "nothing new in here")), folder, e) == 0
    names = lambda: sorted(r["video_id"] for r in vector_index.load(spark, folder).collect())
    assert names() == ["a", "b", "c"]
    found = vector_index.search(vector_index.load(spark, folder), spark.createDataFrame([(7, "four five six"), (8, None)], "question long, text string"), e, 2).orderBy("question", "rank").collect()
    assert (found[0]["video_id"], found[0]["score"]) == ("b", 1.0) and [r["question"] for r in found] == [7, 7, 8, 8] and found[2]["score"] == 0.0
    # a write that broke off, a file cut short, one gone, a pointer that can't be read
    texts(("d", 0, "x")).write.parquet(f"{folder}/v2")
    assert names() == ["a", "b", "c"] and versions.following(spark, folder) == 3
    part = next((tmp_path / "index/v1").glob("part-*.parquet"))
    whole = part.read_bytes()
    part.write_bytes(whole[: len(whole) // 2])
    assert names() == ["a"]
    part.write_bytes(b"\0" * len(whole))
    assert names() == ["a"]
    part.unlink()
    assert names() == ["a"]
    (tmp_path / "index/pointers/0.json").write_text("{")
    assert names() == [] and vector_index.append(texts(("e", 0, "begun once more again")), folder, e) == 1 and names() == ["e"]


def test_damaged_table_is_empty(spark, tmp_path):
    spark.createDataFrame([(1,)], "k long").coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("part-*.parquet")).write_bytes(b"no parquet")
    assert readers.read_or_empty(spark, str(tmp_path / "t"), "k long").collect() == []


# ---- tables


def test_merge_and_its_counts(spark):
    old = spark.createDataFrame([(k, f"n{k}", None if k == 3 else "x") for k in range(1, 7)], "k long, name string, role string")
    changes = spark.createDataFrame([(1, "set", "new", None), (2, "set", "n2", "x"), (3, "set", None, "r"), (4, "delete", None, None), (9, "set", "a", "b"), (10, "upsert", "u", None), (5, "upsert", None, "y"), (11, "delete", None, None)], "k long, action string, name string, role string")
    tagged = tables.merge(old, changes, "k")
    assert sorted(map(tuple, tables.merged(tagged).collect())) == [(1, "new", "x"), (2, "n2", "x"), (3, "n3", "r"), (5, "n5", "y"), (6, "n6", "x"), (10, "u", None)]
    assert tuple(tables.merge_counts(tagged).first()) == (5, 3, 1, 1, 2)
    assert tuple(tables.merge_counts(tables.merge(old, changes.limit(0), "k")).first()) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize("slots", [1, 3, 64])
def test_nearest_of_a_table(spark, slots):
    own = random.Random(slots)
    known = [own.choice([own.uniform(-50, 50), own.randint(-9, 9), 1e6]) for _ in range(40)]
    asked = [None, 0.0, -1e9, 1e9, *known[:5], *(own.uniform(-60, 60) for _ in range(200))] + [3.25] * 50
    rows = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(asked)], "i long, v double").repartition(3)
    out = {r["i"]: r["nearest"] for r in tables.nearest(rows, spark.createDataFrame([(float(v),) for v in [*known, *known]] + [(None,)], "v double"), "v", slots).collect()}
    assert out == {i: None if v is None else min(known, key=lambda k: (abs(k - v), k)) for i, v in enumerate(asked)}
    assert {r["nearest"] for r in tables.nearest(rows, rows.limit(0), "v", slots).collect()} == {None}


def test_a_cascade_of_sources(spark):
    tiers = [[("a", 1), ("a", 2)], [("a", 3), ("b", 4)], [("a", 5), ("b", 6), ("c", 7), ("c", 8)]]
    out = tables.first_source([spark.createDataFrame(t, "k string, n long") for t in tiers], "k")
    assert sorted(map(tuple, out.collect())) == [("a", 1, 1), ("a", 2, 1), ("b", 4, 2), ("c", 7, 3), ("c", 8, 3)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") >= 2


# ---- summaries


def plain_summary(text, target, chunk_words):
    words = re.sub(r"\s+", " ", text or "").strip()
    words = words.split() if len(words) > 10 else []
    for depth in range(4):
        n = len(words)
        if n <= target * 1.15:
            return words
        if depth == 3:
            return words[:target] if n <= chunk_words * 1.2 else words
        chunks = []
        for s in re.split(r"(?<=[.!?])\s+", " ".join(words)):
            s = s.split()
            if chunks and len(chunks[-1]) + len(s) <= chunk_words:
                chunks[-1] = chunks[-1] + s
            else:
                chunks.append(s)
        if len(chunks) == 1:
            return words[:target]
        share = max(50, target // len(chunks))
        words = [w for c in chunks for w in c[: min(max(50, int(share * (len(c) / (n / len(chunks))))), len(c))]]
    raise AssertionError


def test_summaries_as_a_plain_recursion(spark):
    own = random.Random(4)
    texts = [" ".join(own.choice(["a", "be", "sea.", "dog!", "é"]) for _ in range(own.choice([0, 3, 20, 61, 62, 90, 400, 3000]))) for _ in range(60)] + [None, "", "  \n ", "x" * 11, "word " * 500, "end. " * 700]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(3)
    for target, chunk in ((60, 70), (55, 51), (100, 800)):
        out = {r["k"]: r for r in summaries.summarised(rows, "k", target, chunk_words=chunk).collect()}
        assert {k: r["text"].split() for k, r in out.items()} == {k: plain_summary(t, target, chunk) for k, t in enumerate(texts)}
        assert max(r["rounds"] for r in out.values()) >= (2 if chunk < 100 else 1)
    assert summaries.summarised(rows.limit(0), "k", 60).collect() == []


# ---- streams


def batches(spark, folder, schema, rows, n):
    """`rows` as files that arrive one behind another."""
    for k in range(n):
        spark.createDataFrame(rows[k::n] if n == 1 else rows[len(rows) * k // n : len(rows) * (k + 1) // n], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


SNAPSHOTS = "job_id string, seq long, at timestamp, status string, progress int"


def test_progress_tells_changes_until_the_end(spark, tmp_path):
    at = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    said = [("a", "pending", 0), ("b", "pending", 0), ("a", "pending", 0), ("a", "fusing", 10), ("b", "error", 0), ("a", "fusing", 10), ("a", "fusing", 20), ("b", "pending", 5), ("a", "completed", 100), ("a", "completed", 100), ("c", "fusing", 1)]
    rows = [(j, i, at(i).to_pydatetime(), s, p) for i, (j, s, p) in enumerate(said)]
    rows += [("c", 50, at(10_000).to_pydatetime(), "fusing", 1), ("z", 51, at(10_001).to_pydatetime(), "pending", 0), ("z", 52, at(40_000).to_pydatetime(), "pending", 1), ("z", 53, at(80_000).to_pydatetime(), "pending", 2), ("c", 54, at(80_001).to_pydatetime(), "fusing", 1)]
    for n in (1, len(rows)):
        read = batches(spark, str(tmp_path / f"in{n}"), SNAPSHOTS, rows, n)
        out = sorted(r["seq"] for r in streams.all_now(streams.progress_changes(read, idle=20_000.0)).collect())
        # one batch: nothing is past yet; a batch each: c is forgotten between 10,000 and 80,001 and is new again
        assert out == [0, 1, 3, 4, 6, 8, 10, 51, 52, 53, *([54] if n > 1 else [])]


def test_upserts_survive_a_restart(spark, tmp_path):
    """The stream breaks off after it has written a version and before that batch counts as done; then it goes on."""
    schema, folder = "k string, at long, v string", str(tmp_path / "table")
    rows = [(f"k{i % 7}", i, f"v{i}") for i in range(40)]
    read = batches(spark, str(tmp_path / "in"), schema, rows, 4)
    real, calls = versions.write, []

    def breaks(batch, where, number):
        real(batch, where, number)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("lost")

    versions.write = breaks
    try:
        with pytest.raises(Exception, match="lost"):
            streams.upserting(read, "k", ["at"], folder).trigger(availableNow=True).start().awaitTermination()
    finally:
        versions.write = real
    assert calls == [0, 1]
    streams.upserting(read, "k", ["at"], folder).trigger(availableNow=True).start().awaitTermination()
    out = sorted(map(tuple, streams.upserted(spark, folder, schema, "k", ["at"]).collect()))
    assert out == sorted(max((r for r in rows if r[0] == f"k{j}"), key=lambda r: r[1]) for j in range(7))
    assert versions.sound(spark, folder) == [0, 1, 2, 3]


def test_rate_limit_state_goes(spark, tmp_path):
    rows = [("a", i, float(t)) for i, t in enumerate((1_000, 1_001, 1_002, 1_003, 50_000, 50_001, 50_002, 100_000))]
    read = batches(spark, str(tmp_path / "in"), "client string, request_id long, t double", rows, len(rows))
    out = sorted((r["request_id"], r["allowed"]) for r in streams.all_now(streams.rate_limit(read, 100.0, 2)).collect())
    assert [a for _, a in out] == [True, True, False, False, True, True, False, True]


def test_windows_of_a_stream(spark, tmp_path):
    rows = [("view", pd.Timestamp("2024-01-01 10:00").to_pydatetime()), ("view", pd.Timestamp("2024-01-01 10:59").to_pydatetime())]
    read = batches(spark, str(tmp_path / "in"), "type string, timestamp timestamp", rows, 2)
    assert [(r["type"], r["n"]) for r in streams.all_now(streams.history_counts(read), "complete").groupBy("type").agg(F.max("n").alias("n")).collect()] == [("view", 2)]
