"""Operators and readers against plain versions on small inputs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import folds, fusion, summaries
from tapeloom.sources import readers


def plain_linkage(vectors, clusters):
    """Joins the two clusters of the least mean cosine distance until so many are left."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    groups = [[i] for i in range(len(vectors))]
    while len(groups) > clusters:
        far = lambda p: np.mean([1 - unit[i] @ unit[j] for i in groups[p[0]] for j in groups[p[1]]])
        a, b = min(itertools.combinations(range(len(groups)), 2), key=far)
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 40])
def test_average_linkage(n):
    rng = np.random.default_rng(n)
    vectors = rng.normal(0, 1, (n, 8)) + np.repeat(rng.normal(0, 2, (-(-n // 4), 8)), 4, axis=0)[:n]
    for clusters in {1, max(1, n // 5), max(1, n // 2), n}:
        label = fusion.average_linkage(vectors, clusters)
        assert {frozenset(np.flatnonzero(label == k).tolist()) for k in set(label)} == plain_linkage(vectors, clusters)


def test_large_jobs_are_clustered():
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 4, (6, 16))
    kind = rng.integers(0, 6, 9_000)
    label = fusion.average_linkage(middle[kind] + rng.normal(0, 0.3, (9_000, 16)), 6)
    assert len({(a, b) for a, b in zip(label, kind, strict=True)}) == 6


def test_topic_clusters_of_each_job(spark):
    rng = np.random.default_rng(2)
    rows = [(j, p, [float(x) for x in rng.normal(0, 1, 6)]) for j, n in ((1, 2), (2, 26), (3, 40)) for p in range(n)]
    out = fusion.topic_clusters(spark.createDataFrame(rows, "job int, pos long, embedding array<float>"), "job", "pos").collect()
    for j, clusters in ((1, 2), (2, 5), (3, 8)):
        mine = {r["pos"]: r["cluster"] for r in out if r["job"] == j}
        vectors = np.array([v for k, _, v in rows if k == j], np.float32).astype(float)
        assert {frozenset(p for p in mine if mine[p] == c) for c in set(mine.values())} == plain_linkage(vectors, clusters)


def test_topic_clusters_of_a_large_job_in_rounds(spark):
    """Jobs over the bound are joined by blocks in rounds, down to the bound or to the end; others beside them as ever."""
    rng = np.random.default_rng(4)
    rows = [(j, 3 * p + 1, [float(x) for x in rng.normal(0, 1, 5) + (p % 4)]) for j, n in ((1, 2), (2, 9), (3, 47), (4, 60)) for p in range(n)]
    frame = spark.createDataFrame(rows, "job int, pos long, embedding array<double>").repartition(3)
    for local, block in ((10, 7), (1, 60)):
        out = fusion.topic_clusters(frame, "job", "pos", local, block).collect()
        for j, clusters in ((1, 2), (2, 3), (3, 9), (4, 12)):
            mine = {r["pos"]: r["cluster"] for r in out if r["job"] == j}
            vectors = np.array([v for k, _, v in rows if k == j])
            assert {frozenset((p - 1) // 3 for p in mine if mine[p] == c) for c in set(mine.values())} == plain_linkage(vectors, clusters)
            first = [min(p for p in mine if mine[p] == c) for c in range(clusters)]
            assert first == sorted(first)


def test_packed(spark):
    own = random.Random(5)
    lists = [[own.randint(0, 12) for _ in range(own.randint(0, 30))] for _ in range(60)] + [[], [50], [3, 50, 3]]
    rows = spark.createDataFrame(list(enumerate(lists)), "k int, sizes array<int>")
    for separator in (0, 1):
        out = {r["k"]: [(x["items"], x["size"]) for x in r["p"]] for r in rows.select("k", folds.packed(F.col("sizes"), 20, separator).alias("p")).collect()}
        for k, sizes in enumerate(lists):
            plain = []
            for n in sizes:
                if plain and plain[-1][1] + separator + n <= 20:
                    plain[-1] = (plain[-1][0] + 1, plain[-1][1] + separator + n)
                else:
                    plain.append((1, n))
            assert out[k] == plain


def test_leaders(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (300, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(int(i % 3), i, [float(x) for x in v[i]]) for i in range(300)]
    out = folds.leaders(spark.createDataFrame(rows, "cluster int, pos long, embedding array<double>"), "cluster", F.col("pos"), 0.6).collect()
    for c in range(3):
        kept = []
        for i in range(c, 300, 3):
            if not any(v[i] @ v[k] >= 0.6 for k in kept):
                kept.append(i)
        assert sorted(r["pos"] for r in out if r["cluster"] == c) == kept


def test_rate_limit_of_many_clients(spark):
    own = random.Random(8)
    rows = [(f"c{own.randint(0, 5)}", i, float(own.randint(0, 400))) for i in range(900)]
    out = {r["request_id"]: r["allowed"] for r in folds.rate_limit(spark.createDataFrame(rows, "client string, request_id long, t double").repartition(5), 30.0, 4).collect()}
    for c in {r[0] for r in rows}:
        times = []
        for _, i, t in sorted((r for r in rows if r[0] == c), key=lambda r: (r[2], r[1])):
            times = [x for x in times if x > t - 30.0]
            assert out[i] == (len(times) < 4)
            times += [t] * (len(times) < 4)


def test_cache_of_files(spark, tmp_path):
    one = [("v1", [("a", 0.0, 1.0)], "a", "2024-01-01"), ("v2", [], "", None)]
    rows = spark.createDataFrame(one, readers.SEGMENTS)
    readers.write_cache(rows.coalesce(1), str(tmp_path / "cache"))
    back = readers.cached_transcripts(spark, str(tmp_path / "cache/json")).orderBy("video_id").collect()
    assert [(r["video_id"], r["full_text"], len(r["segments"] or [])) for r in back] == [("v1", "a", 1), ("v2", "", 0)]
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "cache/text")).collect()) == ["", "a"]
    for name in ("x.json", "y.json", "z.txt"):
        (tmp_path / name).write_text("{}")
    assert sorted(r["key"] for r in readers.cached_keys(spark, str(tmp_path)).collect()) == ["x", "y"]


def test_index_is_read_or_begun(spark, tmp_path):
    path, kind = str(tmp_path / "index"), "vec_id long, text string"
    assert readers.read_or_empty(spark, path, kind).collect() == []
    spark.createDataFrame([(1, "a")], kind).write.parquet(path)
    assert [tuple(r) for r in readers.read_or_empty(spark, path, kind).collect()] == [(1, "a")]


def test_caption_urls(spark):
    pages = [(1, '<script>{"captionTracks":[{"baseUrl":"u1"}]}</script>'), (2, 'ytInitialPlayerResponse = {"captions":{"playerCaptionsTracklistRenderer":{"captionTracks":[{"baseUrl":"u2"}]}}};'), (3, "<p>none</p>"), (4, None)]
    out = spark.createDataFrame(pages, "k long, html string").select("k", readers.caption_url(F.col("html")).alias("u")).collect()
    assert {r["k"]: r["u"] for r in out} == {1: "u1", 2: "u2", 3: None, 4: None}


def test_odd_answers_of_a_model(spark):
    """Nested braces, escaped quotes, broken fences, numbers as strings, quotes and chapters of the wrong kind."""
    body = '{"summary": "a \\"b\\" {c} \\u00e9", "tldr": null, "key_takeaways": ["x", "y}"], "best_quotes": ["q", {"text": "t {", "speaker": "p"}, {"speaker": "nobody"}], "chapters": [{"title": "c", "text": "{}"}, "x", {"text": "only"}]}'
    answers = [body, f"```json\n{body}\n```", f"```\n{body}```", f"Sure: {body} Bye }} not", f"```json\n{body}", "{broken", "", None, '{"summary": 5}', "[1, 2]"]
    out = [r["a"] for r in spark.createDataFrame(list(enumerate(answers)), "k long, x string").select("k", summaries.tolerant(F.col("x")).alias("a")).orderBy("k").collect()]
    for a in out[:5]:  # what follows a whole object is passed over
        assert a["summary"] == 'a "b" {c} é' and a["tldr"] == "" and a["key_takeaways"] == ["x", "y}"]
        assert [tuple(q) for q in a["best_quotes"]] == [("q", ""), ("t {", "p"), ("", "nobody")] and [tuple(c) for c in a["chapters"]] == [("c", "{}"), ("", "only")]
    assert [out[k]["summary"] for k in (5, 6, 9)] == ["{broken", "", "[1, 2]"] and out[7]["summary"] is None and out[8]["summary"] == "5"
    lists = ['[{"start": "1.5", "end": 3}, {"start": 4, "end": "x"}, {"start": 1}]', 'Here: [{"start": 0, "end": 2, "score": "0.25"}] ok', "none", None, "[not json]", '[{"start": 1, "end": 2, "score": null}]']
    rows = spark.createDataFrame(list(enumerate(lists)), "k long, x string").select("k", summaries.highlight_rows(F.col("x")).alias("h")).orderBy("k").collect()
    assert [[tuple(h) for h in r["h"] or []] for r in rows] == [[(1.5, 3.0, 0.5)], [(0.0, 2.0, 0.25)], [], [], [], [(1.0, 2.0, 0.5)]]
