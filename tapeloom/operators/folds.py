"""Folds over ordered rows: operators whose decisions depend on earlier ones.

Where a key's rows are few by nature (the segments of a video, the videos of a job), they are collected into one sorted
array and folded by Spark's aggregate. Where they aren't (requests of a client, vectors of a cluster), they are dealt out
by key, sorted, and read as a stream that carries a bounded state.
"""

from __future__ import annotations

import itertools
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_fold(rows: DataFrame, keys: list[str], order: list[Column], payload: list[Column], zero: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> DataFrame:
    """(keys, out): the fold of each key's rows in order. A step sees the fields of `payload`."""
    row = F.struct(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("__o"), *payload)
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    out = F.aggregate("__rows", zero, step, finish) if finish else F.aggregate("__rows", zero, step)
    return grouped.select(*keys, out.alias("out"))


BLOCK = "struct<start:double,end:double,words:int,text:string>"


def group_segments(segments: DataFrame, max_gap: float = 2.0, max_words: int = 40, least: float = 5.0, most: float = 45.0) -> DataFrame:
    """(video_id, start, end, words, text): runs of segments (video_id, seg_idx, text, words, start, end).

    Blank texts don't count. A run ends before a segment that follows a pause of more than `max_gap` seconds, or once it
    holds `max_words` words. Runs shorter than `least` seconds go; longer ones end after `most` seconds.
    """
    open_ = F.lit(None).cast(BLOCK)
    zero = F.struct(F.array().cast(f"array<{BLOCK}>").alias("done"), open_.alias("open"))

    def closed(done: Column, block: Column) -> Column:
        kept = block.isNotNull() & (block["end"] - block["start"] >= least)
        cut = F.struct(block["start"].alias("start"), F.least(block["end"], block["start"] + most).alias("end"), block["words"].alias("words"), block["text"].alias("text"))
        return F.when(kept, F.concat(done, F.array(cut))).otherwise(done)

    def step(a: Column, x: Column) -> Column:
        new = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["words"].cast("int").alias("words"), x["text"].alias("text"))
        o = a["open"]
        longer = F.struct(o["start"].alias("start"), x["end"].alias("end"), (o["words"] + x["words"]).cast("int").alias("words"), F.concat_ws(" ", o["text"], x["text"]).alias("text"))
        ends = o.isNotNull() & ((x["start"] - o["end"] > max_gap) | (o["words"] >= max_words))
        return F.struct(F.when(ends, closed(a["done"], o)).otherwise(a["done"]).alias("done"), F.when(o.isNull() | ends, new).otherwise(longer).alias("open"))

    rows = segments.where(F.trim("text") != "")
    folded = ordered_fold(rows, ["video_id"], [F.col("seg_idx")], [F.col(c) for c in ("start", "end", "words", "text")], zero, step, lambda a: closed(a["done"], a["open"]))
    return folded.select("video_id", F.inline("out"))


CHOSEN = "array<struct<start:double,end:double,score:double,text:string>>"


def select_highlights(blocks: DataFrame, target: float, gap: float = 5.0, over: float = 1.1) -> DataFrame:
    """(video_id, start, end, score, text): the best blocks (video_id, start, end, score, text) within a time budget.

    By score, then by time: a block counts if it has a length, stands `gap` seconds off all chosen ones and doesn't take
    the total over `over` times the target; the choice ends when the total reaches the target.
    """
    zero = F.struct(F.lit(0.0).alias("total"), F.array().cast(CHOSEN).alias("chosen"))

    def step(a: Column, x: Column) -> Column:
        length = x["end"] - x["start"]
        near = F.exists(a["chosen"], lambda c: ~((c["end"] + gap <= x["start"]) | (c["start"] >= x["end"] + gap)))
        take = (a["total"] < target) & (length > 0) & ~near & (a["total"] + length <= target * over)
        one = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"), x["text"].alias("text")))
        return F.when(take, F.struct((a["total"] + length).alias("total"), F.concat(a["chosen"], one).alias("chosen"))).otherwise(a)

    order = [-F.col("score"), F.col("start")]
    return ordered_fold(blocks, ["video_id"], order, [F.col(c) for c in ("start", "end", "score", "text")], zero, step, lambda a: a["chosen"]).select("video_id", F.inline("out"))


def fit_to_duration(clips: DataFrame, key: str, target: float, over: float = 1.1) -> DataFrame:
    """(key, video_id, start, end, score): clips by score (null: 0) while they fit; overlaps don't matter."""
    kind = "array<struct<video_id:string,start:double,end:double,score:double>>"
    zero = F.struct(F.lit(0.0).alias("total"), F.array().cast(kind).alias("chosen"))

    def step(a: Column, x: Column) -> Column:
        length = x["end"] - x["start"]
        take = (a["total"] < target) & (length > 0) & (a["total"] + length <= target * over)
        one = F.array(F.struct(*[x[c].alias(c) for c in ("video_id", "start", "end", "score")]))
        return F.when(take, F.struct((a["total"] + length).alias("total"), F.concat(a["chosen"], one).alias("chosen"))).otherwise(a)

    scored = clips.withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = [-F.col("score"), F.col("video_id"), F.col("start")]
    return ordered_fold(scored, [key], order, [F.col(c) for c in ("video_id", "start", "end", "score")], zero, step, lambda a: a["chosen"]).select(key, F.inline("out"))


PICKED = "array<struct<place:int,seg_idx:int,start:double,end:double>>"


def budget_select(segments: DataFrame, key: str, n_videos: Column, target: float) -> DataFrame:
    """(key, total, chosen) of segments (key, place, seg_idx, start, end, score): place is the video's, from 0.

    By score, then video and time: a segment counts if its video stays within 1.2 times its equal share of the target and
    the whole within 1.1 times the target; the choice ends when the total reaches the target.
    """
    zero = F.struct(F.lit(0.0).alias("total"), F.array().cast(PICKED).alias("chosen"))

    def used(a: Column, place: Column) -> Column:
        return F.coalesce(F.aggregate(F.filter(a["chosen"], lambda c: c["place"] == place), F.lit(0.0), lambda s, c: s + c["end"] - c["start"]), F.lit(0.0))

    def step(a: Column, x: Column) -> Column:
        length = x["end"] - x["start"]
        again = F.exists(a["chosen"], lambda c: (c["place"] == x["place"]) & (c["start"] == x["start"]))
        fits = (used(a, x["place"]) + length <= x["share"] * 1.2) & (a["total"] + length <= target * 1.1)
        one = F.array(F.struct(*[x[c].alias(c) for c in ("place", "seg_idx", "start", "end")]))
        new = F.struct((a["total"] + length).alias("total"), F.concat(a["chosen"], one).alias("chosen"))
        return F.when((a["total"] < target) & ~again & fits, new).otherwise(a)

    rows = segments.withColumn("share", F.lit(target) / n_videos).withColumn("place", F.col("place").cast("int"))
    order = [-F.col("score"), F.col("place"), F.col("seg_idx")]
    folded = ordered_fold(rows, [key], order, [F.col(c) for c in ("place", "seg_idx", "start", "end", "share")], zero, step)
    return folded.select(key, F.col("out.total").alias("total"), F.col("out.chosen").alias("chosen"))


def budget_expand(segments: DataFrame, selected: DataFrame, key: str, n_videos: Column, target: float) -> DataFrame:
    """(key, total, chosen) with segments added where the selection (key, total, chosen) has under 0.8 of the target.

    Videos in order and segments in time: one that isn't chosen is added while its video's additions stay within 1.5
    times an equal share of what is missing; the walk ends when the total reaches the target.
    """
    kind = "struct<total:double,place:int,added:double,chosen:" + PICKED + ">"
    begun, before = F.col("__total"), F.col("__before")  # once for each key, not in every row
    zero = F.struct(begun.alias("total"), F.lit(None).cast("int").alias("place"), F.lit(0.0).alias("added"), before.alias("chosen")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        length = x["end"] - x["start"]
        added = F.when(a["place"] == x["place"], a["added"]).otherwise(F.lit(0.0))
        known = F.exists(before, lambda c: (c["place"] == x["place"]) & (c["start"] == x["start"]))
        share = (F.lit(target) - begun) / x["n"]
        take = (begun < target * 0.8) & (a["total"] < target) & ~known & (added + length <= share * 1.5)
        one = F.array(F.struct(*[x[c].alias(c) for c in ("place", "seg_idx", "start", "end")]))
        grown = F.struct((a["total"] + length).alias("total"), x["place"].alias("place"), (added + length).alias("added"), F.concat(a["chosen"], one).alias("chosen"))
        same = F.struct(a["total"].alias("total"), x["place"].alias("place"), added.alias("added"), a["chosen"].alias("chosen"))
        return F.when(take, grown.cast(kind)).otherwise(same.cast(kind))

    row = F.struct(F.col("place").cast("int").alias("place"), "seg_idx", "start", "end", n_videos.alias("n"))
    rows = segments.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    joined = rows.join(selected.select(key, F.col("total").alias("__total"), F.col("chosen").alias("__before")), key)
    return joined.select(key, F.aggregate("__rows", zero, step).alias("out")).select(key, F.col("out.total").alias("total"), F.col("out.chosen").alias("chosen"))


def packed(sizes: Column, most: int, separator: int = 0) -> Column:
    """(items, size) of the batches that an array of sizes is packed into, greedily and in order, up to `most` each.

    An item's size counts with `separator` added for each one after a batch's first. One over the limit is a batch of its
    own. The fold holds finished batches and the open one, no items.
    """
    zero = F.struct(F.lit(0).alias("items"), F.lit(0).cast("long").alias("size"), F.array().cast("array<struct<items:int,size:bigint>>").alias("done"))
    batch = lambda a: F.struct(a["items"].alias("items"), a["size"].alias("size"))

    def step(a: Column, n: Column) -> Column:
        grown = a["size"] + separator + n
        fresh, full = a["items"] == 0, grown > most
        done = F.when(~fresh & full, F.array_append(a["done"], batch(a))).otherwise(a["done"])
        return F.struct(F.when(fresh | full, 1).otherwise(a["items"] + 1).alias("items"), F.when(fresh | full, n.cast("long")).otherwise(grown).alias("size"), done.alias("done"))

    return F.aggregate(sizes, zero, step, lambda a: F.when(a["items"] > 0, F.array_append(a["done"], batch(a))).otherwise(a["done"]))


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Stretches of one key (the first column) of batches in order, each with whether the key is a new one."""
    last: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_pylist()
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in itertools.pairwise(cuts):
            yield last != [keys[a]], batch.slice(a, b - a)
            last = [keys[a]]


def leaders(vectors: DataFrame, key: str, order: Column, threshold: float) -> DataFrame:
    """(key, pos): of unit vectors (key, embedding), those less alike than `threshold` to all that were kept before.

    A key's vectors are read in order as a stream; a task holds the key's kept vectors, not all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = np.empty((0, 0)), 0
        for fresh, part in _by_key(batches):
            vectors_ = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1)
            if fresh:
                kept, n = np.empty((16, vectors_.shape[1])), 0
            new = []
            for i, v in enumerate(vectors_):
                if n and (kept[:n] @ v >= threshold).any():
                    continue
                if n == len(kept):
                    kept = np.concatenate([kept, np.empty_like(kept)])
                kept[n] = v
                n += 1
                new.append(i)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(new, pa.int64())), part.column(1).take(pa.array(new, pa.int64()))], names=[key, "pos"])

    rows = vectors.select(key, order.cast("long").alias("pos"), F.col("embedding"))
    kind = rows.select(key, "pos").schema
    return rows.repartition(key).sortWithinPartitions(key, "pos").mapInArrow(run, kind)


def rate_limit(requests: DataFrame, window: float, most: int) -> DataFrame:
    """(client, request_id, allowed) of requests (client, request_id, t): at most `most` allowed ones within `window` seconds.

    Rejected requests don't count towards the limit. A client's requests are read in order as a stream; a task holds the
    times of `most` allowed ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: deque[float] = deque()
        for fresh, part in _by_key(batches):
            if fresh:
                times.clear()
            allowed = []
            for t in part.column(2).to_pylist():
                while times and times[0] <= t - window:
                    times.popleft()
                allowed.append(len(times) < most)
                if allowed[-1]:
                    times.append(t)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(allowed)], names=["client", "request_id", "allowed"])

    rows = requests.select("client", F.col("request_id").cast("long"), F.col("t").cast("double"))
    return rows.repartition("client").sortWithinPartitions("client", "t", "request_id").mapInArrow(run, "client string, request_id long, allowed boolean")


def assemble(paragraphs: DataFrame, key: str, target: int, transitions: list[str]) -> DataFrame:
    """(key, words, text) of paragraphs (key, pos, text, words): a narrative of up to 1.1 times the target.

    Every paragraph but the first gets the next transition in turn, also one that is then left out because it is too
    long; a later one may fit. It ends when the target is reached.
    """
    count = [len(t.split()) for t in transitions]
    phrase = F.array(*map(F.lit, transitions)) if transitions else F.array().cast("array<string>")
    sizes = F.array(*map(F.lit, count)) if transitions else F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("words"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, x: Column) -> Column:
        k = (a["i"] - 1) % max(1, len(transitions))
        use = F.lit(bool(transitions)) & (a["i"] > 0)
        text = F.when(use, F.concat_ws(" ", F.get(phrase, k), x["text"])).otherwise(x["text"])
        size = x["words"] + F.when(use, F.get(sizes, k)).otherwise(0)
        take = (a["words"] < target) & (a["words"] + size <= target * 1.1)
        return F.struct((a["i"] + 1).alias("i"), (a["words"] + F.when(take, size).otherwise(0)).cast("long").alias("words"), F.when(take, F.concat(a["parts"], F.array(text))).otherwise(a["parts"]).alias("parts"))

    folded = ordered_fold(paragraphs, [key], [F.col("pos")], [F.col("text"), F.col("words")], zero, step)
    return folded.select(key, F.col("out.words").alias("words"), F.array_join("out.parts", "\n\n").alias("text"))


def longest_texts(segments: DataFrame, target: float, least: float = 2.0, most: float = 60.0) -> DataFrame:
    """(video_id, start, end, score): segments by length of text until their total reaches the target.

    Those shorter than `least` or longer than `most` seconds don't count. Score: a fiftieth for each word, up to 1.
    """
    kind = "array<struct<start:double,end:double,score:double>>"
    zero = F.struct(F.lit(0.0).alias("total"), F.array().cast(kind).alias("chosen"))

    def step(a: Column, x: Column) -> Column:
        length = x["end"] - x["start"]
        one = F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"), F.least(x["words"] / F.lit(50.0), F.lit(1.0)).alias("score")))
        take = (a["total"] < target) & length.between(least, most)
        return F.when(take, F.struct((a["total"] + length).alias("total"), F.concat(a["chosen"], one).alias("chosen"))).otherwise(a)

    order = [-F.length("text"), F.col("seg_idx")]
    return ordered_fold(segments, ["video_id"], order, [F.col(c) for c in ("start", "end", "words")], zero, step, lambda a: a["chosen"]).select("video_id", F.inline("out"))
