"""Mixing sources to target weights.

Each source's documents stand one after another as a stream of words, in pseudorandom order, cut into blocks of a fixed
length. Every output shard draws multinomial counts of blocks per source; the n-th block that the mix takes from a
source is the one at place n of a pseudorandom permutation of the source's block indices (a new permutation each time
round). A join by block index then tells how often each block, and so each document, is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, positional

BLOCK, SHARD_BLOCKS, MOST_REPEATS, SEED = 256, 4096, 3, 42
#: Rows per bucket of a source's running totals, shards per range of its draws' totals, and sources at most: a name and
#: some numbers of each reach the driver.
BUCKET_ROWS, RANGE_SHARDS, MOST_SOURCES = 4_000, 1_024, 1_000_000


@dataclass(frozen=True)
class Source:
    name: str | None
    weight: float
    size: int
    target: float
    blocks: int
    quota: int


def sizes(text: Column) -> Column:
    """Words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(size: list[int], weight: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of the whole by weight, none over `most` times its size; what is over is shared again by weight."""
    out, open_, rest = [0.0] * len(size), [i for i, s in enumerate(size) if s > 0], float(sum(size))
    while open_:
        w = sum(weight[i] for i in open_)
        over = [i for i in open_ if rest * weight[i] / w > most * size[i]]
        if not over:
            for i in open_:
                out[i] = rest * weight[i] / w
            break
        for i in over:
            out[i] = float(most * size[i])
        rest -= sum(out[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def plan(totals: list[tuple[str | None, int]], weights: tuple[float, ...], block: int = BLOCK, most: float = MOST_REPEATS) -> list[Source]:
    """Sources by code point, null last, with weights repeating; quota: blocks to take."""
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(order))]
    out = []
    for (name, size), w, t in zip(order, weight, targets([s for _, s in order], weight, most), strict=True):
        blocks = -(-size // block)
        quota = min(int(most * blocks), round(t * blocks / size)) if size else 0
        out.append(Source(name, w, size, t, blocks, quota))
    return out


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(size), at `index`: four Feistel rounds, walked until the value is in range."""
    half = max(1, (int(size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            h = (right + np.uint64((seed * 4 + r) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h ^ (h >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (out >= size).any():
        out = np.where(out >= size, once(out), out)
    return out.astype(np.int64)


def draws(shard: int, blocks: int, ends: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sources that a shard takes blocks of and how many: multinomial by quota. `ends` are the quotas' running totals."""
    at = np.random.default_rng([seed, shard]).integers(0, ends[-1], blocks)
    return np.unique(np.searchsorted(ends, at, side="right"), return_counts=True)


def source_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(src, name, source_size, target, quota, blocks) of the sources, a row each."""
    rows = [(i, s.name, s.size, s.target, s.quota, s.blocks) for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "src long, name string, source_size long, target double, quota long, blocks long")


def running(rows: DataFrame, value: str, key: str, part: Column, order: list[Column]) -> DataFrame:
    """`rows` with `first`: the sum of `value` over the key's rows before, by part and then by `order`.

    Sums are taken within a part and over the parts' totals, so that no key's rows stand in one task.
    """
    dealt = rows.withColumn("part", part)
    inside = Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(key, "part").agg(F.sum(value).alias("n_part")).select(key, "part", F.coalesce(F.sum("n_part").over(before), F.lit(0)).alias("base"))
    summed = dealt.withColumn("first", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, [key, "part"])
    return summed.withColumn("first", F.col("base") + F.col("first")).drop("part", "base")


def slots(sources: DataFrame, quotas: np.ndarray, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(shard, src, block): the blocks of the mix; `sources` is a source_table and `quotas` its quotas in order of src.

    A source's draws stop at its quota; what its draws fall short of stands in added shards after the drawn ones, so the
    totals meet the quotas exactly. A shard has a row for each source that it draws, not for each source.
    """
    spark, total = sources.sparkSession, int(quotas.sum())
    if not total:
        return spark.createDataFrame([], "shard long, src long, block long")
    shards = max(1, total // shard_blocks)
    each = -(-total // shards)
    ends = spark.sparkContext.broadcast(np.cumsum(quotas))  # a number for each source: MOST_SOURCES at most

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                src, n = draws(shard, each, ends.value, seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), shard)), pa.array(src), pa.array(n.astype(np.int64))], names=["shard", "src", "n"])

    drawn = spark.range(shards).mapInArrow(counts, "shard long, src long, n long")
    limits = sources.where("quota > 0").select("src", "quota", "blocks")
    spans = running(drawn, "n", "src", F.expr(f"shard div {RANGE_SHARDS}"), [F.col("shard")]).join(limits, "src")
    spans = spans.select("shard", "src", "first", F.least(F.col("first") + F.col("n"), "quota").alias("end"), "blocks").where("first < end")
    filled = spans.groupBy("src").agg(F.max("end").alias("done"))
    short = limits.join(filled, "src", "left").withColumn("done", F.coalesce("done", F.lit(0))).where("done < quota")
    step = F.lit(shard_blocks).cast("long")
    late = short.select("src", F.explode(F.sequence("done", F.col("quota") - 1, step)).alias("first"), "quota", "blocks")
    late = late.select((F.lit(shards) + F.expr(f"first div {shard_blocks}")).alias("shard"), "src", "first", F.least(F.col("first") + step, F.col("quota")).alias("end"), "blocks")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, src, first, end, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.arange(first, end)
                block = np.empty(len(n), np.int64)
                for turn in np.unique(n // size):
                    mine = n // size == turn
                    block[mine] = permuted(n[mine] % size, size, seed * 1_000_003 + src * 101 + int(turn))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard)), pa.array(np.full(len(n), src)), pa.array(block)], names=["shard", "src", "block"])

    return spans.unionByName(late).repartition("shard").mapInArrow(expand, "shard long, src long, block long")


def placed(docs: DataFrame, sources: DataFrame, rows: int, seed: int = SEED) -> DataFrame:
    """docs' (row, doc_id, source, size) with src and start, the place of its first word in its source's stream.

    Documents of a source are dealt into buckets by a hash, whatever the source's size.
    """
    names = sources.select("src", "name")
    dealt = docs.join(names, docs.source.eqNullSafe(names.name)).drop("name")
    bucket = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(max(1, rows // BUCKET_ROWS)))
    return running(dealt, "size", "src", bucket, [F.xxhash64(F.lit(seed + 1), "row"), F.col("row")]).withColumnRenamed("first", "start")


def _row(doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.lit("mix"), F.col(text), F.col(source).isNull(), F.col(source).cast("string"))


def _mixed_rows(docs: DataFrame, weights: tuple[float, ...], block: int, seed: int) -> DataFrame:
    """mixed, with the hash `row` of each row."""
    spark = docs.sparkSession
    own = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), sizes(F.col("text")).alias("size"), _row().alias("row")))
    totals = [(r["source"], r["n"]) for r in own.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()]
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; give coarser ones")
    sources = plan(totals, weights, block)
    names = source_table(spark, sources)
    at = checkpoint(placed(own, names, own.count(), seed))
    times = slots(names, np.array([s.quota for s in sources], np.int64), seed=seed).groupBy("src", "block").agg(F.count("*").alias("times"))
    end = F.col("start") + F.col("size")
    cover = at.where("size > 0").select("src", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block"))
    words = F.least(end, (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    # merge joins: blocks compress so well in a shuffle that adaptive execution would broadcast all of them
    taken = cover.join(times.hint("merge"), ["src", "block"]).groupBy(F.col("src").alias("of"), F.col("start").alias("from")).agg(F.sum(words * F.col("times")).alias("taken"))
    full = at.join(taken.hint("merge"), (F.col("src") == F.col("of")) & (F.col("start") == F.col("from")) & (F.col("size") > 0), "left")
    out = full.select("row", "src", "doc_id", "source", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out.join(names.select("src", "source_size", "target"), "src").select("row", "doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of documents' (doc_id, text, source).

    taken: the words that the mix takes of the document, repeats counted; at most three times its size. A null source is
    a source of its own, the last. Texts that are null or blank have size 0 and nothing is taken of them. Repeated rows
    are documents of their own. The same rows give the same mix.
    """
    return _mixed_rows(docs, weights, block, seed).drop("row", "source")


def repeated(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """`docs`, each row as often as the mix takes its words: taken / size times, a fraction being decided by a hash.

    So whole documents stand for the words that the mix takes, up to three times each; words per source come near their
    targets. Documents that the mix doesn't take, and those without words, go. All columns stay as they are; they may
    have any names. An empty table gives an empty one.
    """
    rows = _mixed_rows(docs.select("doc_id", "text", "source"), weights, block, seed).where("taken > 0").groupBy("row", "doc_id", "source").agg((F.sum("taken") / F.sum("size")).alias("ratio"))
    chance = F.pmod(F.xxhash64(F.lit(seed), "row", F.lit("round")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = rows.select("row", "doc_id", "source", (F.floor("ratio") + (chance < F.col("ratio") - F.floor("ratio")).cast("int")).cast("int").alias("times")).where("times > 0")
    doc_id, text, source = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text", "source"))
    own = positional(docs)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("doc_id")) & F.col(source).cast("string").eqNullSafe(F.col("source"))
    joined = own.join(times.hint("merge"), (_row(doc_id, text, source) == F.col("row")) & same)
    return joined.select(*own.columns, F.explode(F.sequence(F.lit(1), "times"))).select(*own.columns).toDF(*docs.columns)
