"""The trie of conversations' turns, its subtree totals found by peeling leaves.

A node is a distinct sequence of first turns. It is named by two 64-bit hashes of the sequence: the exclusive or of its
turns' digests, each mixed with its place; so a conversation's nodes follow from a running aggregate.

Nodes with the same members stand below one another: a chain. Chains hold counters of the children that are still to
come. A chain without any is complete: it sends its totals to its parent, whose counter falls; so complete chains peel
off round by round until the root's is. A round costs as much as the chains that still wait; there are as many rounds
as chains on the longest way down, however long the chains. Within a chain, totals are a running sum from its bottom.

A conversation is nowhere held whole: running aggregates go by parts of PART turns, and what earlier parts hold is added.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, tidy

#: Turns of a part, as a power of two; ids in a piece of a list of members.
PART, IDS = 10, 10_000


def _running(rows: DataFrame, place: Column, order: list[Column], sums: dict[str, Column], f: Callable[[Column], Column], plus: Callable[[Column, Column], Column]) -> DataFrame:
    """`rows` with running aggregates `f` of `sums` over each conv_id in `order`, by parts of `place` that follow one another."""
    parted = rows.withColumn("part", place)
    within = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parted.select("*", *(f(c).over(within).alias(k) for k, c in sums.items()))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy("conv_id", "part").agg(*(f(c).alias(k) for k, c in sums.items()))
    carried = totals.select("conv_id", "part", *(f(F.col(k)).over(earlier).alias(f"{k}_before") for k in sums)).where(f"{next(iter(sums))}_before is not null")
    whole = [F.when(F.col(f"{k}_before").isNull(), F.col(k)).otherwise(plus(F.col(k), F.col(f"{k}_before"))).alias(k) for k in sums]
    return local.join(carried, ["conv_id", "part"], "left").select(*rows.columns, *whole)


def placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, x, y, words) of each turn: its place from 1, two numbers from a digest of role and text, and its words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), told.alias("told"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    part = F.coalesce(F.shiftright("turn", PART), F.lit(-(1 << 60)))  # null turns come first
    found = _running(rows, part, [F.asc_nulls_first("turn"), F.col("role"), F.col("told")], {"pos": F.lit(1)}, F.sum, lambda a, b: a + b)
    half = lambda at: F.conv(F.substring("told", at, 15), 16, 10).cast("long")
    return found.select("conv_id", "pos", half(1).alias("x"), half(16).alias("y"), "words")


def opened(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of the one that opens their group of `every` ids: ((conv_id), (conv_id, d, x, y, words)).

    The first h turns, h = crc32(conv_id) mod (most + 1), give way to those of conversation c - c mod `every`: as many as
    it has.
    """
    h, base = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("long"), F.col("conv_id") - F.col("conv_id") % every
    ids = turns.select("conv_id").distinct()
    first = turns.where((F.col("pos") <= most) & (F.col("conv_id") == base)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "words"))).alias("head"))
    joined = ids.withColumn("base", base).join(first.withColumnRenamed("conv_id", "base"), "base", "left")
    head = F.filter(F.coalesce("head", F.array().cast("array<struct<pos:bigint,x:bigint,y:bigint,words:bigint>>")), lambda t: t["pos"] <= h)
    heads = joined.select("conv_id", head.alias("head"))
    short = heads.select("conv_id", (h - F.size("head")).alias("less")).where("less > 0")
    own = turns.where(F.col("pos") > h).join(short, "conv_id", "left").select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("d"), "x", "y", "words")
    return ids, own.unionByName(heads.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("d"), "t.x", "t.y", "t.words"))


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of (depth, a, b, conv_id): the digest of a node's ids in order, comma-joined.

    Lists are made by ranges of (node, id), so that one node's ids come from many tasks, and digested piece by piece.
    """
    key = ["depth", "a", "b"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for *k, i in zip(*(batch.column(c).to_pylist() for c in (*key, "conv_id")), strict=True):
                if not out or out[-1][0] != k or len(out[-1][2]) >= IDS:
                    out.append([k, i, []])
                out[-1][2].append(str(i))
            columns = [pa.array([r[0][j] for r in out], pa.int64()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in out], pa.int64()), pa.array([",".join(r[2]) for r in out], pa.string())], names=[*key, "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if k != now:
                    done += [(*now, sha.hexdigest())] if now else []
                    now, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*key, "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, sha.hexdigest())], names=[*key, "ends_sha256"])

    parts = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(tidy(joined), "depth long, a long, b long, first long, ids string")
    return parts.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(tidy(digested), "depth long, a long, b long, ends_sha256 string")


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(depth, a, b, up_a, up_b, conv_id, n_convs, words, ends_sha256): the nodes of conversations' turns (conv_id, d, x, y, words).

    a, b name the node and up_a, up_b its parent, one depth higher; conv_id: the smallest member; words: of the last turn.
    """
    own = {"a": F.xxhash64("x", "d"), "b": F.xxhash64(F.lit(1), "y", "d")}
    rows = _running(turns, F.shiftright("d", PART), [F.col("d")], own, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    last = F.struct("words", F.col("a").bitwiseXOR(own["a"]).alias("up_a"), F.col("b").bitwiseXOR(own["b"]).alias("up_b"))
    below = rows.groupBy(F.col("d").alias("depth"), "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(last).alias("last"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = below.select("depth", "a", "b", "last.up_a", "last.up_b", "conv_id", "n_convs", "last.words")
    nodes = nodes.unionByName(root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("up_a"), none.alias("up_b"), "conv_id", "n_convs", zero.alias("words")))
    every = turns.select("conv_id", "d", *(c.alias(k) for k, c in own.items())).unionByName(ids.select("conv_id", none.alias("d"), zero.alias("a"), zero.alias("b")))
    ends = every.groupBy("conv_id").agg(F.count("d").alias("depth"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    told = nodes.join(_digests(ends), ["depth", "a", "b"], "left")
    return told.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def _chains(walked: DataFrame) -> DataFrame:
    """A row for each chain: its members, top and bottom, the names of its bottom and of its top's parent, its own sum."""
    edge = walked.where("is_top or is_bottom").groupBy("conv_id", "n_convs")
    low, high = F.max(F.struct("depth", "a", "b")), F.min(F.struct("depth", "up_a", "up_b"))
    found = edge.agg(low.alias("low"), high.alias("high"), F.max("saved").alias("own"))
    return found.select("conv_id", "n_convs", "own", F.col("high.depth").alias("top"), F.col("low.depth").alias("depth"), "low.a", "low.b", (F.col("high.depth") - 1).alias("up"), "high.up_a", "high.up_b")


def peeled(chains: DataFrame) -> DataFrame:
    """Chains with n_children, n_leaves and below, the sum over all chains under them, by rounds of messages to parents."""
    up, key = ["up", "up_a", "up_b"], ["depth", "a", "b"]
    to_parent = [F.col(u).alias(k) for u, k in zip(up, key, strict=True)]
    counters = chains.where("up >= 0").groupBy(*to_parent).agg(F.count("*").alias("n_children"))
    start = chains.join(counters, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    start = checkpoint(start.select("*", F.col("n_children").alias("remaining"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("below")))
    done, waiting = start.where("remaining = 0"), start.where("remaining > 0")
    out, rounds = done, 0
    while not waiting.isEmpty():
        sent = done.where("up >= 0").groupBy(*to_parent).agg(F.count("*").alias("came"), F.sum("n_leaves").alias("leaves"), F.sum(F.col("own") + F.col("below")).alias("sum"))
        got = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)
        rest = [c for c in start.columns if c not in ("remaining", "n_leaves", "below")]
        now = checkpoint(waiting.join(sent, key, "left").select(*rest, (F.col("remaining") - F.coalesce("came", F.lit(0))).alias("remaining"), got("n_leaves", "leaves"), got("below", "sum")))
        done, waiting, rounds = now.where("remaining = 0"), now.where("remaining > 0"), rounds + 1
        out = out.unionByName(done)
        if rounds % 16 == 0:
            out = checkpoint(out)
    return out.drop("remaining")


def subtrees(nodes: DataFrame) -> DataFrame:
    """A row per node of `trie`, with its parent, children, leaves and the tokens that its subtree need not repeat.

    saved_tokens: for each node of the subtree, itself included, the words of its last turn once for each member but one.
    """
    down = Window.partitionBy("conv_id", "n_convs").orderBy(F.desc("depth"))
    total = F.sum((F.col("n_convs") - 1) * F.col("words")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    walked = nodes.select("*", total.alias("saved"), (F.row_number().over(down) == 1).alias("is_bottom"), F.lead("depth").over(down).isNull().alias("is_top"))
    chains = peeled(checkpoint(_chains(walked)))
    parents = chains.where("n_children > 0").select(F.col("depth").alias("up"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent"))
    told = chains.join(parents, ["up", "up_a", "up_b"], "left").select("conv_id", "n_convs", "parent", "n_children", "n_leaves", "below")
    return walked.join(told, ["conv_id", "n_convs"]).select(
        "conv_id",
        "depth",
        F.when(F.col("is_top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(F.col("is_bottom"), F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("saved") + F.col("below")).alias("saved_tokens"),
        "ends_sha256",
    )


def prefixes(conversations: DataFrame, every: int = 20) -> DataFrame:
    """The trie of conversations' (conv_id, turn, role, text), each opened by the first turns of its group: a row per node.

    Turns are ordered by turn (null first), then role and a digest of the text; repeated rows are turns of their own. A
    null role or text counts as empty. Rows with a null conv_id belong to no conversation and are left out. A conversation
    that the change leaves without turns ends at the root. An empty table gives an empty one; other columns aren't looked at.
    """
    ids, turns = opened(checkpoint(placed(conversations)), every)
    ids = checkpoint(ids)
    return subtrees(checkpoint(trie(ids, checkpoint(turns))))
