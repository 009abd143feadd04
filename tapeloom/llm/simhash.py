"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, then a check of the Hamming distance.

Fingerprints: 64 bits of word shingles' XXH64. Two fingerprints that differ in at most d of 64 bits, cut into b blocks,
agree on b - d blocks at least; so each fingerprint is dealt out under every choice of b - d blocks and those with equal
blocks meet. Within a bucket a breadth-first walk finds links: a row that is reached leaves the set still searched, so
a dense bucket costs about its size and gives a tree of links, not all pairs, while no two rows that link end apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, positional, runs, slices, texts_of, tidy

BITS = 64
#: Links that a task works on when components are looked for.
LINKS_EACH = 100_000


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; A-Z are lower-cased, words end at ASCII white space."""
    w = text.encode("utf-8", "replace").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in parts], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; 0 without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of documents' (doc_id, text): fp is the fingerprint as a signed long.

    A null or blank text has fingerprint 0. Rows are kept as they are: repeated and null doc_ids too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([simhash(shingle_hashes(t, words, seed)) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, fp long")


def block_count(rows: int, distance: int) -> int:
    """Blocks to cut 64 bits into, so that a bucket gets about one row of `rows` if bits are even."""
    for blocks in range(distance + 2, distance + 5):
        if BITS * (blocks - distance) // blocks >= np.log2(max(rows, 2)) + 2:
            return blocks
    return distance + 4


def block_masks(blocks: int, distance: int) -> list[int]:
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - distance)]


def _tree(x: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links (i, j) that join up all rows of x joined by steps of at most `distance` bits."""
    rest, out = np.arange(len(x)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            near = np.bitwise_count(x[rest] ^ x[i]) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                out += [(i, j) for j in found]
                queue += list(found)
    return out


def _sub_buckets(x: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """A large bucket once more by single blocks of its bits that vary; close rows still meet."""
    vary = [b for b in range(BITS) if 0 < int((x >> np.uint64(b) & np.uint64(1)).sum()) < len(x)]
    for part in np.array_split(np.array(vary, np.uint64), distance + 1):
        mask = np.uint64(sum(1 << int(b) for b in part))
        order = np.argsort(x & mask, kind="stable")
        yield from np.split(order, np.flatnonzero(np.diff((x & mask)[order])) + 1)


def bucket_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows that stand together under one key, as pairs of rep; key is sorted."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    of = np.repeat(sizes, sizes)
    for step in range(1, 16):
        near = np.flatnonzero((key[step:] == key[:-step]) & (of[step:] <= 16))
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= distance]
        a.append(rep[near])
        b.append(rep[near + step])
    for s, n in zip(starts[sizes > 16], sizes[sizes > 16], strict=False):
        x, r = fp[s : s + n], rep[s : s + n]
        for rows in _sub_buckets(x, distance) if n > 4096 else [np.arange(n)]:
            if len(rows) < 2:
                continue
            if links := _tree(x[rows], distance):
                i, j = np.array(links).T
                a.append(r[rows[i]])
                b.append(r[rows[j]])
    return np.concatenate(a), np.concatenate(b)


def block_links(classes: DataFrame, distance: int, masks: list[int]) -> DataFrame:
    """(a, b), a < b: links that connect the classes (fp, rep) within `distance` bits, by a join on blocks.

    All links of a bucket of up to 16 rows; of a larger one, a tree of links that connects what they connect.
    """

    def signed(m: int) -> int:
        return m - (1 << 64) if m >> 63 else m

    keys: list[Column] = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long"))) for k, m in enumerate(masks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, rep in runs(batches, 3):
            x, y = bucket_links(key, fp.view(np.uint64), rep, distance)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    dealt = classes.select(F.explode(F.array(*keys)).alias("key"), "fp", "rep").repartition("key").sortWithinPartitions("key", "fp", "rep")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of links' (a, b): label is the smallest id that can be reached. Ids without links don't appear.

    Each round, every id points to the smallest one among itself and its neighbours, first for larger neighbours, then
    for smaller ones, until no link changes; the number of rounds grows as the logarithm of the longest path. Stages have a
    task for each LINKS_EACH links at most: few links would otherwise leave some thousand files each round.
    """
    edges = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = edges.count() // LINKS_EACH + 1
    edges, before = edges.coalesce(tasks), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(tasks)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpoint(small.select("e.u", "e.v").where("u <> v").coalesce(tasks).distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        before = now


def near_duplicates(docs: DataFrame, words: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of documents' (doc_id, text).

    Fingerprints link at `distance` or fewer differing bits; component_id is the smallest doc_id reachable. Equal
    fingerprints are one class from the start, so copies cost no links. Null and blank texts share fingerprint 0 and
    link like any other. Rows with a null doc_id keep a row; their component is that of the others, if any.
    """
    fps = checkpoint(fingerprints(docs, words, seed))
    classes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = classes.where(F.col("rep").isNotNull())
    masks = block_masks(block_count(classes.count(), distance), distance)
    labels = components(block_links(named, distance, masks))
    joined = classes.join(labels, classes.rep == labels.id, "left").select("fp", F.coalesce("label", "rep").alias("component_id"))
    return fps.join(joined, "fp").select("doc_id", "fp", "component_id")


# ---- near copies by likeness of shingles

#: Words of a shingle and the least share of shingles in common.
SHINGLE, ALIKE = 5, 0.8
#: Fingerprints of distinct words that differ in at most so many bits make candidates of the first, quick search.
ALIKE_BITS = 4


def word_set_fingerprint(words: list[bytes]) -> int:
    return simhash(np.array([xxhash.xxh64_intdigest(w, 42) for w in set(words)], np.uint64))


def shingle_set(text: str, words: int = SHINGLE) -> np.ndarray:
    """The text's shingles as sorted 64-bit hashes, each once."""
    return np.unique(shingle_hashes(text, words))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shingles in common, as a share of all; 1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def _identities(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, same): same is a wide hash of the text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [t.encode("utf-8", "replace").lower().split() for t in texts_of(batch)]
            fp = np.array([word_set_fingerprint(w) for w in words], np.uint64).view(np.int64)
            same = [xxhash.xxh3_128_digest(b" ".join(w)) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), pa.array(same, pa.binary())], names=["doc_id", "fp", "same"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, fp long, same binary")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).tobytes() for t in texts_of(batch)], pa.binary())], names=["rep", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "rep long, shingles binary")


def _alike(links: DataFrame, sets: DataFrame) -> DataFrame:
    """Of links (a, b), those whose shingle sets are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pairs = zip(batch.column(2), batch.column(3), strict=True)  # read in place: sets of long texts are large
            keep = pa.array([likeness(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= ALIKE for x, y in pairs], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    left = links.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


# ---- the exact join: every pair at ALIKE shares a shingle of both prefixes

#: A shingle of more than OFTEN documents' prefixes is usual: it comes last in the order of prefixes. Of such shingles the
#: MOST_USUAL most frequent ones are told apart, and a share more than a prefix is counted, for what comes in their place.
OFTEN, MOST_USUAL, MORE = 4, 300_000, 0.3
#: Ids that are sent to all tasks at most; more of them meet documents by a shuffle.
MOST_SENT = 1_000_000
#: Rows of one shingle that a task holds at once; more of them are dealt out in parts.
AT_ONCE = 100_000
#: Bits of a sketch: the parity of how many shingles fall on each.
SKETCH = 1024


def prefix_size(n: int) -> int:
    """Of sets of n shingles and any other in one order, those ALIKE have one of their first so many in common."""
    return n - int(np.ceil(ALIKE * n - 1e-6)) + 1 if n else 0


def most_unlike(n: np.ndarray) -> np.ndarray:
    """The most shingles that are in one of two sets only, if they are ALIKE and n is the sum of their sizes."""
    return n - 2 * np.ceil(ALIKE / (1 + ALIKE) * n - 1e-6).astype(np.int64)


def usual_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that many documents have near the beginning of their sorted sets, the rarest first; all documents count.

    They order the prefixes, so that passages which unlike documents share make no candidates; any order loses no pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t) for t in texts_of(batch)]
            key, n = np.unique(np.concatenate([s[: int((1 + MORE) * prefix_size(len(s)))] for s in sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    counted = docs.select("text").mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = counted.where(F.col("n") > OFTEN).orderBy(F.desc("n"), "key").limit(MOST_USUAL)
    return top.select("key").toArrow()["key"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


def ordered_prefix(shingles: np.ndarray, usual: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The prefix of a sorted set: shingles that aren't usual by their hash, then usual ones; usual is sorted."""
    place = np.zeros(len(shingles), np.int64)
    if len(usual):
        at = np.minimum(np.searchsorted(usual, shingles), len(usual) - 1)
        place = np.where(usual[at] == shingles, rank[at] + 1, 0)
    return shingles[np.argsort(place, kind="stable")][: prefix_size(len(shingles))]


def sketch(shingles: np.ndarray) -> bytes:
    """Two sketches differ in no more bits than there are shingles in one of the two sets only."""
    return np.packbits(np.bincount((shingles % SKETCH).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def _sketches(docs: DataFrame) -> DataFrame:
    """(rep, n, sketch): the size of a text's shingle set and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int32()), pa.array(list(map(sketch, sets)), pa.binary())], names=["rep", "n", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "rep long, n int, sketch binary")


def _prefixes(docs: DataFrame, usual: np.ndarray) -> DataFrame:
    """(key, rep, n, pos): the prefix of each text's shingle set in order, and the size of the set."""
    order = np.argsort(usual)
    shared = docs.sparkSession.sparkContext.broadcast((usual[order], order))  # bounded by MOST_USUAL

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t) for t in texts_of(batch)]
            keys = [ordered_prefix(s, *shared.value).view(np.int64) for s in sets]
            size = np.array(list(map(len, keys)))
            of = [np.repeat(batch.column(0).to_numpy(), size), np.repeat(np.array(list(map(len, sets)), np.int32), size), np.concatenate([np.arange(k, dtype=np.int32) for k in size])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(keys), *of)], names=["key", "rep", "n", "pos"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "key long, rep long, n int, pos int")


Test = Callable[[np.ndarray | int, np.ndarray], np.ndarray]


def may_link(rep: np.ndarray, n: np.ndarray, pos: np.ndarray, x: np.ndarray | int, y: np.ndarray) -> np.ndarray:
    """Whether rows at x and y, which share a shingle at pos of their prefixes, may be alike; n is the size of their sets."""
    unlike = pos[x] + pos[y] + np.abs(n[x] - pos[x] - n[y] + pos[y])
    return (unlike <= most_unlike(n[x] + n[y])) & (rep[x] != rep[y])


def prefix_links(key: np.ndarray, rep: np.ndarray, n: np.ndarray, pos: np.ndarray, most: int, also: Test | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of rep under one key that may be alike, and the places of rows to be looked at again.

    key is sorted; pos is the key's place in the row's order. A bucket of more than `most` rows has its first `most`
    held against all; its others come again. A pair that is alike passes at the first shingle in common. `also` is one
    more test of the places of two rows.
    """
    a, b, again = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    of, n, pos = np.repeat(sizes, sizes), n.astype(np.int64), pos.astype(np.int64)

    def meet(x: np.ndarray | int, y: np.ndarray) -> None:
        y_ok = may_link(rep, n, pos, x, y)
        x, y = np.broadcast_to(x, len(y))[y_ok], y[y_ok]
        if also:
            ok = also(x, y)
            x, y = x[ok], y[ok]
        a.append(rep[x])
        b.append(rep[y])

    few = np.flatnonzero((of > 1) & (of <= most))
    for step in range(1, most):
        few = few[few + step < len(key)]
        few = few[key[few + step] == key[few]]
        if not len(few):
            break
        meet(few, few + step)
    for s, m in zip(starts[sizes > most], sizes[sizes > most], strict=True):
        for i in range(s, s + most):
            meet(i, np.arange(i + 1, s + m))
        if m > most + 1:
            again.append(np.arange(s + most, s + m))
    return np.concatenate(a), np.concatenate(b), np.concatenate(again)


def _met(dealt: DataFrame, most: int) -> DataFrame:
    """Of (key, rep, n, pos): pairs of buckets of up to `most` rows as (a, b), with key null; the rows of others, with a and b null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["a", "b", "key", "rep", "n", "pos"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        passed = []  # the key whose rows have been passed on before in part
        for part in runs(batches, 4, max(AT_ONCE, most)):
            key = part[0]
            sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
            large = np.repeat(sizes > most, sizes) | np.isin(key, passed)
            passed = list(key[-1:][large[-1:]])
            x, y, _ = prefix_links(*(c[~large] for c in part), most)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *(pa.nulls(pairs.shape[1], k) for k in kinds)], names=names)
            rest = int(large.sum())
            yield pa.RecordBatch.from_arrays([pa.nulls(rest, pa.int64()), pa.nulls(rest, pa.int64()), *(pa.array(c[large]) for c in part)], names=names)

    rows = dealt.select("key", "rep", "n", "pos").repartition("key").sortWithinPartitions("key", "rep")
    return rows.mapInArrow(tidy(run), "a long, b long, key long, rep long, n int, pos int")


def _met_dense(dealt: DataFrame, most: int) -> DataFrame:
    """Of (key, rep, n, pos, sketch, own): pairs as (a, b), with key null, and rows to be looked at again, with a and b null.

    Pairs of one group (own), or whose sketches rule out that they are alike, aren't given. Buckets of one group end here,
    and those of which the rows that are left are of one.
    """
    columns = ["key", "rep", "n", "pos", "sketch"]

    def mixed(key: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether a row's bucket, of rows sorted by key, holds several groups."""
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return np.repeat(np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts), np.diff(np.r_[starts, len(key)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["a", "b", *columns], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for part in runs(batches, 6):
            several = mixed(part[0], part[5])
            part = [c[several] for c in part]
            own, n = part[5], part[2].astype(np.int64)
            bits = np.frombuffer(b"".join(part[4]), np.uint64).reshape(-1, SKETCH // 64)

            def may_be_alike(x: np.ndarray, y: np.ndarray, own: np.ndarray = own, n: np.ndarray = n, bits: np.ndarray = bits) -> np.ndarray:
                ok = own[x] != own[y]
                ok[ok] = np.bitwise_count(bits[x[ok]] ^ bits[y[ok]]).sum(1, dtype=np.int64) <= most_unlike(n[x[ok]] + n[y[ok]])
                return ok

            x, y, again = prefix_links(*part[:4], most, may_be_alike)
            again = again[mixed(part[0][again], own[again])] if len(again) else again
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *(pa.nulls(pairs.shape[1], k) for k in kinds)], names=names)
            rest = [pa.array(c[again], k) for c, k in zip(part[:5], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(again), pa.int64()), pa.nulls(len(again), pa.int64()), *rest], names=names)

    rows = dealt.select(*columns, "own").repartition("key").sortWithinPartitions("key", "rep")
    return rows.mapInArrow(tidy(run), "a long, b long, key long, rep long, n int, pos int, sketch binary")


def _met_in_parts(dealt: DataFrame, huge: DataFrame, most: int) -> DataFrame:
    """As _met_dense, for the keys of `huge` (key, rows), of which a task can't hold all rows.

    About `most` rows of a key, chosen by a hash, meet parts of its other rows; those others come again.
    """
    rows = dealt.join(F.broadcast(huge) if huge.count() <= MOST_SENT else huge, "key")
    some = F.pmod(F.xxhash64(F.lit(most), "rep"), F.greatest(F.expr(f"rows div {min(most, AT_ONCE)}"), F.lit(1))) == 0
    marked = checkpoint(rows.withColumn("first", some))
    first, others = marked.where("first"), marked.where("not first")
    parts = F.expr(f"cast(ceil(rows / {AT_ONCE}) as int)")
    at = F.when(F.col("first"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), parts).cast("int")))
    placed = marked.withColumn("part", F.explode(at)).withColumn("bucket", F.xxhash64("key", "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, key, head, rep, n, pos, own, sketches in runs(batches, 8):
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            bits = np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, SKETCH // 64)
            ends = np.r_[np.flatnonzero((bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])) + 1, len(bucket)]
            for i in np.flatnonzero(head):
                y = np.arange(i + 1, ends[np.searchsorted(ends, i, "right")])
                y = y[(own[y] != own[i]) & may_link(rep, n, pos, int(i), y)]
                y = y[np.bitwise_count(bits[y] ^ bits[i]).sum(1, dtype=np.int64) <= most_unlike(n[y] + n[i])]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[y], rep[i])), pa.array(np.maximum(rep[y], rep[i]))], names=["a", "b"])

    columns = ["bucket", "key", "first", "rep", "n", "pos", "own", "sketch"]
    sorted_ = placed.select(*columns).repartition("bucket").sortWithinPartitions("bucket", "key", F.desc("first"), "rep")
    links = sorted_.mapInArrow(tidy(run), "a long, b long").distinct()
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    met = links.select("a", "b", none("key", "long"), none("rep", "long"), none("n", "int"), none("pos", "int"), none("sketch", "binary"))
    return met.unionByName(others.select(none("a", "long"), none("b", "long"), "key", "rep", "n", "pos", "sketch"))


def _close(links: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of links (a, b), those between different groups whose sketches (rep, n, sketch, own) don't rule out that they are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for c in ("x", "y"))
            n = batch.column("nx").to_numpy().astype(np.int64) + batch.column("ny").to_numpy()
            keep = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most_unlike(n)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda place, end: sketches.select(F.col("rep").alias(place), F.col("n").alias(f"n{end}"), F.col("sketch").alias(end), F.col("own").alias(f"own_{end}"))
    both = links.join(side("a", "x"), "a").join(side("b", "y"), "b").where("own_x <> own_y")
    return both.select("a", "b", "nx", "ny", "x", "y").mapInArrow(tidy(run), "a long, b long").distinct()


def sent(ids: DataFrame) -> DataFrame:
    """A checkpointed table of ids, to be broadcast if there are few of them."""
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def _sets_of(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, shingles) of the documents that links (a, b) name."""
    linked = checkpoint(links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    return checkpoint(_shingle_sets(docs.join(sent(linked), "doc_id", "left_semi")).dropDuplicates(["rep"]))


def prefix_copies(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, label): links between documents (doc_id, text), as components; groups (id, label) are those found before.

    Every pair that is ALIKE and in different groups is found: at once if its documents meet in a bucket of up to 64.
    Larger buckets take several rounds: each holds some rows against all others of different groups and goes on with the
    other rows, twice as many at a time, until all are done or of one group. Rows of one shingle that are too many for
    a task are dealt out in parts, each with the rows that are held against all. So groups are the components of all ALIKE pairs.
    """
    most = 64
    dealt = _prefixes(docs, usual_shingles(docs))
    named = _sketches(docs).dropDuplicates(["rep"]).join(groups.select(F.col("id").alias("rep"), "label"), "rep", "left")
    sketches = checkpoint(named.select("rep", "n", "sketch", F.coalesce("label", "rep").alias("own")))
    met = checkpoint(_met(dealt, most))
    links = checkpoint(_close(met.where("key is null").select("a", "b").distinct(), sketches))
    dense = checkpoint(met.where("key is not null").select("key", "rep", "n", "pos").join(sketches.select("rep", "sketch"), "rep"))
    while True:
        if not links.isEmpty():
            more = components(_alike(links, _sets_of(docs, links)))
            groups = checkpoint(components(groups.unionByName(more).select(F.col("id").alias("a"), F.col("label").alias("b"))))
        if dense.isEmpty():
            return groups
        rows = checkpoint(dense.join(groups.select(F.col("id").alias("rep"), "label"), "rep", "left").withColumn("own", F.coalesce("label", "rep")))
        counted = rows.groupBy("key").agg(F.count("*").alias("rows"), (F.min("own") != F.max("own")).alias("mixed"))
        huge = checkpoint(counted.where(F.col("rows") > AT_ONCE))
        if huge.isEmpty():
            met = checkpoint(_met_dense(rows, most))
        else:
            usual = _met_dense(rows.join(sent(huge.select("key")), "key", "left_anti"), most)
            met = checkpoint(usual.unionByName(_met_in_parts(rows, huge.where("mixed").select("key", "rows"), most)))
        links = checkpoint(met.where("key is null").select("a", "b").distinct())
        dense = met.where("key is not null").select("key", "rep", "n", "pos", "sketch")
        most *= 2


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): for each document that goes, the one that stays for it.

    Copies by words are one class. Classes whose fingerprints of distinct words differ in ALIKE_BITS bits or fewer are
    candidates, met by pigeonhole blocks; a candidate pair counts if ALIKE of its SHINGLE-word shingles are in common.
    That joins most groups at the cost of a tree of links each. An exact join (prefix_copies) then finds the pairs that
    are ALIKE between those groups. So groups are the components of all ALIKE pairs, whatever the number of rows or
    partitions; the smallest doc_id of each stays.
    """
    named = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    own = checkpoint(_identities(named))
    classes = checkpoint(own.groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp")))
    copies = checkpoint(own.join(classes.select("same", "rep"), "same").where("doc_id <> rep").select("doc_id", "rep").distinct())
    links = checkpoint(block_links(classes.select("rep", "fp"), ALIKE_BITS, block_masks(block_count(classes.count(), ALIKE_BITS), ALIKE_BITS)))
    groups = checkpoint(components(_alike(links, _sets_of(named, links))))
    gone = checkpoint(copies.select("doc_id").distinct().join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti"))
    joined = prefix_copies(named.join(sent(gone), "doc_id", "left_anti"), groups)
    links = joined.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    return components(links).where("id <> label").select(F.col("id").alias("doc_id"), F.col("label").alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` less near copies: one document of each group stays, that of the smallest doc_id. All columns stay.

    Null and blank texts are copies of one another. Rows that repeat a doc_id count as copies too: one of them stays.
    Rows with a null doc_id stay. An empty table gives an empty one; columns may have any names.
    """
    rows, at = positional(docs), f"c{docs.columns.index('doc_id')}"
    gone = checkpoint(near_copies(docs).select(F.col("doc_id").alias("gone")))
    kept = rows.join(sent(gone), F.col(at) == F.col("gone"), "left_anti")
    repeated = checkpoint(rows.where(F.col(at).isNotNull()).groupBy(at).agg(F.count("*").alias("n")).where("n > 1").select(F.col(at).alias("twice")))
    if not repeated.isEmpty():
        single = kept.join(repeated, F.col(at) == F.col("twice"), "left_anti")
        kept = single.unionByName(kept.join(repeated, F.col(at) == F.col("twice"), "left_semi").dropDuplicates([at]))
    return kept.toDF(*docs.columns)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
