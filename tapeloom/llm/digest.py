"""Exact document fingerprints: canonical form, wide hash, byte comparison inside equal buckets.

Canonical form: Unicode NFKC, case folding, white space runs as one space. Fingerprint: XXH3 of 128 bits of it.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, texts_of

#: Bits of the sieve that keeps single texts from being compared: 8 MB.
SIEVE_BITS = 1 << 26
#: Copies of a text beyond which its rows are dealt out over so many salts when they are joined to their group.
HOT_COPIES, SALTS = 1_000, 16


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "replace")


def wide_hash(canonical_text: str) -> str:
    """32 hex digits."""
    return xxhash.xxh3_128_hexdigest(_bytes(canonical_text))


def fingerprint(text: str) -> str:
    return wide_hash(canonical(text))


def _sieve(fps: DataFrame) -> np.ndarray:
    """A bit set of SIEVE_BITS bits with those of the fingerprints `fps` (fp); of that size for any number of them."""
    place = F.conv(F.substring("fp", 1, 12), 16, 10).cast("long") % SIEVE_BITS
    words = fps.select(place.alias("k")).groupBy(F.shiftright("k", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, int(k & 7))")).alias("bits"))
    rows = words.select("at", F.col("bits").cast("int").alias("bits")).toPandas()
    out = np.zeros(SIEVE_BITS >> 3, np.uint8)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.uint8)
    return out


def _with_group(fps: DataFrame, sizes: DataFrame) -> DataFrame:
    """fps' (doc_id, fp) with the group_id of sizes' (fp, n, group_id). Rows of much copied texts are dealt out by a salt."""
    hot = checkpoint(sizes.where(F.col("n") > HOT_COPIES).select("fp", "group_id"))  # a thousandth of the rows at most
    if hot.isEmpty():
        return fps.join(sizes.select("fp", "group_id"), "fp")
    salted = hot.select(F.col("fp").alias("hot_fp"), F.col("group_id").alias("hot_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("hot_salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    met = fps.withColumn("salt", salt).join(salted, (F.col("fp") == F.col("hot_fp")) & (F.col("salt") == F.col("hot_salt")), "left").select("doc_id", "fp", "hot_id")
    done = met.where(F.col("hot_id").isNotNull()).select("doc_id", "fp", F.col("hot_id").alias("group_id"))
    rest = met.where(F.col("hot_id").isNull()).select("doc_id", "fp").join(sizes.where(F.col("n") <= HOT_COPIES).select("fp", "group_id"), "fp")
    return done.unionByName(rest.select("doc_id", "fp", "group_id"))


def equal_groups(docs: DataFrame, fps: DataFrame, hash_: Callable[[str], str] = wide_hash) -> DataFrame:
    """(doc_id, fp, group_id): group_id is the smallest doc_id with an equal canonical text.

    fps: (doc_id, fp) of docs' (doc_id, text), fp by hash_ of canonical texts. Only texts whose bucket has two or more
    documents are compared (and the few that a sieve of fixed size takes for such). Canonical texts are a grouping key
    there, so bytes are compared, and each task sends one row on for each text that it meets: copies in any number don't
    meet in one task. If a bucket holds different texts, its members find theirs by a join on the text.
    """
    sizes = checkpoint(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("group_id")))
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(sizes.where("n > 1")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sieve.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                own = canonical(text)
                fp = hash_(own)
                k = int(fp[:12], 16) % SIEVE_BITS
                if bits[k >> 3] >> (k & 7) & 1:
                    rows.append((doc_id, fp, own))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.string(), pa.string()], strict=True)], names=["doc_id", "fp", "canonical"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp string, canonical string")
    variants = texts.groupBy("fp", "canonical").agg(F.min("doc_id").alias("group_id"))
    odd = checkpoint(variants.groupBy("fp").agg(F.count("*").alias("variants")).where("variants > 1"))
    grouped = _with_group(fps, sizes).select("doc_id", "fp", "group_id")
    if odd.isEmpty():
        return grouped
    split = texts.join(odd, "fp").join(variants.withColumnRenamed("group_id", "own"), ["fp", "canonical"]).select("doc_id", "fp", "own").distinct()
    return grouped.join(split, ["doc_id", "fp"], "left").select("doc_id", "fp", F.coalesce("own", "group_id").alias("group_id"))


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as many characters of the following one's beginning, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) of documents' (doc_id, text).

    The following document is the next in order of doc_id (nulls first, ties in order of text); the last one's is the
    first. Documents are dealt out by ranges of doc_id and read in order; a range's last document finds its follower by
    the ranges' order. A null text counts as empty.
    """
    schema = "part int, doc_id long, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, place string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 5]

    def facts(text: str, following: str, fp: str, next_fp: str) -> tuple:
        new = edited(text, following)
        return len(text), hashlib.sha256(_bytes(new)).hexdigest(), fp, fingerprint(new), next_fp

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, first = TaskContext.get().partitionId(), None, True

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                fp = fingerprint(text)
                if first:
                    rows.append((part, doc_id, text, None, None, fp, None, None, "first"))
                    first = False
                else:
                    rows.append((part, last[0], None, *facts(last[1], text, last[2], fp), "inner"))
                last = (doc_id, text, fp)
            if rows:
                yield batch_of(rows)
        if last:
            yield batch_of([(part, last[0], last[1], None, None, last[2], None, None, "last")])

    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    out = checkpoint(ordered.mapInArrow(run, schema))
    ends = out.where("place <> 'inner'")  # two rows for each range
    firsts = ends.where("place = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    parts = firsts.select("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next_part"))
    seams = ends.where("place = 'last'").join(after, "part").join(firsts.withColumnRenamed("part", "next_part"), "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *facts(text, following, fp, next_fp)) for doc_id, text, fp, following, next_fp in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), *[pa.string()] * 4], strict=True)], names=["doc_id", *names[3:8]])

    result = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    closed = seams.select("doc_id", "text", "fingerprint", "next_text", "next_fp").mapInArrow(close, result)
    return out.where("place = 'inner'").select("doc_id", *names[3:8]).unionByName(closed)


def compared(docs: DataFrame) -> DataFrame:
    """with_edits, the likeness of fingerprints (1 if equal, else 0: the digest is exact), and group_id by equal_groups."""
    facts = checkpoint(with_edits(docs))
    groups = equal_groups(docs, facts.select("doc_id", F.col("fingerprint").alias("fp"))).groupBy(F.col("doc_id").alias("of"), F.col("fp").alias("with")).agg(F.min("group_id").alias("group_id"))
    same = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    out = facts.join(groups, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("fingerprint") == F.col("with")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        same("fingerprint", "edited_fingerprint").alias("near_edited"), same("fingerprint", "next_fingerprint").alias("near_next"), "group_id",
    )
