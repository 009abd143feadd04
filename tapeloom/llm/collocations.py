"""Phrases whose words belong together, by level-wise passes over the corpus.

Level k counts phrases of k words, but only those of which both phrases of k - 1 words are frequent: what is frequent at
level k - 1 reaches all tasks as a sieve, a bit table of bounded size (MOST_BITS). A sieve may let others through, never
hold back a frequent one, so it decides how much is counted and not what comes out.

Levels between the first and the last are counted by 64-bit hashes, within a task first. A last pass counts phrases by
their words: those of the last level, and of the others what passes its own level's sieve; so no count rests on a hash.
Cuts are scored from that table and the table of words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, record_batch, slices, tidy

#: Parts that a language's phrases are ranked in.
PARTS = 64
#: A piece of text ends at these, words within it at blanks and tabs.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Bits of a sieve at most, bits for each phrase as long as there are so few, distinct hashes that a task counts up before
#: it sends them, words that it remembers, and bytes of text that it cuts into words at once.
MOST_BITS, BITS_EACH, MOST_HELD, MOST_WORDS, AT_ONCE = 1 << 28, 64, 4_000_000, 500_000, 4 << 20
MARK = ENDS[:1]
_TABLE = bytes.maketrans(ENDS + b"\t", MARK * len(ENDS) + b" ")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """Words in order, with MARK where a piece ends; A-Z are lower-cased."""
    return text.lower().translate(_TABLE).replace(MARK, b" " + MARK + b" ").split()


class Hashes(dict):
    """The hash of each word of a language, remembered; 0 is MARK's alone."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "replace"))
        super().__init__({MARK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed) or 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
            self[MARK] = 0
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def longer(shorter: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the phrases of k words that begin at each place, from those of k - 1; 0 where a piece ends within."""
    n = max(0, len(words) - k + 1)
    h, last = shorter[:n], words[k - 1 :]
    x = (h ^ (h >> np.uint64(29))) * _FACTOR + last
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(31)
    x[(h == 0) | (last == 0)] = 0
    return x


@dataclass
class Sieve:
    """A set of hashes as a table of bits: two bits each."""

    bits: np.ndarray

    def passes(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.bits) * 64 - 1)

        def on(x: np.ndarray) -> np.ndarray:
            x = x & mask
            return (self.bits[x >> np.uint64(6)] >> (x & np.uint64(63))) & np.uint64(1) != 0

        return on(h) & on(h >> np.uint64(32)) & (h != 0)

    @staticmethod
    def of(hashes: DataFrame, n: int) -> Sieve:
        """From (h), of which there are n. The bits are set on the executors; the driver gets words of 64 that aren't 0, MOST_BITS / 64 at most."""
        size = min(MOST_BITS, max(1 << 12, 1 << int(n * BITS_EACH - 1).bit_length()))
        at = F.explode(F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(size - 1)))).alias("at")
        bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
        found = hashes.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bits = np.zeros(size // 64, np.uint64)
        bits[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
        return Sieve(bits)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, text in UTF-8) of parts of a batch: texts of a language one behind another, about AT_ONCE bytes at once."""
    for batch in slices(batches, 2_000):
        held: dict[str, list[bytes]] = {}
        sizes: Counter[str] = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            held.setdefault(lang, []).append(raw)
            sizes[lang] += len(raw)
            if sizes[lang] > AT_ONCE:
                yield lang, MARK.join(held.pop(lang))
                del sizes[lang]
        for lang, texts in held.items():
            yield lang, MARK.join(texts)


def _words(rows: DataFrame) -> DataFrame:
    """(lang, phrase, a) of single words by task, and a row without phrase for each language that counts all its words."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter[bytes]] = {}

        def out() -> pa.RecordBatch:
            parts = [(lang, w.decode(), n) for lang, c in held.items() for w, n in c.items()]
            parts += [(lang, None, sum(c.values())) for lang, c in held.items()]
            held.clear()
            return record_batch(dict(zip(schema.names, zip(*parts, strict=True), strict=True)) if parts else dict.fromkeys(schema.names, ()), schema)

        for lang, text in _texts(batches):
            c = held.setdefault(lang, Counter())
            c.update(tokens(text))
            c.pop(MARK, None)
            if sum(map(len, held.values())) > MOST_WORDS:
                yield out()
        yield out()

    return rows.mapInArrow(tidy(run), "lang string, phrase string, a long")


def _hashed(rows: DataFrame, k: int, sieve) -> DataFrame:
    """(h, a) by task: hashes of phrases of k words of which both phrases of k - 1 words pass the sieve, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, Hashes] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            return h[first], np.add.reduceat(n, first)

        def out(h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], names=["h", "a"])

        for lang, text in _texts(batches):
            words = h = ids.setdefault(lang, Hashes(lang)).of(tokens(text))
            for j in range(2, k):
                h = longer(h, words, j)
            on = sieve.value.passes(h)
            grams = longer(h, words, k)
            grams = grams[on[: len(grams)] & on[1 : len(grams) + 1] & (grams != 0)] if len(grams) else grams
            if len(grams):
                held.append(np.unique(grams, return_counts=True))
            if sum(len(x) for x, _ in held) > MOST_HELD:
                held = [summed()]
                if len(held[0][0]) > MOST_HELD // 2:
                    yield from out(*held.pop())
        if held:
            yield from out(*summed())

    return rows.mapInArrow(tidy(run), "h long, a long")


def _phrases(rows: DataFrame, sieves, longest: int) -> DataFrame:
    """(lang, phrase, a) by task: phrases that pass the sieve of their length, and longest ones of which both shorter phrases pass theirs.

    sieves: those of 1, 2, ... words; there is none from the first length on that has no frequent phrase.
    """
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, Hashes] = {}
        held: dict[str, Counter[bytes]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                yield record_batch({"lang": [lang] * len(c), "phrase": [w.decode() for w in c], "a": list(c.values())}, schema)
            held.clear()

        for lang, text in _texts(batches):
            parts = tokens(text)
            words = h = ids.setdefault(lang, Hashes(lang)).of(parts)
            c = held.setdefault(lang, Counter())
            on = np.ones(0, bool)
            for k in range(2, min(longest, len(sieves.value) + 1) + 1):
                last = k == longest
                on = sieves.value[k - 2].passes(h) if last else on
                h = longer(h, words, k)
                on = on[: len(h)] & on[1 : len(h) + 1] & (h != 0) if last else sieves.value[k - 1].passes(h) if k <= len(sieves.value) else on[:0]
                c.update(b" ".join(parts[i : i + k]) for i in np.flatnonzero(on).tolist())
            if sum(map(len, held.values())) > MOST_WORDS:
                yield from out()
        yield from out()

    return rows.mapInArrow(tidy(run), "lang string, phrase string, a long")


def _word_hashes(words: DataFrame) -> DataFrame:
    """(h) of (lang, phrase), phrases being single words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[str, Hashes] = {}
        for batch in batches:
            h = [ids.setdefault(lang, Hashes(lang))[w.encode()] for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], names=["h"])

    return words.select("lang", "phrase").mapInArrow(run, "h long")


def counts(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of 1 to `longest` words with a >= `least`, and (lang, n): all words of each language."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").alias("text")).where("text is not null")
    total = _words(rows).groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    total = checkpoint(total.where(F.col("phrase").isNull() | (F.col("a") >= least)))
    words, sizes = total.where("phrase is not null"), total.where("phrase is null and a > 0").select("lang", F.col("a").alias("n"))
    level, sieves = _word_hashes(words), []
    for k in range(1, longest):
        if k > 1:
            level = checkpoint(_hashed(rows, k, sc.broadcast(sieves[-1])).groupBy("h").agg(F.sum("a").alias("a")).where(F.col("a") >= least).select("h"))
        n = level.count()
        if not n:
            break
        sieves.append(Sieve.of(level, n))
    phrases = _phrases(rows, sc.broadcast(sieves), longest).groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return words.unionByName(checkpoint(phrases)), sizes


def score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)) of whole decimals of up to 19 digits."""
    product = (a * n).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", product, (left * right).cast("decimal(38,0)")).cast("long")


def scored(docs: DataFrame, least: int = 100, longest: int = 5, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `most` phrases of each language of documents' (lang, text).

    A phrase is of 2 to `longest` words within a piece of text and occurs a >= `least` times. Cutting it gives l and r,
    the counts of its parts, and floor(1000 a n / (l r)), n being all words of the language; the lowest cut is the score,
    the first one of equals. A phrase goes if a longer frequent one holds it and is as frequent. Order: score, a, phrase.
    A null lang is `und`, a null or empty text has no words; repeated rows count each; doc_id and other columns aren't
    looked at. An empty table, and one without a phrase that frequent, give an empty one. Products are decimals of 38
    digits: exact up to that.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    found, sizes = counts(docs, least, longest)
    words = F.split("phrase", " ")
    phrases = found.withColumn("w", words).where(F.size("w") > 1)
    span = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    # A phrase that holds this one is as frequent only if one that is longer by a single word is.
    within = phrases.where(F.size("w") > 2).select("lang", F.explode(F.array(span(F.lit(1), F.size("w") - 1), span(F.lit(2), F.size("w") - 1))).alias("phrase"), F.col("a").alias("more"))
    kept = phrases.join(within.groupBy("lang", "phrase").agg(F.max("more").alias("more")), ["lang", "phrase"], "left").where("more is null or more < a")
    cuts = kept.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", span(F.lit(1), F.col("k")).alias("first"), span(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(sizes, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    value = score(*map(wide, ("a", "n", "l", "r")))
    best = cuts.select("lang", "phrase", "a", "n", F.struct(value.alias("score"), "k", "l", "r").alias("x")).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min("x").alias("x"))
    order = [F.desc("x.score"), F.desc("a"), F.col("phrase")]
    # a language's phrases are ranked within PARTS first, of each of which no more than `most` can be among the first
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "x.l", "x.r", "n", "x.score")
