"""Token counts without token ids: pieces are counted once per distinct pre-token.

A text's tokens are the sum over its pre-tokens, since a pre-token's pieces depend on it alone. So every document gives
its pre-tokens with their frequencies; each distinct pre-token is counted once by the model; a join and a sum follow.

Pre-tokens that are frequent in a bounded sample are counted first and reach all tasks as a dictionary of bounded size
(MOST_COMMON); documents only send the others. What is sent depends on the sample, what comes out doesn't.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_sample, checkpoint, record_batch, slices, texts_of, tidy

#: Pre-tokens of the dictionary that every task has, at most, and documents that it is drawn from, about.
MOST_COMMON, COMMON_DOCS = 100_000, 5_000
# How a tokenizers file says that text is lower-cased and cut into runs of letters, single digits and runs of others.
LOWER_CASE = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of a text that are cut into units at once, and units whose pre-tokens a task keeps.
AT_ONCE, MOST_UNITS = 1 << 20, 300_000
MARKS = frozenset(".,;:!?-|()\"")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in seen)}


BYTES, LATIN = _byte_characters(), re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_level(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)


_OWN: dict[str, Cutter] = {}


def _cutter(digest: str, serialized) -> Cutter:
    """The worker's own: it is kept from task to task, as loading takes longer than a small task."""
    if digest not in _OWN:
        _OWN.clear()
        _OWN[digest] = Cutter(serialized.value)
    return _OWN[digest]


class Cutter:
    """Pre-tokens of texts by a tokenizers file, and how many pieces a pre-token has.

    Its normaliser and pre-tokenizer must treat the parts between spaces or line feeds by themselves, as all do that drop
    white space. Special strings inside a text count as one token each, as the library does by default. If the file says
    that text is lower-cased and cut into runs of letters, words of Latin letters up to ÿ (and those with a mark behind
    them) are cut here; all others, and all words of other files, go through the library.
    """

    def __init__(self, serialized: str):
        t = Tokenizer.from_str(serialized)
        self.normalizer, self.pre_tokenizer, self.model = t.normalizer, t.pre_tokenizer, t.model
        told = json.loads(serialized)
        added = [t for t in told["added_tokens"] if t["content"]]
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        runs = [c.get("pattern", {}).get("Regex") for c in cuts] == [LETTER_RUNS, None] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        self.plain = (told["normalizer"] or {}).get("normalizers") == LOWER_CASE and runs and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        if odd := [t["content"] for t in added if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])]:
            raise ValueError(f"added tokens that are looked for in normalised texts or beside white space: {odd[:5]}")
        self.special = re.compile("|".join(map(re.escape, sorted((t["content"] for t in added), key=len, reverse=True)))) if added else None
        if any(self.count(" ".join(x)) != sum(map(self.count, x)) for x in (("a", "b"), ("'s", "1"), ("é", "-"))):
            raise ValueError("a space between two texts changes their tokens")

    def units(self, text: str) -> Iterator[Counter[str]]:
        """The text between spaces and line feeds, with frequencies, part by part."""
        at = 0
        while at < len(text):
            end = text.find(" ", at + AT_ONCE) if len(text) - at > AT_ONCE else -1
            end = len(text) if end < 0 else end
            found = Counter(text[at:end].replace("\n", " ").split(" "))
            found.pop("", None)
            yield found
            at = end + 1

    def cut(self, units: list[str]) -> list[tuple[int, list[str]]]:
        """How many special strings each unit holds, and its pre-tokens. The library gets all units that it must cut at once."""
        out: list[tuple[int, list[str]]] = []
        parts, owners, starts, at = [], [], [], 0
        for i, unit in enumerate(units):
            if self.plain:
                if LATIN.fullmatch(unit):
                    out.append((0, [_byte_level(unit.lower())]))
                    continue
                if unit[-1] in MARKS and LATIN.fullmatch(unit, 0, len(unit) - 1):
                    out.append((0, [_byte_level(unit[:-1].lower()), unit[-1]]))
                    continue
            cut = self.special.split(unit) if self.special and self.special.search(unit) else [unit]
            out.append((len(cut) - 1, []))
            for part in filter(None, cut):
                parts.append(self.normalizer.normalize_str(part) if self.normalizer else part)
                owners.append(i)
                starts.append(at)
                at += len(parts[-1]) + 1
        if not self.pre_tokenizer:
            for i, part in zip(owners, parts, strict=True):
                out[i][1].append(part)
        elif parts:
            k, last = 0, len(starts) - 1
            for word, (start, _) in self.pre_tokenizer.pre_tokenize_str("\n".join(parts)):
                while k < last and starts[k + 1] <= start:
                    k += 1
                out[owners[k]][1].append(word)
        return out

    def pieces(self, pre_token: str) -> int:
        return len(self.model.tokenize(pre_token))

    def count(self, text: str) -> int:
        return sum(n * (s + sum(map(self.pieces, w))) for found in self.units(text) for n, (s, w) in zip(found.values(), self.cut(list(found)), strict=True))


def _sent(texts: DataFrame, digest: str, serialized, common) -> DataFrame:
    """Each row of (text, ...) with n, words, times for its text: tokens of what the dictionary has, and the other pre-tokens."""
    schema = pa.schema([("n", pa.int64()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known, kept = _cutter(digest, serialized), common.value, {}
        for batch in slices(batches):
            sums, words, times = [], [], []
            for text in texts_of(batch):
                n, rest = 0, Counter()
                for found in cutter.units(text):
                    if len(kept) >= MOST_UNITS:
                        kept.clear()
                    new = [unit for unit in found if unit not in kept]
                    for unit, (special, cut) in zip(new, cutter.cut(new), strict=True):
                        kept[unit] = special + sum(known.get(w, 0) for w in cut), tuple(w for w in cut if w not in known)
                    for unit, k in found.items():
                        fixed, others = kept[unit]
                        n += k * fixed
                        for w in others:
                            rest[w] += k
                sums.append(n)
                words.append(list(rest))
                times.append(list(rest.values()))
            out = record_batch({"n": sums, "words": words, "times": times}, schema)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out.columns], names=[*batch.schema.names[1:], *out.schema.names])

    kept = [f"{name} {kind}" for name, kind in texts.dtypes[1:]]
    return texts.mapInArrow(tidy(run), ", ".join([*kept, "n long", "words array<string>", "times array<long>"]))


def _counted(words: DataFrame, digest: str, serialized) -> DataFrame:
    """(word, pieces) for each row of (word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(digest, serialized)
        for batch in slices(batches, 10_000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(cutter.pieces, batch.column(0).to_pylist()), pa.int64())], names=["word", "pieces"])

    return words.mapInArrow(tidy(run), "word string, pieces long")


def counted(docs: DataFrame, serialized: str, limit: int = 2048, most_common: int = MOST_COMMON) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of documents' (doc_id, text), a row for each row.

    serialized: the content of a tokenizers file. n_bytes: the text's length in UTF-8; over_limit: more tokens than
    `limit`. A null, empty or blank text has no tokens. Repeated rows and null doc_ids stay as they are; an empty table
    gives an empty one; other columns aren't looked at. A text of any length is read whole, part by part.
    """
    spark: SparkSession = docs.sparkSession
    tokenizer = hashlib.blake2b(serialized.encode()).hexdigest(), spark.sparkContext.broadcast(serialized)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    nothing = spark.sparkContext.broadcast({})
    seen = _sent(bounded_sample(rows, "doc_id", COMMON_DOCS).select("text"), *tokenizer, nothing)
    often = seen.select(F.explode("words").alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").limit(most_common)
    common = {r["word"]: r["pieces"] for r in _counted(often.select("word"), *tokenizer).collect()}
    sent = _sent(rows.select("text", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), *tokenizer, spark.sparkContext.broadcast(common))
    sent = checkpoint(sent.withColumn("row", F.monotonically_increasing_id()))
    rare = sent.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    pieces = _counted(rare.select("word").distinct(), *tokenizer)
    more = rare.join(pieces, "word").select("row", F.lit(None).cast("long"), F.lit(0).cast("long"), F.col("times") * F.col("pieces"))
    summed = sent.select("row", "doc_id", "n_bytes", "n").union(more).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
