"""Vectors of texts. An embedder turns a batch of texts into unit vectors; the default needs no model.

HashingEmbedder hashes words and their character n-grams into a few hundred signed dimensions. Features can be weighted
by how few of a corpus's texts have them: frequencies are kept by hash, in a table of fixed size.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: Frequencies of features are counted under so many hashes; words that a task remembers; texts and summaries at once.
BUCKETS, MOST_WORDS, AT_ONCE, SUMMARIES = 1 << 16, 50_000, 256, 64
WORD = re.compile(r"\w+")


class Embedder(Protocol):
    """Anything that is sent to the tasks and gives unit rows there (a zero row for a text without content)."""

    dimension: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


def _md5(feature: str) -> bytes:
    return hashlib.md5(feature.encode("utf-8", "replace"), usedforsecurity=False).digest()[:4]


@dataclass
class HashingEmbedder:
    """Signed feature hashing of lower-cased words and of the n-grams of `<word>`, scaled to unit length.

    The first 32 bits h of a feature's MD5 say where it counts: dimension h mod d, sign by the parity of h div d, weight
    by h mod BUCKETS; SQL can do the same.
    """

    dimension: int = 384
    grams: int = 3
    weights: np.ndarray | None = None
    _known: dict[str, bytes] = field(default_factory=dict, repr=False, compare=False)
    _grams: dict[str, bytes] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}, "_grams": {}}

    def _hashed(self, word: str) -> bytes:
        """The word's features' hashes, four bytes each: little to keep for each word, and joined at once for many."""
        got = self._known.get(word)
        if got is None:
            if len(self._known) >= MOST_WORDS:
                self._known.clear()
            marked, known = f"<{word}>", self._grams
            parts = [_md5(f"={word}")]
            for i in range(len(marked) - self.grams + 1):
                gram = marked[i : i + self.grams]
                h = known.get(gram)
                if h is None:  # new words have few n-grams that are new
                    if len(known) >= MOST_WORDS:
                        known.clear()
                    h = known[gram] = _md5(gram)
                parts.append(h)
            got = self._known[word] = b"".join(parts)
        return got

    def hashes(self, words: Sequence[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self._hashed, words)), ">u4").astype(np.int64)

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            h = self.hashes(WORD.findall(text.lower()))
            sign = 1.0 - 2.0 * (h // self.dimension % 2)
            row += np.bincount(h % self.dimension, sign if self.weights is None else sign * self.weights[h % BUCKETS], self.dimension)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def frequencies(self, texts: DataFrame) -> DataFrame:
        """(bucket, df) of (text): texts that have a feature under a hash; bucket -1 counts all texts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, df = 0, np.zeros(BUCKETS, np.int64)
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    n += 1
                    df[np.unique(self.hashes(list(set(WORD.findall((text or "").lower())))) % BUCKETS)] += 1
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[n, df[at]])], names=["bucket", "df"])

        return texts.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df"))

    def fitted(self, texts: DataFrame) -> HashingEmbedder:
        """With weights ln((1 + n) / (1 + df)) + 1 from a corpus (text): BUCKETS + 1 rows reach the driver at most."""
        found = self.frequencies(texts).toArrow()
        at, df = found["bucket"].to_numpy(), found["df"].to_numpy()
        n, by = int(df[at < 0].sum()), np.zeros(BUCKETS)
        by[at[at >= 0]] = df[at >= 0]
        return HashingEmbedder(self.dimension, self.grams, np.log((1.0 + n) / (1.0 + by)) + 1.0)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(i, AT_ONCE)


def _lists(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.astype(np.float32).ravel()))


def embedded(texts: DataFrame, embedder: Embedder) -> DataFrame:
    """`texts` with a column `embedding` of its `text`; a null text has that of an empty one."""
    sent = texts.sparkSession.sparkContext.broadcast(cloudpickle.dumps(embedder))  # of any class, also one defined in a notebook
    place = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Embedder = pickle.loads(sent.value)
        for batch in _rows(batches):
            v = own.encode([t or "" for t in batch.column(place).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(v)], names=[*batch.schema.names, "embedding"])

    return texts.mapInArrow(run, S.StructType([*texts.schema.fields, S.StructField("embedding", S.ArrayType(S.FloatType()))]))


def likeness(texts: DataFrame, key: str, summaries: DataFrame, embedder: Embedder, nearest: bool = False) -> DataFrame:
    """`texts` with a column `best`: the greatest cosine of its `text` to a sentence of its key's summary (key, sentences).

    Null if the key has no summary, or one without sentences. With `nearest`, the place of that sentence (to nine digits,
    the first of equals) and the text's own `embedding` come too. Texts meet their summary's few sentences by an
    equi-join; a task keeps the vectors of SUMMARIES summaries.
    """
    sent = texts.sparkSession.sparkContext.broadcast(cloudpickle.dumps(embedder))  # of any class, also one defined in a notebook
    place = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Embedder = pickle.loads(sent.value)
        known: dict[tuple, np.ndarray] = {}
        for batch in _rows(batches):
            rows: dict[tuple, list[int]] = {}
            for i, s in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if s:
                    rows.setdefault(tuple(s), []).append(i)
            v, best, at_ = own.encode([t or "" for t in batch.column(place).to_pylist()]), np.full(batch.num_rows, np.nan), np.full(batch.num_rows, np.nan)
            for s, at in rows.items():
                if s not in known:
                    if len(known) >= SUMMARIES:
                        known.clear()
                    known[s] = own.encode(s)
                cosines = v[at] @ known[s].T
                best[at], at_[at] = cosines.max(axis=1), np.round(cosines, 9).argmax(axis=1)
            out = {"best": pa.array(best, from_pandas=True)}
            if nearest:
                out |= {"nearest": pa.array(at_, from_pandas=True).cast(pa.int32()), "embedding": _lists(v)}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *out.values()], names=[*batch.schema.names[:-1], *out])

    joined = texts.join(summaries.select(key, F.col("sentences").alias("__sentences")), key, "left").select(*texts.columns, "__sentences")
    more = [S.StructField("best", S.DoubleType())]
    if nearest:
        more += [S.StructField("nearest", S.IntegerType()), S.StructField("embedding", S.ArrayType(S.FloatType()))]
    return joined.mapInArrow(run, S.StructType([*texts.schema.fields, *more]))
