"""Quality by Bradley-Terry pairwise ranking.

Documents get a few dozen shape features. Preference pairs (a document labelled 1 over one labelled 0) are learned by
logistic loss on the differences of their features, so a document's worth is one linear score. The cut between good and
bad is a quantile of the training scores; the reported score is a logistic of the worth, set so that the cut is at 0.3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, positional, slices, texts_of, tidy

CUT = 0.3
#: Labelled documents to fit on, and preference pairs drawn from them.
MOST_LABELLED, PAIRS = 20_000, 200_000

NAMES = (
    "length", "word_length", "upper", "digit", "space", "line", "pipe", "mark", "symbol", "wide", "words", "distinct", "short", "same_line",
    "top_word", "top_pair", "end_symbol", "no_letter", "long_word", "stop", "sentence_words", "caps_word", "single_line", "entropy",
)


def features(text: str) -> list[float]:
    """The shape of a text, each a share or a logarithm; an empty text has zeros."""
    if not text.strip():
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "replace")
    n = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = len(raw)
    upper, digit = n[65:91].sum(), n[48:58].sum()
    letters = upper + n[97:123].sum() + n[128:].sum()
    stops, marks = n[46] + n[63] + n[33], n[33] + n[63]
    symbols = n[35:39].sum() + n[42:44].sum() + n[60:63].sum() + n[64] + n[91:97].sum() + n[123] + n[125:127].sum()
    words = text.split()
    m = len(words)
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, m)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x]
    ends = sum(w[-1] in "#$%&*!|~^" for w in words)
    share = n[n > 0] / total
    return [
        np.log(total), np.log(lengths.mean()), upper / total, digit / total, (n[32] + n[9]) / total, n[10] / total, n[124] / total, marks / total, symbols / total,
        n[128:].sum() / total, np.log(m), len(count) / m, (lengths <= 3).mean(), 1 - len(set(lines)) / len(lines), max(count.values()) / m, 1 - pairs / max(1, m - 1),
        ends / m, 1 - letters / total, (lengths > 20).mean(), stops / m, np.log(m / (1 + stops)), sum(map(str.isupper, words)) / m, np.log(m / len(lines)), -(share * np.log(share)).sum(),
    ]


def basis(x: np.ndarray) -> np.ndarray:
    """Features and their squares: the best value may lie in the middle."""
    return np.hstack([x, x * x])


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    cut: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return basis(np.clip((x - self.mean) / self.scale, -6, 6)) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; CUT where the worth is at the cut."""
        z = self.slope * (self.worth(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's method for logistic loss."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = 42) -> Ranker:
    """With one label only (or none), every document scores 0.5 or the label's side of the cut."""
    d = x.shape[1] if x.ndim == 2 else len(NAMES)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return Ranker(np.zeros(d), np.ones(d), np.zeros(2 * d), 1.0, {True: -1.0, False: 1.0}[bool(len(good) or not len(bad))])
    mean, scale = x.mean(0), x.std(0)
    ranker = Ranker(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(2 * d), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    z = basis(np.clip((x - mean) / ranker.scale, -6, 6))
    i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
    side = rng.integers(0, 2, pairs)  # which of the two comes first
    w = logistic((z[i] - z[j]) * (2 * side - 1)[:, None], side.astype(float), ridge=pairs * 1e-4)
    worth = z @ w
    order = np.sort(worth)
    share = np.linspace(0, 1, 501)[1:-1]
    cuts = np.quantile(order, share)
    right = [(worth[good] >= c).mean() + (worth[bad] < c).mean() for c in cuts]
    cut = float(cuts[int(np.argmax(right))])  # the quantile that tells the labels apart best
    spread = max(worth.std(), 1e-9)
    return Ranker(mean, ranker.scale, w, min(1.0, 4 / spread), cut)


def fit_on(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Ranker:
    """Fits on documents that `labels` (doc_id, quality) names; about `most` of them at most, chosen by a hash of doc_id.

    Null labels and other values than 0 and 1 don't count; of several labels of a document, the smallest counts.
    """
    named = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = bounded_sample(named, "doc_id", most)
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(few), "doc_id")  # at most about `most` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [features(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = rows.select("doc_id", "quality", "text").mapInArrow(tidy(run), "doc_id long, quality long, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    return fit(np.array(got["x"].tolist(), float).reshape(-1, len(NAMES)), got["quality"].to_numpy(int))


def _scores(texts: pa.Array, ranker: Ranker) -> np.ndarray:
    x = np.array([features(t or "") for t in texts.to_pylist()], float)
    return ranker.score(x.reshape(-1, len(NAMES)))


def scored(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, score) of every row of documents' (doc_id, text), score a double from 0 to 1.

    A null text scores as an empty one. Rows are independent: repeated or null doc_ids keep their rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), ranker))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, score double")


def accepted(docs: DataFrame, ranker: Ranker, cut: float = CUT) -> DataFrame:
    """The rows of `docs`, of any columns, whose text scores `cut` or more; a null text scores as an empty one."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_scores(batch.column(at), ranker) >= cut))

    rows = positional(docs)
    return rows.mapInArrow(tidy(run), rows.schema).toDF(*docs.columns)
