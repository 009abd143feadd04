"""Language identification of mixed text.

Runs of letters are cut into words at changes of script (in scripts without spaces, into single letters; others after
PIECE letters). Script ranges narrow a word's candidate languages; a word scores each candidate by its frequency among the
language's training words, or by its letter trigrams if it is unknown; Viterbi over the words with a penalty for each switch labels
spans, and the document's language is the one whose spans hold most letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, slices, texts_of, tidy

#: What is learned from, at most: documents of each language and characters of their texts, about. All words and trigrams
#: of these documents count, so this bounds the model; a word has a score for each language that it occurs in.
DOCS_PER_LANGUAGE, CHARS_PER_LANGUAGE = 3_000, 8_000_000
#: Letters of a word at most, scores that a task keeps of words met before, and documents whose words it holds at once.
PIECE, MOST_CACHED, AT_ONCE = 64, 2_000_000, 500
#: What a switch of language costs, and the least score of a word: both in nats.
SWITCH, FLOOR = 6.0, -8.0
UNKNOWN = "und"

RUNS, PLAIN = re.compile(r"[^\W\d_]+"), re.compile(rf"[a-z]{{1,{PIECE}}}")
# First and last code point of blocks, and their script. Letters elsewhere count as "other".
SCRIPTS = (
    (0x0041, 0x024F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x0370, 0x03FF, "greek"), (0x1F00, 0x1FFF, "greek"), (0x0400, 0x052F, "cyrillic"),
    (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0xAC00, 0xD7AF, "hangul"),
    (0x3040, 0x309F, "kana"), (0x30A0, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"),
)


UNSPACED = ("han", "kana", "thai")


def _splitter() -> re.Pattern:
    """Words within a run of letters."""
    chars: dict[str, str] = {}
    for a, b, name in SCRIPTS:
        chars[name] = chars.get(name, "") + "".join(c for c in map(chr, range(a, b + 1)) if c.isalpha())
    one = [f"[{c}]" if name in UNSPACED else f"[{c}]{{1,{PIECE}}}" for name, c in chars.items()]
    return re.compile("|".join([*one, f"[^{''.join(chars.values())}]{{1,{PIECE}}}"]))


SPLITTER = _splitter()


def script(word: str) -> str:
    """Of the word's first letter, which is that of all of them."""
    c = ord(word[0])
    return next((s for a, b, s in SCRIPTS if a <= c <= b), "other")


@lru_cache(1 << 16)
def _split(run: str) -> tuple[str, ...]:
    return tuple(w for w in SPLITTER.findall(run) if any(map(str.isalpha, w)))


def words_of(text: str) -> list[str]:
    low = text.lower()
    if low.isascii():
        return PLAIN.findall(low)
    out: list[str] = []
    for run in RUNS.findall(low):
        if run.isascii() and len(run) <= PIECE:
            out.append(run)
        else:
            out += _split(run)
    return out


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Table:
    """Log probabilities of items by language, by additive smoothing, with what each language gives one that it lacks.

    Only scores of items that a language has are held (sparse rows), however many languages there are.
    """

    def __init__(self, counts: dict[str, dict[int, float]], languages: int):
        self.row = dict(zip(counts, range(len(counts)), strict=True))
        self.starts = np.cumsum([0, *map(len, counts.values())])
        self.lang = np.fromiter((k for by in counts.values() for k in by), np.int32, self.starts[-1])
        n = np.fromiter((x for by in counts.values() for x in by.values()), np.float64, self.starts[-1])
        total = np.bincount(self.lang, n, languages) + 0.1 * len(counts) + 1e-9
        self.none = np.log(0.1 / total).astype(np.float32)
        self.more = (np.log((n + 0.1) / total[self.lang]) - np.log(0.1 / total[self.lang])).astype(np.float32)

    def sums(self, at: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """For each of `rows` rows, the sum of the scores of the items `at` that belong to it; unknown items (-1) add nothing."""
        at, row = at[at >= 0], row[at >= 0]
        out = np.bincount(row, minlength=rows)[:, None].astype(np.float32) * self.none
        size = self.starts[at + 1] - self.starts[at]
        place = np.repeat(self.starts[at] - np.cumsum(np.r_[0, size[:-1]]), size) + np.arange(size.sum())
        flat = np.repeat(row, size) * len(self.none) + self.lang[place]
        return out + np.bincount(flat, self.more[place], rows * len(self.none)).reshape(out.shape).astype(np.float32)

    def keys(self) -> Iterable[str]:
        return self.row.keys()


@dataclass
class Model:
    """What is learned, and a worker's cache of the scores of words met so far (bounded: it is emptied when full)."""

    languages: list[str]
    prior: np.ndarray
    scripts: dict[str, np.ndarray]
    words: Table
    grams: Table
    row_of: dict[str, int] = field(default_factory=dict)
    rows: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"row_of": {}, "rows": None}

    def rows_for(self, words: list[str]) -> np.ndarray:
        """A row of scores per language for each word."""
        if len(self.row_of) * len(self.languages) > MOST_CACHED:
            self.row_of, self.rows = {}, None
        new = list(set(words) - self.row_of.keys())
        if new:
            n, need = len(self.row_of), len(self.row_of) + len(new)
            if self.rows is None or need > len(self.rows):  # room for twice as many, so that growing copies little
                grown = np.empty((2 * need, len(self.languages)), np.float32)
                if self.rows is not None:
                    grown[:n] = self.rows[:n]
                self.rows = grown
            self.rows[n:need] = self.scores(new)
            self.row_of.update(zip(new, range(n, need), strict=True))
        return self.rows[np.fromiter(map(self.row_of.__getitem__, words), np.int64, len(words))]

    def scores(self, words: list[str]) -> np.ndarray:
        known = np.array([self.words.row.get(w, -1) for w in words])
        out = self.words.sums(known, np.arange(len(words)), len(words))
        where = np.flatnonzero(known < 0)
        if len(where):
            grams = [[self.grams.row.get(g, -1) for g in trigrams(words[k])] for k in where]
            out[where] = self.grams.sums(np.concatenate(grams), np.repeat(np.arange(len(where)), list(map(len, grams))), len(where))
        never = np.zeros(out.shape[1], bool)
        allowed = np.array([self.scripts.get(script(w), never) for w in words])
        out = np.where(allowed, out, -1e4)
        out = np.maximum(out - out.max(1, keepdims=True), FLOOR)
        return np.where(allowed | ~allowed.any(1, keepdims=True), out, 2 * FLOOR) * allowed.any(1, keepdims=True)


Counts = dict[int, float] | np.ndarray


def build(languages: list[str], docs: np.ndarray, words: dict[str, Counts], grams: dict[str, Counts]) -> Model:
    """words, grams: counts by language (its place in `languages`), those that aren't 0 or all."""
    sparse = lambda table: {w: by if isinstance(by, dict) else {k: float(x) for k, x in enumerate(by) if x} for w, by in table.items()}
    words, grams = sparse(words), sparse(grams)
    by_script: dict[str, np.ndarray] = {}
    for w, by in words.items():
        n = by_script.setdefault(script(w), np.zeros(len(languages)))
        for k, x in by.items():
            n[k] += x
    total = sum(by_script.values(), np.zeros(len(languages)))
    few = 0.002 * np.maximum(total, 1)
    return Model(languages, np.log((docs + 1) / (docs.sum() + len(docs))), {s: n > few for s, n in by_script.items()}, Table(words, len(languages)), Table(grams, len(languages)))


def viterbi(scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best label of each word; texts stand one after another, `lengths` words each, longest first. All texts at once."""
    states = scores.shape[1]
    starts = np.cumsum(np.r_[0, lengths[:-1]])
    best = scores[starts].astype(np.float64)
    stay, jump = np.ones(scores.shape, bool), np.zeros(len(scores), np.int32)
    active = len(lengths)
    for t in range(1, int(lengths[0])):
        while lengths[active - 1] <= t:
            active -= 1
        at, b = starts[:active] + t, best[:active]
        top = b.argmax(1)
        leap = b[np.arange(active), top] - SWITCH
        keep = b >= leap[:, None]
        stay[at], jump[at] = keep, top
        best[:active] = np.where(keep, b, leap[:, None]) + scores[at]
    label = np.zeros(len(scores), np.int32)
    state = best.argmax(1)
    if states == 1:
        return label
    for t in range(int(lengths[0]) - 1, -1, -1):
        while active < len(lengths) and lengths[active] > t:
            active += 1
        at = starts[:active] + t
        label[at] = state[:active]
        state[:active] = np.where(stay[at, state[:active]], state[:active], jump[at])
    return label


def _part(model: Model, docs: list[list[str]]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans (first word, end, language) of texts that have words, longest first."""
    lengths = np.array(list(map(len, docs)))
    flat = [w for d in docs for w in d]
    emit = model.rows_for(flat)
    label = viterbi(emit, lengths)
    starts = np.cumsum(np.r_[0, lengths[:-1]])
    letters = np.fromiter(map(len, flat), np.int64, len(flat))
    doc = np.repeat(np.arange(len(docs)), lengths)
    n = len(model.languages)
    share = np.bincount(doc * n + label, letters, minlength=len(docs) * n).reshape(-1, n)
    share = share / share.sum(1, keepdims=True)
    total = np.add.reduceat(emit, starts).astype(float) + model.prior
    sure = np.exp(total - total.max(1, keepdims=True))
    sure /= sure.sum(1, keepdims=True)
    choice = np.argmax(share + 1e-3 * sure, 1)
    score = share[np.arange(len(docs)), choice] * (0.5 + 0.5 * sure[np.arange(len(docs)), choice])
    new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])])
    spans: list[list[tuple[int, int, str]]] = [[] for _ in docs]
    for a, b in zip(new, np.r_[new[1:], len(flat)], strict=True):
        spans[doc[a]].append((int(a - starts[doc[a]]), int(b - starts[doc[a]]), model.languages[label[a]]))
    return [(model.languages[c], float(s), p) for c, s, p in zip(choice, score, spans, strict=True)]


def identify(model: Model, texts: list[str], part: int = 200_000) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Language, score and spans of each text; UNKNOWN, 0 and none without a letter or without a learned language."""
    out: list[tuple[str, float, list[tuple[int, int, str]]]] = [(UNKNOWN, 0.0, [])] * len(texts)
    if not model.languages:
        return out
    words = list(map(words_of, texts))
    order = sorted((k for k in range(len(texts)) if words[k]), key=lambda k: -len(words[k]))
    while order:
        n, size = 0, 0
        while n < len(order) and (not n or size + len(words[order[n]]) <= part):
            size += len(words[order[n]])
            n += 1
        for k, found in zip(order[:n], _part(model, [words[k] for k in order[:n]]), strict=True):
            out[k] = found
        order = order[n:]
    return out


def learn(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, chars: int = CHARS_PER_LANGUAGE) -> Model:
    """Learns from (doc_id, text, lang) of a sample: about `per_language` documents of each language and `chars` characters, by a hash of doc_id.

    Rows with a null text or lang don't count. Texts are read once: words are counted by language, and trigrams follow
    from the counted words. All words and trigrams of the sample are kept, rare ones too; the sample bounds them.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = checkpoint(labelled.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text").cast("long")).alias("chars")))  # a row for each language
    of = {r["lang"]: r["docs"] for r in sizes.select("lang", "docs").collect()}
    languages = sorted(of)
    if not languages:
        return build([], np.zeros(0), {}, {})
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("docs"), F.lit(float(chars)) / F.greatest("chars", F.lit(1)))
    place = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id")), F.lit(1 << 30))
    chosen = labelled.join(sizes.select("lang", (share * (1 << 30)).cast("long").alias("share")), "lang").where(place < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, Counter[str]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in count.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
            count.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                count.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, count.values())) > 500_000:
                yield from flush()
        yield from flush()

    counted = chosen.select("lang", "text").mapInArrow(tidy(run), "lang string, word string, n long")
    words = checkpoint(counted.groupBy("word", "lang").agg(F.sum("n").alias("n")))
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.concat(F.lit(" "), "word", F.lit(" ")), i, F.lit(3))))
    grams = words.select("lang", "n", gram.alias("gram")).groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    place_of = {k: i for i, k in enumerate(languages)}

    def table(rows: DataFrame, item: str) -> dict[str, dict[int, float]]:
        out: dict[str, dict[int, float]] = {}
        got = rows.select(item, "lang", "n").orderBy(item, "lang").toArrow()  # of the sample: bounded by its characters
        for word, lang, n in zip(*(got.column(c).to_pylist() for c in (item, "lang", "n")), strict=True):
            out.setdefault(word, {})[place_of[lang]] = float(n)
        return out

    return build(languages, np.array([float(of[k]) for k in languages]), table(words, "word"), table(grams, "gram"))


def predicted(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of documents' (doc_id, text), and its spans of words if asked for.

    A text that is null or has no letter is UNKNOWN with score 0, and so is any if no language was learned. Rows are
    independent: repeated or null doc_ids keep their rows. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was learned from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, AT_ONCE):
            found = identify(shared.value, texts_of(batch))
            columns = [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            if spans:
                columns.append(pa.array([",".join(f"{a}:{b}:{k}" for a, b, k in x[2]) for x in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double" + ", spans string" * spans)
