"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into words at places that no piece of the vocabulary spans. The corpus's distinct words are exploded into
substrings of bounded length, these are joined to the piece table, and the matches (edges) are grouped by word: a word's
lattice. A fold by Spark's aggregate over the edges finds the word's pieces:

- a unigram model: Viterbi (lattice_viterbi), over edges by their end: the path of the greatest sum of scores;
- a BPE model (lattice_masks): the path that merging by priority gives. Scores of BPE pieces are merge priorities and don't add up, so
  Viterbi over their sum would not give the model's pieces. Edges come in order of priority; an edge is taken if it
  spans exactly two of the word's present pieces, whose boundary it removes. One pass is enough: unless a boundary of an
  edge was removed earlier, the merges inside it, all of higher priority, leave exactly its two parts. `Vocabulary`
  checks this for each of its pieces. Edges of equal priority come by their end, the shorter ones first.

Words meet their documents by chunks of documents: a chunk sends each of its distinct words once, and gets back a
dictionary of its words. Nothing needs the whole vocabulary of the corpus in one place. Words that are frequent in a
bounded sample go through the same lattice first and reach all tasks as a dictionary of bounded size; chunks needn't ask
for them. A word's pieces depend on the word alone, so the sample changes what is sent, not what comes out. Every word
of up to MOST_CHARS characters gets its pieces from the lattice: one that doesn't come back is an error. Tasks cut texts
and put ids together by Arrow arrays, a chunk's distinct units at once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, slices, tidy

SPACE = "▁"
#: Words: spaces, then anything up to the end of a run of letters or to the next space.
LETTERS, OTHERS = r"[^\W\d_²³¹]", rf"(?:[^\w{SPACE}]|[\d_²³¹])"
WORDS = re.compile(rf"{SPACE}*{OTHERS}*{LETTERS}+|{SPACE}*{OTHERS}+|{SPACE}+")
#: Code points of a word in the lattice: its boundaries are the bits of a long. Longer words are merged one by one.
MOST_CHARS = 61
#: Characters of text in a chunk at most, chunks per core until they are that large, and the level of their compression.
CHUNK, CHUNKS_PER_CORE, LEVEL = 8 << 20, 4, 6
#: Words of the dictionary that every task has, at most, and documents that it is drawn from, about.
COMMON_WORDS, COMMON_DOCS = 100_000, 5_000
# The model file's fields that say its type, and the types; what a unigram model takes off for unknown characters.
TRAINER, MODEL_TYPE, UNIGRAM, BPE, UNKNOWN_PENALTY = 2, 3, 1, 2, 10.0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        byte, at = data[at], at + 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message in the protocol buffers' wire format."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            n, at = _varint(data, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


def model_type(serialized: bytes) -> int:
    """UNIGRAM (also if the model doesn't say), BPE or another one."""
    trainer = b"".join(v for k, v in _fields(serialized) if k == TRAINER)
    return next((v for k, v in _fields(trainer) if k == MODEL_TYPE), UNIGRAM)


@dataclass
class Vocabulary:
    """The pieces of a model: ids of normal pieces, their priority (0 first), and the ids of the 256 bytes."""

    ids: dict[str, int]
    rank: dict[str, int]
    score: dict[str, float]
    bytes_: dict[int, int]
    unknown: int
    longest: int
    unigram: bool = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("raw", "raw_array", "pieces")}

    @cached_property
    def raw(self) -> dict[int, bytes]:
        """What an id stands for, in UTF-8; control ids aren't in it."""
        return {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes_.items()}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads a model file with the sentencepiece library, on the driver."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        normal = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        ids = {m.id_to_piece(i): i for i in normal}
        kind = model_type(m.serialized_model_proto())
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"neither a unigram nor a BPE model: type {kind}")
        score = {p: m.get_score(i) for p, i in ids.items()}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        bytes_ = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
        found = cls(ids, {p: place[s] for p, s in score.items()}, score, bytes_, m.unk_id(), max(map(len, ids)), kind == UNIGRAM)
        odd = [p for p in ids if found.words(p) != [p] or not found.unigram and found.cut(p, found.mask(p)) != [p]]
        if odd:
            raise ValueError(f"pieces that cutting into words or one pass of merges doesn't give: {odd[:5]}")
        return found

    def words(self, escaped: str) -> list[str]:
        return WORDS.findall(escaped)

    def units(self, texts: pa.Array) -> pa.ListArray:
        """Each text between its spaces: words of a unit are those of SPACE + unit. Without doubled spaces, words never span two.

        A text with spaces side by side or with a space mark of its own is one unit, less the first mark. Null and empty
        texts have none.
        """
        empty, rows = ~(pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0), np.arange(len(texts))
        texts = texts.take(pa.array(rows, pa.int64(), mask=empty))
        odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.match_substring(texts, SPACE))
        if pc.any(odd).as_py():  # by take: pyarrow's if_else reads wrong bytes of a slice of strings
            both = pa.concat_arrays([texts, pc.replace_substring(texts, " ", SPACE)])
            texts = both.take(pa.array(rows + len(rows) * odd.fill_null(False).to_numpy(zero_copy_only=False)))
        return pc.split_pattern(texts, " ")

    def unit_words(self, units: pa.Array) -> pa.ListArray:
        """words(SPACE + unit) of each unit: at once for those without a space mark, since each mark then begins a unit."""
        odd = pc.or_(pc.equal(units, ""), pc.match_substring(units, SPACE)).to_numpy(zero_copy_only=False)
        plain = units.filter(pa.array(~odd))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(plain)], pa.int32()), plain), SPACE)[0].as_py()
        words = pa.array(WORDS.findall(SPACE + joined) if len(plain) else [], pa.string())
        ends = np.append(np.flatnonzero(pc.starts_with(words, SPACE)), len(words))
        if not odd.any():
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words)
        others = [WORDS.findall(SPACE + u) for u in units.filter(pa.array(odd)).to_pylist()]
        words = pa.concat_arrays([words, pa.array([w for ws in others for w in ws], pa.string())])
        lists = pa.ListArray.from_arrays(pa.array(np.append(ends[:-1], ends[-1] + np.cumsum([0, *map(len, others)])), pa.int32()), words)
        return lists.take(pa.array(np.argsort(np.argsort(odd, kind="stable"), kind="stable")))

    @property
    def unknown_score(self) -> float:
        return min(self.score.values(), default=0.0) - UNKNOWN_PENALTY

    def best(self, word: str) -> bytearray:
        """merged() by a unigram model: Viterbi, for one word of any length."""
        n, score, unknown = len(word), self.score, self.unknown_score
        top, came = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        for s in range(n):
            for e in range(s + 1, min(n, s + self.longest) + 1):
                v = score.get(word[s:e], unknown if e == s + 1 else None)
                if v is not None and top[s] + v > top[e]:
                    top[e], came[e] = top[s] + v, s
        at, e = bytearray(n + 1), n
        at[n] = 1
        while e:
            e = came[e]
            at[e] = 1
        return at

    def merged(self, word: str) -> bytearray:
        """Boundaries 0 to len(word) of the word's pieces, 1 where there is one: the fold, for one word of any length."""
        if self.unigram:
            return self.best(word)
        n, rank = len(word), self.rank
        edges = []
        for s in range(n - 1):
            for e in range(s + 2, min(n, s + self.longest) + 1):
                r = rank.get(word[s:e])
                if r is not None:
                    edges.append((r, e, -s))
        edges.sort()
        at = bytearray(b"\1" * (n + 1))
        for _, e, s in edges:
            s = -s
            if at[s] and at[e] and sum(at[s + 1 : e]) == 1:
                at[s + 1 : e] = bytes(e - s - 1)
        return at

    def mask(self, word: str) -> int:
        return sum(1 << k for k, x in enumerate(self.merged(word)) if x)

    def cut(self, word: str, mask: int) -> list[str]:
        at = [k for k in range(len(word) + 1) if mask >> k & 1]
        return [word[a:b] for a, b in zip(at, at[1:], strict=False)]

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        """A piece that isn't in the vocabulary (one character) gives its UTF-8 bytes' ids, or the unknown id."""
        i = self.ids.get(piece)
        if i is not None:
            return (i,)
        return tuple(self.bytes_[b] for b in piece.encode("utf-8", "replace")) if self.bytes_ else (self.unknown,)

    def word_ids(self, word: str, mask: int | None = None) -> bytes:
        """The word's ids as 32-bit integers, one after another."""
        known, out = self.ids, []
        for p in self.cut(word, self.mask(word) if mask is None else mask):
            i = known.get(p)
            if i is None:
                out += self.piece_ids(p)
            else:
                out.append(i)
        return struct.pack(f"<{len(out)}i", *out)

    @cached_property
    def pieces(self) -> tuple[pa.Array, pa.ListArray]:
        """The pieces, and a list of the id of each."""
        ids = pa.array(list(self.ids.values()), pa.int32())
        return pa.array(list(self.ids), pa.string()), pa.ListArray.from_arrays(pa.array(range(len(ids) + 1), pa.int32()), ids)

    def words_ids(self, words: pa.Array, masks: np.ndarray) -> pa.ListArray:
        """word_ids() of words by their masks: all pieces, one behind another in the bytes of the words, are looked up at once."""
        words = pa.concat_arrays([words, pa.array([""], words.type)])  # of its own, also if the words are a part of an array
        ends, data = np.frombuffer(words.buffers()[1], np.int32)[: len(words)], words.buffers()[2]
        at = np.flatnonzero(np.frombuffer(data, np.uint8)[: ends[-1]] & 0xC0 != 0x80) if ends[-1] else np.empty(0, np.int64)  # where characters begin
        at = np.append(at, ends[-1])
        bits = np.unpackbits(np.ascontiguousarray(masks, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, 1:]
        word, k = np.nonzero(bits)
        cuts = np.append(0, at[np.searchsorted(at, ends[:-1])[word] + k + 1]).astype(np.int32)
        found = _looked_up(pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), data), *self.pieces, self.piece_ids)
        return _lists(found, np.append(0, np.cumsum(bits.sum(axis=1, dtype=np.int64))))

    def one_unknown(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without bytes for unknown characters, a run of these between neighbouring offsets has one id."""
        if self.bytes_:
            return ids, offsets
        again = (ids == self.unknown) & np.append(False, ids[:-1] == self.unknown)[: len(ids)]
        again[offsets[offsets < len(ids)]] = False
        return ids[~again], offsets - np.append(0, np.cumsum(again))[offsets]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; spaces for the space mark, less the first one. Control ids and unknown ones give nothing."""
        raw = self.raw
        try:
            out = b"".join(map(raw.__getitem__, ids))
        except KeyError:
            out = b"".join(raw.get(i, b"") for i in ids)
        text = out.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    @cached_property
    def raw_array(self) -> pa.Array:
        """What each id stands for by its number, in UTF-8; nothing for control ids."""
        return pa.array([self.raw.get(i, b"") for i in range(max(self.raw, default=-1) + 1)], pa.large_binary())

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """decode() of the ids between neighbouring offsets: what ids stand for is put together for all at once."""
        if not len(ids):
            return [""] * (len(offsets) - 1)
        if int(ids.max()) >= len(self.raw_array) or int(ids.min()) < 0:
            return [self.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
        took = self.raw_array.take(pa.array(ids))
        ends, data = np.frombuffer(took.buffers()[1], np.int64)[offsets], memoryview(took.buffers()[2])
        texts = (str(data[a:b], "utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False))
        return [t[1:] if t[:1] == " " else t for t in texts]

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, rank, id, score) of the pieces, a row each: bounded by the model's size."""
        return spark.createDataFrame([(p, self.rank[p], i, float(self.score[p])) for p, i in self.ids.items()], "piece string, rank long, id int, score double")


# ---- the lattice


def substrings(words: DataFrame, longest: int, shortest: int) -> DataFrame:
    """(word, s, e, sub): the substrings of `shortest` to `longest` characters of each word."""
    n = F.length("word")
    starts = words.where(n >= shortest).select("word", F.explode(F.sequence(F.lit(0), n - shortest)).alias("s"))
    ends = starts.select("word", "s", F.explode(F.sequence(F.col("s") + shortest, F.least(F.col("s") + longest, n))).alias("e"))
    return ends.select("word", "s", "e", F.substring("word", F.col("s") + 1, F.col("e") - F.col("s")).alias("sub"))


def lattice_masks(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, mask) of distinct words that have edges: the boundaries of a BPE model's pieces, bit k before character k."""
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
    edges = substrings(words, longest, 2)
    packed = F.shiftleft(F.col("rank"), 12) + F.col("e") * 64 + (63 - F.col("s"))
    matched = edges.join(F.broadcast(pieces.select("piece", "rank")), F.col("sub") == F.col("piece")).select("word", packed.alias("edge"))
    grouped = matched.groupBy("word").agg(F.array_sort(F.collect_list("edge")).alias("edges"))

    def take(mask: Column, edge: Column) -> Column:
        s, e = 63 - edge.bitwiseAND(F.lit(63)), F.shiftright(edge, 6).bitwiseAND(F.lit(63))
        inner = mask.bitwiseAND(one(e) - one(s + 1))
        ends = one(s) + one(e)
        return F.when((mask.bitwiseAND(ends) == ends) & (F.bit_count(inner) == 1), mask - inner).otherwise(mask)

    return grouped.select("word", F.aggregate("edges", one(F.length("word") + 1) - 1, take).alias("mask"))


def lattice_viterbi(words: DataFrame, pieces: DataFrame, longest: int, unknown: float = -100.0) -> DataFrame:
    """(word, pieces, mask) of distinct words by a unigram model: the path of the greatest sum of scores, and its boundaries.

    A character that is no piece is an edge of score `unknown`. Of equal sums, the path whose last piece is longest
    counts. The fold's state holds the best sum and path for each end so far.
    """
    edges = substrings(words, longest, 1)
    matched = edges.join(F.broadcast(pieces.select("piece", "score")), F.col("sub") == F.col("piece"), "left").where("piece is not null or e = s + 1")
    edge = F.struct("e", "s", F.coalesce("score", F.lit(unknown)).alias("score"), "sub")
    grouped = matched.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    zero = F.array(F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("path")))

    def step(state: Column, x: Column) -> Column:
        before = F.get(state, x["s"])
        new = F.struct((before["sum"] + x["score"]).alias("sum"), F.concat(before["path"], F.array(x["sub"])).alias("path"))
        first = F.size(state) <= x["e"]
        better = new["sum"] > F.get(state, x["e"])["sum"]
        return F.when(first, F.concat(state, F.array(new))).when(better, F.concat(F.slice(state, 1, x["e"]), F.array(new))).otherwise(state)

    paths = grouped.select("word", F.aggregate("edges", zero, step, lambda a: F.element_at(a, -1)["path"]).alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.lit(1).cast("long").alias("mask"))
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
    ends = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), (a["mask"] + one(a["at"] + F.length(p))).alias("mask"))
    return paths.select("word", "pieces", F.aggregate("pieces", start, ends, lambda a: a["mask"]).alias("mask"))


def lattice(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, mask) of distinct words by the model's own rule. A BPE model's words without edges have no row."""
    table = vocabulary.table(words.sparkSession)
    if vocabulary.unigram:
        return lattice_viterbi(words, table, vocabulary.longest, vocabulary.unknown_score).select("word", "mask")
    return lattice_masks(words, table, vocabulary.longest)


# ---- documents


def _packed(ids: list[int | None], texts: list[str | None]) -> bytes:
    return _compressed(pa.table([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"]))


def _compressed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> list[pa.Array]:
    return [c.combine_chunks() for c in pa.ipc.open_stream(blob).read_all().columns]


def _lists(lists: pa.ListArray, offsets: np.ndarray) -> pa.ListArray:
    """The lists between neighbouring offsets, as one list."""
    return pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[offsets], pa.int32()), lists.values)


def _looked_up(keys: pa.Array, known: pa.Array, lists: pa.ListArray, other: Callable[[str], Sequence[int]]) -> pa.ListArray:
    """The list of each key: of those that are known theirs, and what `other` gives for the rest, each once."""
    at = pc.index_in(keys, value_set=known)
    if at.null_count:
        rest = keys.filter(pc.is_null(at)).unique()
        lists = pa.concat_arrays([lists, pa.array(map(other, rest.to_pylist()), lists.type)])
        at = pc.coalesce(at, pc.add(pc.index_in(keys, value_set=rest), pa.scalar(len(known), pa.int32())))
    return lists.take(at)


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, blob): documents' (doc_id, text) by chunks of about `size` bytes of text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0

        def out(ids: list, texts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), pa.array([_packed(ids, texts)], pa.binary())], names=["chunk", "blob"])

        ids, texts, held = [], [], 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                held += len(text or "") + 16
                if held >= size:
                    yield out(ids, texts)
                    ids, texts, held, n = [], [], 0, n + 1
        if ids:
            yield out(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "chunk long, blob binary").repartition("chunk")


def _in_lattice(words: pa.Array) -> pa.Array:
    n = pc.utf8_length(words)
    return pc.and_(pc.greater(n, 1), pc.less_equal(n, MOST_CHARS))


def common_words(docs: DataFrame, vocabulary: Vocabulary, most: int = COMMON_WORDS, sample: int = COMMON_DOCS) -> dict[str, bytes]:
    """Ids of the words that occur most in about `sample` documents, by the lattice: `most` words at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            units, n = vocabulary.units(batch.column(0)).flatten().value_counts().flatten()
            words = vocabulary.unit_words(units)
            rows = pa.table([words.flatten(), n.take(pc.list_parent_indices(words))], names=["word", "n"])
            rows = rows.filter(_in_lattice(rows["word"])).group_by("word", use_threads=False).aggregate([("n", "sum")])
            yield from rows.rename_columns({"n_sum": "n"}).select(["word", "n"]).to_batches()

    few = bounded_sample(docs.select("doc_id", "text").where("doc_id is not null and text is not null"), "doc_id", sample)
    words = few.select("text").mapInArrow(tidy(counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    top = words.orderBy(F.desc("n"), "word").limit(most).select("word")
    masks = lattice(top, vocabulary).collect()
    return {r["word"]: vocabulary.word_ids(r["word"], r["mask"]) for r in masks}


def encoded(docs: DataFrame, vocabulary: Vocabulary, decode: bool = False) -> DataFrame:
    """(doc_id, ids) of documents' (doc_id, text), and with `decode` the text read back, as the column decoded.

    The ids are those of the model's own encoder with its dummy prefix. A null or empty text has no ids. Repeated rows
    keep their rows. An empty table gives an empty one; other columns aren't looked at. Words of over MOST_CHARS
    characters are merged one by one, by the same rule.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)  # the model's pieces: bounded
    common = spark.sparkContext.broadcast(common_words(docs, vocabulary))  # COMMON_WORDS at most
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    packed = chunks(docs, max(1 << 18, min(CHUNK, chars // (CHUNKS_PER_CORE * spark.sparkContext.defaultParallelism))))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, usual = shared.value, pa.array(list(common.value), pa.string())
        for batch in batches:
            for chunk, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = v.unit_words(v.units(_unpacked(blob)[1]).flatten().unique()).flatten().unique()
                words = words.filter(pc.and_(_in_lattice(words), pc.invert(pc.is_in(words, value_set=usual))))
                words = words.take(pc.sort_indices(words))  # neighbours share beginnings: the exchange compresses better
                for i in range(0, len(words), 50_000):
                    part = words[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([part, pa.array(np.full(len(part), chunk))], names=["word", "chunk"])

    # this and the join below read one exchange: both use both columns, and what the optimizer infers of words stands here
    asked = packed.mapInArrow(tidy(distinct_words), "word string, chunk long").where("word is not null and length(word) >= 2").repartition("word")
    once = asked.groupBy("word").agg(F.min("chunk").alias("first")).where("first >= 0").select("word")
    found = lattice(once, vocabulary)

    def dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            rows = _with_ids(pa.Table.from_batches(held), shared.value).sort_by("chunk").combine_chunks()
            ends = np.flatnonzero(np.diff(rows["chunk"].to_numpy(), append=-1)) + 1
            at = 0
            for end in ends:
                part = rows.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([pa.array([part["chunk"][0].as_py()]), pa.array([_compressed(part.select(["word", "ids"]))], pa.binary())], names=["chunk", "words"])
                at = end

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 250_000:
                yield from out()
                held.clear()
        if held:
            yield from out()

    known = asked.join(found, "word", "left").select("chunk", "word", "mask")  # both lie by word: masks need no exchange, as ids from Python would
    by_chunk = known.mapInArrow(tidy(dictionaries), "chunk long, words binary").groupBy("chunk").agg(F.collect_list("words").alias("words"))
    kind = "doc_id long, ids array<int>" + ", decoded string" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, ids_of = shared.value, _Units(shared.value, common.value)
        for batch in batches:
            for k in range(batch.num_rows):
                blob, parts = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or []
                ids_of.renew(parts)
                doc_ids, texts = _unpacked(blob)
                units = v.units(texts)
                coded = units.flatten().dictionary_encode()
                ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(units), 0)))
                del blob, parts, texts, units
                found = ids_of.of(coded.dictionary)
                for i in range(0, len(doc_ids), 500):
                    at = ends[i : i + 501]
                    some = found.take(coded.indices[at[0] : at[-1]])
                    ids, offsets = v.one_unknown(some.values.to_numpy(), some.offsets.to_numpy()[at - at[0]])
                    columns = [doc_ids[i : i + 500], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))]
                    if decode:
                        columns.append(pa.array(v.decode_all(ids, offsets), pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    return packed.join(by_chunk, "chunk", "left").select("blob", "words").mapInArrow(tidy(run), kind)


class _Units:
    """Units' ids, put together from those of their words; single characters and words of over MOST_CHARS are merged here."""

    def __init__(self, vocabulary: Vocabulary, common: dict[str, bytes]) -> None:
        ids, offsets = np.frombuffer(b"".join(common.values()), "<i4"), np.cumsum([0, *(len(x) // 4 for x in common.values())])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        self.vocabulary, self.common = vocabulary, pa.table([pa.array(list(common), pa.string()), lists], names=["word", "ids"])
        self.renew([])

    def renew(self, parts: list[bytes]) -> None:
        """For another chunk: its words are other ones."""
        self.words = self.ids = None
        pa.default_memory_pool().release_unused()
        table = pa.concat_tables([self.common, *(pa.ipc.open_stream(p).read_all() for p in parts)])
        self.words, self.ids = (c.combine_chunks() for c in table.columns)

    def of(self, units: pa.Array) -> pa.ListArray:
        """A list for each of the units."""
        words = self.vocabulary.unit_words(units)
        return _lists(_looked_up(words.values, self.words, self.ids, self._other), words.offsets.to_numpy())

    def _other(self, word: str) -> np.ndarray:
        if 1 < len(word) <= MOST_CHARS:
            raise LookupError(f"a word that the lattice didn't return: {word!r}")
        return np.frombuffer(self.vocabulary.word_ids(word), "<i4")

    def __getitem__(self, unit: str) -> bytes:
        return self.of(pa.array([unit], pa.string())).values.to_numpy().tobytes()


def _with_ids(rows: pa.Table, vocabulary: Vocabulary) -> pa.Table:
    """(chunk, word, ids) of (chunk, word, mask), each word once. One that the lattice has no edges for is one of single characters."""
    words = rows.column(1).combine_chunks().dictionary_encode()
    first = np.unique(words.indices.to_numpy(), return_index=True)[1]
    singly = pa.array(np.left_shift(2, pc.utf8_length(words.dictionary).to_numpy().astype(np.int64)) - 1)
    masks = pc.coalesce(rows.column(2).combine_chunks().take(pa.array(first)), singly)
    ids = pa.chunked_array([vocabulary.words_ids(words.dictionary[i : i + 20_000], masks[i : i + 20_000].to_numpy()) for i in range(0, len(masks), 20_000)])
    return pa.table([rows.column(0), rows.column(1), ids.combine_chunks().take(words.indices)], names=["chunk", "word", "ids"])


def decoded(rows: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """(key, text) of (key, ids). Null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if r is None else shared.value.decode(r) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return rows.select(key, "ids").mapInArrow(tidy(run), rows.select(key).schema.add("text", "string"))
