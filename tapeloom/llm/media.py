"""Interleaved document sequences: text and media references in the order of a page.

A page's HTML is parsed into structs (pos, kind, text, digest, caption, size): texts, and references to media by digest.
Payloads stand in a media store, a table keyed by digest; a join on the digest resolves references, and what comes of it
is put back by position, so that texts, media and captions stay aligned. The stored form of a payload is a grey PNG image
of 64 samples a row, which keeps every byte.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import shared_folder, slices, texts_of, tidy

WIDTH = 64
SCHEME = "sha256:"
# Tags whose text isn't shown, tags that break a text, and tags that refer to media.
HIDDEN = frozenset(("script", "style", "template", "noscript", "head", "nav"))
BREAKS = frozenset(("p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "br", "hr", "blockquote", "figure", "figcaption", "ul", "ol", "table", "pre", "body", "main"))
MEDIA = frozenset(("img", "audio", "video", "source", "embed"))
PNG = b"\x89PNG\r\n\x1a\n"


# ---- payloads


def payload(text: str) -> bytes:
    """UTF-8 bytes, then zeros up to a positive multiple of 64."""
    raw = text.encode("utf-8", "replace")
    return raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes) -> bytes:
    """A grey 8-bit PNG, 64 wide."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(image: bytes) -> bytes:
    """The samples of an image that encode() wrote; checks each chunk's CRC and the size."""
    if image[:8] != PNG:
        raise ValueError("not a PNG")
    at, header, data = 8, b"", []
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        header, data = (body, data) if kind == b"IHDR" else (header, [*data, body] if kind == b"IDAT" else data)
        at += 12 + n
    width, height = struct.unpack(">II", header[:8])
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered line")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a difference hash of eight by eight blocks."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    level = np.arange(256)
    mean = float(share @ level)
    spread = float(np.sqrt(share @ (level - mean) ** 2))
    full = share[share > 0]
    cuts = np.linspace(0, len(x) // WIDTH, 9).astype(int)
    sums = np.concatenate([np.zeros((1, 8)), np.cumsum(x.reshape(-1, 8, 8).sum(2, dtype=np.int64), axis=0)])
    block = sums[cuts[1:]] - sums[cuts[:-1]]
    bits = (block > np.roll(block, -1, axis=1)).ravel()
    return f"mean={mean:.3f};std={spread:.3f};entropy={float(-(full * np.log2(full)).sum()):.3f};dhash={int(np.packbits(bits).tobytes().hex(), 16):016x}"


# ---- sequences


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden, self.caption, self.figure = 0, None, None

    def close_text(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None, "size": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BREAKS:
            self.close_text()
        if tag == "figure":
            self.figure = len(self.items)
        if tag == "figcaption":
            self.caption = []
        if tag in MEDIA and not self.hidden:
            found = dict(attrs)
            if src := found.get("src"):
                self.close_text()
                size = found.get("data-size") or ""
                self.items.append({"kind": "media", "text": None, "digest": src.removeprefix(SCHEME), "caption": found.get("alt"), "size": int(size) if size.isascii() and size.isdigit() else None})

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            media = [x for x in self.items[self.figure or 0 :] if x["kind"] == "media"]
            for x in media[-1:] if self.figure is None else media:
                x["caption"] = caption
        if tag == "figure":
            self.figure = None
        if tag in BREAKS:
            self.close_text()

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        (self.text if self.caption is None else self.caption).append(data)


def sequence(html: str) -> list[dict]:
    """Texts and media references in order of the page; a figure's caption goes to its media, else the alt text does."""
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    parser.close_text()
    return parser.items


ITEM = pa.struct([("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string()), ("size", pa.int64())])


def sequences(pages: DataFrame, key: str, html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, pos, kind, text, digest, caption, size): one row per item of each page, pos from 0.

    size: what a reference says of its payload's bytes, if it does. A page that is null or has no items has one row with
    a null kind, so that it isn't lost.
    """
    kept = [key, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            items = [sequence(h or "") for h in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(items, pa.list_(ITEM))], names=[*kept, "items"])

    read = pages.select(*kept, F.col(html).alias("page's html"))
    schema = pages.select(*kept).schema.add("items", ArrayType(StructType.fromDDL("kind string, text string, digest string, caption string, size long")))
    parsed = read.mapInArrow(tidy(run), schema)
    return parsed.select(*kept, F.posexplode_outer("items").alias("pos", "item")).select(*kept, F.coalesce("pos", F.lit(0)).alias("pos"), "item.*")


def once(store: DataFrame) -> DataFrame:
    """(digest, found) of a store (digest, ...): its other columns as a struct, one for each digest, combined before the shuffle."""
    rest = F.struct(*(F.col(f"`{c}`") for c in store.columns if c != "digest"))
    return store.groupBy("digest").agg(F.first(rest).alias("found"))


def resolve(items: DataFrame, store: DataFrame) -> DataFrame:
    """`items` with the columns of `store` (digest, ...) by a join on the digest; null where the store has none.

    The store may hold a digest several times; one counts. Texts and unresolved references keep their rows; texts have
    no digest and are dealt out by a hash instead, so that they don't meet in one task.
    """
    own = [F.col(f"`{c}`") for c in items.columns]
    at = F.coalesce("digest", F.concat(F.lit("text "), F.xxhash64(*own)))
    asked = items.select(F.struct(*own).alias("item"), at.alias("at"))
    found = once(store.where(F.col("digest").isNotNull()))
    joined = asked.join(found.hint("merge"), F.col("at") == F.col("digest"), "left")
    return joined.select("item.*", "found.*")


def interleaved(resolved: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """(key, items): each page's items as an array of structs (pos, *columns) by position, once more in page order."""
    keys = [key] if isinstance(key, str) else key
    return resolved.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("items"))


# ---- documents as media


def article(doc_id: int | None, text: str, digest: str, n_bytes: int) -> str:
    """A page with the whole text, the figure of its image after the first line."""
    first, _, rest = text.partition("\n")
    lines = "".join(f"<p>{escape(x)}</p>" for x in (rest,) if x.strip())
    figure = f'<figure><img src="{SCHEME}{digest}" alt="text as samples" data-size="{n_bytes}"><figcaption>Text of document {doc_id}</figcaption></figure>'
    return f"<article><h1>Document {doc_id}</h1><p>{escape(first)}</p>{figure}{lines}</article>"


def pages_of(docs: DataFrame) -> DataFrame:
    """(doc_id, page, html) of documents' (doc_id, text): a page that refers to the text's image by the payload's digest.

    page: a digest of the page, which tells rows of the same doc_id apart if their texts differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pages = [article(doc_id, text, hashlib.sha256(payload(text)).hexdigest(), len(text.encode("utf-8", "replace"))) for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True)]
            names = [int.from_bytes(hashlib.blake2b(p.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(pages, pa.string())], names=["doc_id", "page", "html"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, page long, html string")


def stored(docs: DataFrame) -> DataFrame:
    """(digest, media) of documents' texts: a media store. A task writes the image of a text once, not for each copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in slices(batches):
            digests, media = [], []
            for text in texts_of(batch):
                raw = payload(text)
                digest = hashlib.sha256(raw)
                if digest.digest() not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(digest.digest())
                    digests.append(digest.hexdigest())
                    media.append(encode(raw))
            if media:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return docs.select("text").mapInArrow(tidy(run), "digest string, media binary")


FACTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(store: DataFrame) -> DataFrame:
    """(digest, *FACTS) of a store's (digest, media): what its stored bytes decode to. Rows stay as they are."""
    names = ["digest", *(x.split()[0] for x in FACTS.split(", "))]
    types = [pa.string(), *(pa.int64() if " long" in x else pa.string() for x in FACTS.split(", "))]

    def facts(media: bytes) -> tuple:
        raw = decode(media)
        return len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [(digest, *facts(media)) for digest, media in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return store.select("digest", "media").mapInArrow(tidy(run), f"digest string, {FACTS}")


def sampled(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, *FACTS, caption, pos, n_items, items_sha256) for each row of documents' (doc_id, text).

    Each text is stored as an image in a table of the shared folder, and stands in a page of a title, its first line, the
    image's figure and its other lines. Pages are parsed, references are joined to what the stored bytes of their digest
    decode to, and each page's items are put in order again; the result is the page's figure, and a digest of all items in
    order: of a text its own digest, of a figure the digest read back and its caption, a line each. Neither texts nor
    payloads are shuffled: texts stand in the sequence by their digests, and a row of facts for each payload meets the
    references. A null text counts as empty: 64 zero bytes. Repeated rows keep their rows; a doc_id may be null; other
    columns aren't looked at; an empty table gives an empty one.
    """
    spark, facts = docs.sparkSession, [x.split()[0] for x in FACTS.split(", ")]
    folder = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    stored(docs).write.parquet(folder)
    store = read_back(spark.read.parquet(folder))
    items = sequences(pages_of(docs), "doc_id", carry=("page",)).withColumn("text", F.sha2("text", 256))
    pages = interleaved(resolve(items, store), ["doc_id", "page"], ["kind", "text", "digest", "caption", "size", *facts])
    places = F.size(F.array_distinct(F.transform("items", lambda x: x["pos"])))
    # a repeated row's items stand beside one another: one of each place tells the page
    each = F.filter("items", lambda x, i: (i == 0) | (F.get("items", i - 1)["pos"] != x["pos"]))
    line = lambda x: F.when(x["kind"] == "media", F.concat_ws(" ", F.lit("media"), x["payload_sha256"], x["caption"])).otherwise(F.concat_ws(" ", F.lit("text"), x["text"]))
    told = F.sha2(F.array_join(F.transform(each, line), "\n"), 256)
    figures = pages.select("doc_id", F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("x"), places.alias("n_items"), told.alias("items_sha256"))
    return figures.select("doc_id", F.col("x.size").alias("n_bytes"), *(F.col(f"x.{f}").alias(f) for f in facts), "x.caption", "x.pos", "n_items", "items_sha256")
