"""The registered queries of this subpackage: one opN_<name> for each operator, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, digest, langid, media, mixing, pieces, pii, quality, simhash, tokencount, trie, urlfilter
from .common import table


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, fetched): pages have no date, so one within 2023 to 2025 stands for it, by page_id."""
    day = F.date_add(F.lit("2023-01-01").cast("date"), ((F.col("page_id") * 7919) % 1095).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))


def block_list(pages: DataFrame) -> DataFrame:
    """(domain, category, day, action): a dated list over the pages' own domains; what is listed when follows from a hash."""
    names = pages.select(F.explode(urlfilter.domains(urlfilter.host(F.col("url")))).alias("domain")).where("domain is not null").distinct()
    part = lambda a, n: F.conv(F.substring(F.md5("domain"), a, n), 16, 10).cast("int")
    dealt = names.select("domain", part(1, 2).alias("v"), (part(3, 3) % 700).alias("d")).where("v < 128")
    category = F.element_at(F.array(*map(F.lit, ("adult", "gambling", "malware", "spam"))), F.col("v") % 4 + 1)
    steps = F.array(F.struct(F.lit(0).alias("after"), F.lit("add").alias("action")), F.struct(F.lit(90).alias("after"), F.lit("remove").alias("action")), F.struct(F.lit(200).alias("after"), F.lit("add").alias("action")))
    used = F.slice(steps, 1, F.when(F.col("v") % 9 == 0, 3).when(F.col("v") % 3 == 0, 2).otherwise(1))
    rows = dealt.select("domain", category.alias("category"), "d", F.explode(used).alias("s"))
    return rows.select("domain", "category", F.date_add(F.lit("2023-01-01").cast("date"), F.col("d") + F.col("s.after")).alias("day"), "s.action")


def op1_url_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of pages held against a dated block list as it was when they were fetched; a row for each page."""
    seen = captures(spark, sf_dir)
    return urlfilter.filtered(seen, block_list(seen))


def op2_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, and its spans of words by language; learned from documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.learn(docs.where(~held_out).select("doc_id", "text", "lang"))
    return langid.predicted(docs, model, spans=True).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "spans")


def op3_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and spans; a null text has none."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op4_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored image in a page of texts and a figure, and what the stored bytes decode to."""
    return media.sampled(table(spark, sf_dir, "documents"))


def op5_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest, that of its edited text, and the group of equal texts; a null text counts as empty."""
    return digest.compared(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of all sources by weights 1, 2, 3 takes of every document; a null source is the last one."""
    return mixing.mixed(table(spark, sf_dir, "documents"), weights=(1.0, 2.0, 3.0))


def op7_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a ranking learned from labels that aren't held out; a null text scores as an empty one."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    ranker = quality.fit_on(docs, labels.where(~held_out))
    return quality.scored(docs, ranker).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


#: A SentencePiece model file; the environment's public tokenizers unless another is named.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op8_pieces_lattice(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document's piece ids by the model, and a digest of the text read back from them; a null text has none."""
    rows = pieces.encoded(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(model), decode=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and the smallest doc_id that it is linked to by fingerprints of 4 or fewer differing bits."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, seed=42, distance=4)
    return rows.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_chat_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and read back; -1 is one whose texts hold control strings."""
    planted = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", planted), (-1, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    return chat.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each opened by the first turns of its group of 20; a row for each distinct prefix.

    Nulls, ties, repeated rows and empty tables: see `trie.prefixes`.
    """
    return trie.prefixes(table(spark, sf_dir, "conversations"), every=20)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language by all documents; counts of at least 100, 2 to 5 words.

    Nulls, ties, repeated rows and empty tables: see `collocations.scored`.
    """
    return collocations.scored(table(spark, sf_dir, "documents"), least=100, longest=5, most=2000)


#: A tokenizers file; the environment's public tokenizers unless another is named.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def op13_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """How many tokens every document has, and whether that is over 2048; a null or empty text has none."""
    return tokencount.counted(table(spark, sf_dir, "documents"), Path(tokenizer).read_text(encoding="utf-8"), limit=2048)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}
