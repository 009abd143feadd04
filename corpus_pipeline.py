"""The corpus pipeline: documents in, token ids out. Part of the subpackage tapeloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of their docs, whatever their names; an
empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import mixing, pieces, pii, quality, simhash
from tapeloom.llm.common import shared_folder, table
from tapeloom.llm.queries import MODEL


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranker rejects go. It learns from labels whose crc32(doc_id) mod 5 isn't 0.

    A null text scores as an empty one. Each row is judged by its text alone: repeated rows and null doc_ids count like
    others. Without labels of both kinds nothing can be told apart: all rows pass if none is labelled 0, and go if none
    is labelled 1.
    """
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return quality.accepted(docs, quality.fit_on(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (0.8 of five-word shingles in common) stays: the smallest doc_id.

    Null, empty and blank texts are copies of one another. Of rows with the same doc_id one stays; rows with a null
    doc_id stay.
    """
    return simhash.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the kind in brackets, and n_chars is recounted. Null texts stay null; no row goes."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times, so that sources come near their weights.

    A null source is a source of its own, the last one. Documents without words go, and those that aren't taken.
    """
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids) of each document that the mix holds, repeats included. Null and empty texts have no ids."""
    rows = pieces.encoded(docs, pieces.Vocabulary.load(MODEL))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("pii", redact), ("mixing", mix), ("encode", encode)]

#: SQL can't express the trained ranker, XXH64 fingerprints and the tokenizer; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; stages' results stand in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
