"""Queries over sentence vectors: normalising, search, retrieval for an answer, the index."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import vectors as V
from tapeloom.operators import embedding, vector_index
from tapeloom.session import checkpoint, shared_folder
from tapeloom.sources import bindings as B
from tapeloom.sources import versions

from .registry import SEGMENTS, query

TOP_K = 20

HITS = r"""
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
hits AS (
  SELECT CAST(label AS VARCHAR) AS video_id, vec_id AS sentence_index, round(list_dot_product(CAST(embedding AS DOUBLE[]), q.v), 4) AS score
  FROM embeddings, q ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), q.v) DESC, vec_id LIMIT 20),
told AS (SELECT h.*, 'Passage ' || b.text AS text FROM hits h JOIN benchmark b ON b.item_id = h.sentence_index % (SELECT count(*) FROM benchmark))"""


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k vectors most like the query's (vector 0): one row meets all, and each task keeps its own k."""
    rows = B.vectors(spark, sf_dir)
    asked = rows.where("sentence_index = 0").select(F.col("embedding").alias("asked"))  # one row
    scored = rows.crossJoin(F.broadcast(asked)).select("video_id", "sentence_index", V.dot(F.col("embedding"), F.col("asked")).alias("score"))
    return scored.orderBy(F.desc("score"), "sentence_index").limit(TOP_K).select("video_id", "sentence_index", F.round("score", 4).alias("score"))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with their text: the passage of their number, from the first again after the last."""
    passages = B.table(spark, sf_dir, "benchmark")
    texts = passages.select(F.col("item_id").alias("item"), F.concat(F.lit("Passage "), "text").alias("text"))
    return _top(spark, sf_dir).join(texts, F.col("sentence_index") % max(passages.count(), 1) == F.col("item")).drop("item")


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm, round(embedding[1] / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS first FROM embeddings")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return B.table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(v), 4).alias("norm"), F.round(F.get(V.normalized(v), F.lit(0)), 4).alias("first"))


@query("WITH " + HITS + " SELECT video_id, sentence_index, score FROM hits")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir)


@query("WITH " + HITS + " SELECT video_id, sentence_index, score, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(left(text, 80)) ORDER BY score DESC, sentence_index) AS k FROM told) WHERE k = 1")
def search_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of hits whose texts begin alike, the best; after the top k, so fewer may stay."""
    order = Window.partitionBy(F.lower(F.left("text", F.lit(80)))).orderBy(F.desc("score"), "sentence_index")
    return _told(spark, sf_dir).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


@query("WITH " + HITS + r""", c AS (SELECT * FROM told WHERE video_id IN (SELECT CAST(label AS VARCHAR) FROM embeddings WHERE vec_id IN (0, 3, 5)))
SELECT string_agg('[From: Video ' || video_id || '] ' || text, chr(10) || chr(10) ORDER BY score DESC, sentence_index) AS context, arg_min(text, (-score, sentence_index)) AS answer, count(*) AS hits FROM c""")
def chat_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context for an answer: the top k, of the asked videos only, and the best hit where no model answers."""
    asked = B.vectors(spark, sf_dir).where("sentence_index in (0, 3, 5)").select("video_id").distinct()
    hits = _told(spark, sf_dir).join(asked, "video_id", "left_semi")
    line = F.struct((-F.col("score")).alias("o"), "sentence_index", F.concat(F.lit("[From: Video "), F.col("video_id"), F.lit("] "), F.col("text")).alias("line"), "text")
    one = hits.agg(F.array_sort(F.collect_list(line)).alias("l"), F.count("*").alias("hits"))
    return one.select(F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("context"), F.get("l", F.lit(0))["text"].alias("answer"), "hits")


@query("SELECT CAST(conv_id AS VARCHAR) AS video_id, count(*) AS segments FROM conversations WHERE CAST(conv_id AS VARCHAR) NOT IN (SELECT CAST(label AS VARCHAR) FROM embeddings) GROUP BY conv_id")
def index_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos that the index doesn't hold yet, with what there is to add."""
    known = B.vectors(spark, sf_dir).select("video_id").distinct()
    new = B.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("video_id")).join(known, "video_id", "left_anti")
    return new.groupBy("video_id").agg(F.count("*").alias("segments"))


@query("SELECT count(*) AS vectors, count(DISTINCT label) AS videos, string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)) AS ids FROM embeddings")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = B.vectors(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").cast("long").alias("vectors"), F.count("*").alias("videos"), F.array_join(F.array_sort(F.collect_list("video_id")), ",").alias("ids"))


INDEX_SEARCH = SEGMENTS + r""",
kept AS (SELECT 't' AS side, video_id, seg_idx AS place, text FROM seg WHERE words >= 3 UNION ALL SELECT 'q', CAST(item_id AS VARCHAR), 0, text FROM benchmark),
w AS (SELECT side, video_id, place, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS w FROM kept),
f AS (SELECT side, video_id, place, unnest(list_concat(['=' || w], list_transform(range(1, length(w) + 1), lambda i: substr('<' || w || '>', CAST(i AS INT), 3)))) AS f FROM w),
h AS (SELECT side, video_id, place, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) AS h FROM f),
v AS (SELECT side, video_id, place, h % 384 AS dim, sum(1 - 2 * (h // 384 % 2)) AS v FROM h GROUP BY ALL),
u AS (SELECT side, video_id, place, dim, CAST(v / sqrt(sum(v * v) OVER (PARTITION BY side, video_id, place)) AS DOUBLE) AS v FROM v),
s AS (SELECT CAST(q.video_id AS BIGINT) AS question, t.video_id, t.place, round(sum(q.v * CAST(t.v AS FLOAT)), 4) + 0.0 AS score FROM u q JOIN u t ON q.side = 'q' AND t.side = 't' AND q.dim = t.dim GROUP BY ALL)
SELECT question, rank, video_id, place, score FROM (SELECT question, row_number() OVER (PARTITION BY question ORDER BY score DESC, video_id, place) AS rank, video_id, CAST(place AS BIGINT) AS place, score FROM s) WHERE rank <= 10"""


@query("WITH " + INDEX_SEARCH)
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of segments by their own vectors, written in two goes (the second adds new videos only), read and searched.

    Questions are the items of the benchmark. A third version whose pointer was never written doesn't count.
    """
    folder, embedder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", embedding.HashingEmbedder(384)
    texts = B.segments(spark, sf_dir).select("video_id", F.col("seg_idx").alias("place"), "text")
    vector_index.append(texts.where("cast(video_id as bigint) % 3 = 0"), folder, embedder)
    vector_index.append(texts, folder, embedder)
    texts.limit(5).write.parquet(f"{folder}/v2")  # a write that broke off
    questions = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question"), "text")
    out = checkpoint(vector_index.search(vector_index.load(spark, folder), questions, embedder, 10))
    versions.delete(spark, folder)
    return out


@query("SELECT doc_id FROM documents WHERE contains(lower(left(text, 60)), 'the') OR contains(lower(text), 'tion of')")
def title_desc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose title (the first sixty characters) or text holds a phrase."""
    text = F.lower("text")
    found = F.contains(F.left(text, F.lit(60)), F.lit("the")) | F.contains(text, F.lit("tion of"))
    return B.table(spark, sf_dir, "documents").where(found).select("doc_id")
