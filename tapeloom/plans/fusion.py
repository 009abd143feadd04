"""Queries over sentences of several videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import text as T
from tapeloom.operators import embedding, folds, fusion, profiles
from tapeloom.session import checkpoint
from tapeloom.sources import bindings as B

from .registry import query

THRESHOLD = 0.25

#: Dimensions of statements' vectors; words that a narrative aims at.
DIMENSIONS, TARGET = 128, 120

SENT = rf"""
said AS (SELECT conv_id, string_split_regex(string_agg(text, ' ' ORDER BY turn), '[.!?]+') AS l FROM conversations GROUP BY conv_id),
parts AS (SELECT conv_id, i, regexp_replace(l[i + 1], '^\s+|\s+$', '', 'g') AS raw FROM (SELECT conv_id, l, unnest(range(len(l))) AS i FROM said)),
st AS (SELECT conv_id // 5 AS job, CAST(conv_id AS VARCHAR) AS video_id, conv_id * 100000 + i AS pos, CASE WHEN conv_id % 3 = 0 AND i % 4 = 0 THEN 'However, this was never so, but wrong: ' || raw ELSE raw END AS text FROM parts),
band AS (SELECT * FROM st WHERE len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) BETWEEN 5 AND 100),
topic AS (SELECT job, k, l[k + 1] AS text FROM (SELECT item_id AS job, l, unnest(range(len(l))) AS k FROM (SELECT item_id, string_split(regexp_replace(text, '([.!?]) +', concat('\1', chr(1)), 'g'), chr(1)) AS l FROM benchmark))),
word AS (SELECT pos, -1 AS job, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS w FROM band UNION ALL SELECT k, job, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) FROM topic),
feature AS (SELECT pos, job, unnest(list_concat(['=' || w], list_transform(range(1, length(w) + 1), lambda i: substr('<' || w || '>', CAST(i AS INT), 3)))) AS f FROM word),
hashed AS (SELECT pos, job, CAST('0x' || substr(md5(f), 1, 8) AS BIGINT) AS h FROM feature),
part AS (SELECT pos, job, h % {DIMENSIONS} AS dim, sum(1 - 2 * (h // {DIMENSIONS} % 2)) AS v FROM hashed GROUP BY ALL),
long AS (SELECT pos, job, greatest(sqrt(sum(v * v)), 1e-9) AS r FROM part GROUP BY ALL),
dense AS (SELECT pos, list_transform(range({DIMENSIONS}), lambda d: CAST(CAST(coalesce(m[d], 0) / r AS FLOAT) AS DOUBLE)) AS v FROM (SELECT pos, map(list(dim), list(v)) AS m FROM part WHERE job < 0 GROUP BY pos) JOIN (SELECT pos, r FROM long WHERE job < 0) USING (pos)),
dots AS (SELECT b.pos, t.pos AS k, sum(p.v * t.v) AS d FROM band b JOIN part p ON p.pos = b.pos AND p.job < 0 JOIN part t ON t.job = b.job AND t.dim = p.dim GROUP BY ALL),
near AS (
  SELECT b.pos, t.k, row_number() OVER (PARTITION BY b.pos ORDER BY round(coalesce(d / (x.r * y.r), 0), 9) DESC, t.k) AS n
  FROM band b JOIN topic t ON t.job = b.job LEFT JOIN dots ON dots.pos = b.pos AND dots.k = t.k LEFT JOIN long x ON x.pos = b.pos AND x.job < 0 LEFT JOIN long y ON y.pos = t.k AND y.job = t.job),
sent AS (
  SELECT b.job * 1000 + coalesce(n.k, 0) AS cluster, b.job, b.video_id, b.pos, b.text, coalesce(v, list_transform(range({DIMENSIONS}), lambda d: CAST(0 AS DOUBLE))) AS v
  FROM band b LEFT JOIN (SELECT pos, k FROM near WHERE n = 1) n ON n.pos = b.pos LEFT JOIN dense e ON e.pos = b.pos),
mean AS (SELECT cluster, list(m ORDER BY dim) AS c FROM (SELECT cluster, dim, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, unnest(range(len(v))) AS dim FROM sent) GROUP BY 1, 2) GROUP BY 1),
rep AS (SELECT cluster, pos FROM (SELECT s.cluster, s.pos, row_number() OVER (PARTITION BY s.cluster ORDER BY round(list_distance(s.v, m.c), 9), s.pos) AS k FROM sent s JOIN mean m USING (cluster)) WHERE k = 1),
stat AS (SELECT cluster, count(*) AS sentences, count(DISTINCT video_id) AS videos, count(*) * count(DISTINCT video_id) AS importance, min(pos) AS first_pos FROM sent GROUP BY 1)"""
KEPT = r""",
o AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pos) AS i FROM sent),
walk AS (
  SELECT cluster, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS pos, false AS keep, CAST([] AS DOUBLE[][]) AS have FROM (SELECT DISTINCT cluster FROM o)
  UNION ALL
  SELECT x.cluster, x.i, x.pos, x.ok, CASE WHEN x.ok THEN list_append(x.have, x.v) ELSE x.have END
  FROM (SELECT o.*, w.have, len(list_filter(w.have, lambda k: list_dot_product(k, o.v) >= 0.25)) = 0 AS ok FROM walk w JOIN o ON o.cluster = w.cluster AND o.i = w.i + 1) x),
kept AS (SELECT cluster, pos FROM walk WHERE keep)"""


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, job, video_id, pos, text, embedding): all statements of 5 to 100 words of the videos of each job, kept once.

    Five conversations are a job. A statement's topic is the sentence of its job's summary that its own vector is most
    like (the first without a summary). Every fourth statement of every third video is put as an objection: the texts
    hold none.
    """
    by = B.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    told = by.select("conv_id", F.posexplode(T.statements(F.array_join(F.transform("t", lambda x: x["text"]), " "))).alias("i", "raw"))
    raw = F.regexp_replace("raw", r"^\s+|\s+$", "")
    text = F.when((F.col("conv_id") % 3 == 0) & (F.col("i") % 4 == 0), F.concat(F.lit("However, this was never so, but wrong: "), raw)).otherwise(raw)
    rows = told.select(F.expr("conv_id div 5").alias("job"), F.col("conv_id").cast("string").alias("video_id"), (F.col("conv_id") * 100_000 + F.col("i")).alias("pos"), text.alias("text"))
    summaries = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("job"), T.sentences_at_spaces(F.col("text")).alias("sentences"))
    near = embedding.likeness(rows.where(T.word_count(F.col("text")).between(5, 100)), "job", summaries, embedding.HashingEmbedder(DIMENSIONS), nearest=True)
    return checkpoint(near.select((F.col("job") * 1000 + F.coalesce("nearest", F.lit(0))).alias("cluster"), "job", "video_id", "pos", "text", "embedding"))


@query("WITH " + SENT + r""" SELECT s.cluster, sentences, videos, importance, first_pos, array_to_string((list_filter(string_split_regex(r.text, '\s+'), lambda x: x <> ''))[1:5], ' ') || '...' AS label
FROM stat s JOIN rep USING (cluster) JOIN sent r ON r.cluster = rep.cluster AND r.pos = rep.pos""")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir)
    named = rows.join(fusion.representatives(rows), ["cluster", "pos"]).select("cluster", T.topic_label(F.col("text")).alias("label"))
    return fusion.stats(rows).join(named, "cluster").select("cluster", "sentences", "videos", "importance", "first_pos", "label")


@query("SELECT label AS cluster, CAST(dim AS INT) AS dim, round(avg(x), 6) AS value FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY 1, 2")
def cluster_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), "embedding")
    return fusion.centroids(rows).select("cluster", "dim", F.round("value", 6).alias("value"))


@query("WITH " + SENT + " SELECT cluster, pos FROM rep")
def cluster_representative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.representatives(_sentences(spark, sf_dir))


@query("WITH RECURSIVE " + SENT + KEPT + " SELECT cluster, pos FROM kept")
def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster's sentences that are unlike all kept before, at 0.25."""
    return folds.leaders(_sentences(spark, sf_dir), "cluster", F.col("pos"), THRESHOLD)


@query("WITH RECURSIVE " + SENT + KEPT.replace("0.25", "0.82") + " SELECT cluster, pos FROM kept")
def semantic_dedup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same at the usual threshold of 0.82."""
    return folds.leaders(_sentences(spark, sf_dir), "cluster", F.col("pos"), 0.82)


@query("WITH " + SENT + r""", named AS (SELECT s.cluster // 1000 AS job, importance, first_pos, array_to_string((list_filter(string_split_regex(r.text, '\s+'), lambda x: x <> ''))[1:5], ' ') || '...' AS label
  FROM stat s JOIN rep USING (cluster) JOIN sent r ON r.cluster = rep.cluster AND r.pos = rep.pos)
SELECT job, array_to_string(list(label ORDER BY importance DESC, first_pos)[1:10], ' | ') AS topics FROM named GROUP BY job""")
def topic_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's topics: the labels of its first ten clusters by importance."""
    rows = cluster_stats(spark, sf_dir).select(F.expr("cluster div 1000").alias("job"), F.struct((-F.col("importance")).alias("o"), "first_pos", "label").alias("c"))
    found = rows.groupBy("job").agg(F.slice(F.array_sort(F.collect_list("c")), 1, 10).alias("c"))
    return found.select("job", F.array_join(F.transform("c", lambda x: x["label"]), " | ").alias("topics"))


STATEMENTS = r"""
st AS (SELECT CAST(doc_id // 20 AS BIGINT) AS cluster, CAST(doc_id % 4 AS VARCHAR) AS video_id, doc_id AS pos, text FROM documents)"""


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, video_id, pos, text): twenty documents a cluster, from four videos."""
    d = B.table(spark, sf_dir, "documents")
    return d.select(F.expr("doc_id div 20").alias("cluster"), (F.col("doc_id") % 4).cast("string").alias("video_id"), F.col("doc_id").alias("pos"), "text")


def _indicators(words: tuple[str, ...]) -> str:
    return " + ".join(f"max(CAST(contains(lower(text), '{w}') AS INT))" for w in words)


OPINIONS = r"""
op AS (SELECT CAST(doc_id // 4 AS BIGINT) AS cluster, CAST(doc_id % 4 AS VARCHAR) AS video_id, doc_id AS pos,
  CASE WHEN doc_id % 3 = 0 THEN 'However, this was never so, but wrong: ' || text ELSE text END AS text FROM documents)"""


@query("WITH " + OPINIONS + f""", c AS (
  SELECT cluster, video_id, {_indicators(fusion.AGAINST)} AS a, {_indicators(fusion.FOR)} AS f, arg_min(text, pos) AS first FROM op GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN a > f THEN 'disagrees/negative' ELSE 'agrees/positive' END AS stance FROM c)
SELECT cluster, count(*) AS videos, string_agg(video_id || '=' || stance || ': ' || left(first, 100) || '...', chr(10) ORDER BY video_id) AS positions
FROM s GROUP BY cluster HAVING count(DISTINCT stance) > 1 AND count(*) > 1""")
def conflict_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four documents a cluster, every third of which is put as an objection: the texts hold none."""
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.concat(F.lit("However, this was never so, but wrong: "), "text")).otherwise(F.col("text"))
    rows = B.table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("cluster"), (k % 4).cast("string").alias("video_id"), k.alias("pos"), text.alias("text"))
    found = fusion.conflicts(rows)
    written = F.array_join(F.transform(F.map_entries("positions"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n")
    return found.select("cluster", "videos", written.alias("positions"))


@query("WITH " + STATEMENTS + r""", k AS (SELECT *, row_number() OVER (PARTITION BY cluster, video_id ORDER BY pos) AS k FROM st),
v AS (SELECT cluster, video_id, min(pos) AS first_pos, left(string_agg(text, ' ' ORDER BY pos), 512) AS text FROM k WHERE k <= 2 GROUP BY 1, 2)
SELECT a.cluster, a.video_id AS video_a, b.video_id AS video_b, a.text AS text_a, b.text AS text_b FROM v a JOIN v b ON a.cluster = b.cluster AND a.first_pos < b.first_pos""")
def conflict_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.pairs(_statements(spark, sf_dir))


PARAGRAPHS = r""",
rest AS (SELECT s.cluster, s.pos, s.text, row_number() OVER (PARTITION BY s.cluster ORDER BY s.pos) AS k FROM sent s JOIN kept USING (cluster, pos)),
para AS (
  SELECT t.cluster, t.importance, t.first_pos, t.videos, r.text || coalesce('. ' || (SELECT string_agg(x.text, '. ' ORDER BY x.pos) FROM rest x WHERE x.cluster = t.cluster AND x.k BETWEEN 2 AND 5 AND x.text <> r.text), '') AS body
  FROM stat t JOIN rep USING (cluster) JOIN sent r ON r.cluster = rep.cluster AND r.pos = rep.pos),
told AS (SELECT cluster, importance, first_pos, CASE WHEN videos > 1 THEN body || ' (discussed in ' || videos || ' videos)' ELSE body END AS text FROM para)"""


def _paragraphs(rows: DataFrame, kept: DataFrame) -> DataFrame:
    return fusion.paragraphs(rows.drop("embedding", "job"), kept, fusion.representatives(rows))


@query("WITH RECURSIVE " + SENT + KEPT + PARAGRAPHS + r""" SELECT cluster, importance, first_pos, text, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS words FROM told""")
def cluster_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir)
    return _paragraphs(rows, folds.leaders(rows, "cluster", F.col("pos"), THRESHOLD))


PHRASES = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in profiles.TRANSITIONS) + "]"


@query("WITH RECURSIVE " + SENT + KEPT + PARAGRAPHS + rf""",
p AS (SELECT cluster // 1000 AS job, text, row_number() OVER (PARTITION BY cluster // 1000 ORDER BY importance DESC, first_pos) - 1 AS i FROM told),
q AS (SELECT job, i, CASE WHEN i > 0 THEN ({PHRASES})[(i - 1) % 8 + 1] || ' ' || text ELSE text END AS text FROM p),
z AS (SELECT *, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM q),
fit AS (
  SELECT job, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS words, CAST(NULL AS VARCHAR) AS text, false AS ok FROM (SELECT DISTINCT job FROM z)
  UNION ALL
  SELECT x.job, x.i, CASE WHEN x.take THEN x.words + x.n ELSE x.words END, x.text, x.take
  FROM (SELECT z.*, f.words, f.words < {TARGET} AND f.words + z.n <= {TARGET} * 1.1 AS take FROM fit f JOIN z ON z.job = f.job AND z.i = f.i + 1) x),
n AS (SELECT job, max(words) AS words, string_agg(text, chr(10) || chr(10) ORDER BY i) FILTER (WHERE ok) AS text FROM fit GROUP BY job),
stance AS (
  SELECT s.cluster, s.video_id, {_indicators(fusion.AGAINST)} > {_indicators(fusion.FOR)} AS against FROM sent s JOIN kept USING (cluster, pos) GROUP BY 1, 2),
quarrel AS (
  SELECT t.cluster // 1000 AS job, array_to_string((list_filter(string_split_regex(r.text, '\s+'), lambda x: x <> ''))[1:5], ' ') || '...' AS topic, row_number() OVER (PARTITION BY t.cluster // 1000 ORDER BY importance DESC, first_pos) AS k
  FROM stat t JOIN (SELECT cluster FROM stance GROUP BY 1 HAVING count(DISTINCT against) > 1) c USING (cluster) JOIN rep USING (cluster) JOIN sent r ON r.cluster = rep.cluster AND r.pos = rep.pos),
note AS (SELECT job, 'Note: Some sources had differing perspectives: ' || string_agg('- On ' || chr(39) || topic || chr(39) || ': sources presented varying viewpoints', ' ' ORDER BY k) AS note FROM quarrel WHERE k <= 3 GROUP BY job)
SELECT n.job, n.words, CASE WHEN note IS NOT NULL AND n.words < {TARGET} THEN concat_ws(chr(10) || chr(10), nullif(n.text, ''), note) ELSE coalesce(n.text, '') END AS text FROM n LEFT JOIN note USING (job)""")
def narrative_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's topics as a narrative of about 120 words, with a note on topics of which its videos think differently."""
    rows = _sentences(spark, sf_dir)
    kept = checkpoint(folds.leaders(rows, "cluster", F.col("pos"), THRESHOLD))
    told = _paragraphs(rows, kept).withColumn("job", F.expr("cluster div 1000"))
    quarrels = fusion.conflicts(rows.join(kept, ["cluster", "pos"], "left_semi")).select("cluster")
    named = rows.join(fusion.representatives(rows), ["cluster", "pos"]).select("cluster", T.topic_label(F.col("text")).alias("topic"))
    ranked = fusion.stats(rows).join(quarrels, "cluster", "left_semi").join(named, "cluster")
    topics = ranked.select(F.expr("cluster div 1000").alias("job"), "topic", F.row_number().over(Window.partitionBy(F.expr("cluster div 1000")).orderBy(F.desc("importance"), "first_pos")).alias("pos"))
    return fusion.narrative(told, "job", TARGET, profiles.TRANSITIONS, topics)


@query("WITH RECURSIVE " + SENT + KEPT + r""",
c AS (SELECT cluster, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS BIGINT) AS w, (cluster, pos) IN (SELECT (cluster, pos) FROM kept) AS k FROM sent)
SELECT cluster, CAST(sum(w) AS BIGINT) AS source_words, CAST(sum(CASE WHEN k THEN w ELSE 0 END) AS BIGINT) AS output_words,
       round(sum(CASE WHEN k THEN w ELSE 0 END) / greatest(sum(w), 1), 6) AS compression_ratio, round(count(CASE WHEN k THEN 1 END) / greatest(count(*), 1), 6) AS dedup_ratio FROM c GROUP BY cluster""")
def fusion_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir)
    kept = folds.leaders(rows, "cluster", F.col("pos"), THRESHOLD).withColumn("k", F.lit(True))
    sized = rows.join(kept, ["cluster", "pos"], "left").select("cluster", "k", T.word_count(F.col("text")).cast("long").alias("w"))
    sums = sized.groupBy("cluster").agg(F.sum("w").alias("source_words"), F.sum(F.when(F.col("k"), F.col("w")).otherwise(0)).alias("output_words"), F.count("k").alias("kept"), F.count("*").alias("total"))
    compression, dedup = fusion.ratios(F.col("source_words"), F.col("output_words"), F.col("kept"), F.col("total"))
    return sums.select("cluster", "source_words", "output_words", compression.alias("compression_ratio"), dedup.alias("dedup_ratio"))


@query()
def topic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two jobs' sentences clustered by average linkage; SQL can't express it."""
    rows = B.table(spark, sf_dir, "embeddings").select((F.col("label") % 2).alias("job"), F.col("vec_id").alias("pos"), "embedding")
    return fusion.topic_clusters(rows, "job", "pos")
