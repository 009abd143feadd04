"""Queries over timed segments: grouping, scoring, selection under a time budget, clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import text as T
from tapeloom.functions.stopwords import STOP_WORDS
from tapeloom.operators import embedding, folds, scoring
from tapeloom.session import checkpoint, spread
from tapeloom.sources import bindings as B

from .registry import SEGMENTS, query

TARGET = 120.0
#: Dimensions of texts' vectors.
DIMENSIONS = 384
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

BLOCKS = SEGMENTS + r""",
s AS (SELECT video_id, start, start + duration AS stop, words, text, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS i FROM seg WHERE trim(text) <> ''),
run AS (
  SELECT video_id, i, start AS b, stop AS e, CAST(words AS BIGINT) AS w, CAST(NULL AS DOUBLE) AS cb, CAST(NULL AS DOUBLE) AS ce, CAST(NULL AS BIGINT) AS cw FROM s WHERE i = 1
  UNION ALL
  SELECT x.video_id, x.i, CASE WHEN cl THEN x.start ELSE x.b END, x.stop, CASE WHEN cl THEN x.words ELSE x.w + x.words END,
         CASE WHEN cl THEN x.b END, CASE WHEN cl THEN x.e END, CASE WHEN cl THEN x.w END
  FROM (SELECT s.*, r.b, r.e, r.w, (s.start - r.e > 2.0 OR r.w >= 40) AS cl FROM run r JOIN s ON s.video_id = r.video_id AND s.i = r.i + 1) x),
done AS (
  SELECT video_id, cb AS b, ce AS e, cw AS w FROM run WHERE cb IS NOT NULL
  UNION ALL
  SELECT video_id, b, e, w FROM (SELECT *, max(i) OVER (PARTITION BY video_id) AS last FROM run) WHERE i = last),
blocks AS (SELECT video_id, b AS start, least(e, b + 45.0) AS stop, w AS words FROM done WHERE e - b >= 5.0)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.group_segments(B.segments(spark, sf_dir))


@query("WITH RECURSIVE " + BLOCKS + " SELECT video_id, start, stop AS \"end\", words FROM blocks")
def segment_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("video_id", "start", "end", F.col("words").cast("long").alias("words"))


TFIDF = rf"""
tok AS (SELECT video_id, seg_idx, list_filter(regexp_extract_all(lower(text), '[\pL\pN_]{{2,}}'), lambda w: w NOT IN ({STOPS})) AS w FROM seg),
term AS (SELECT video_id, seg_idx, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tok),
tf AS (SELECT video_id, seg_idx, term, count(*) AS tf FROM term GROUP BY 1, 2, 3),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, term) AS k FROM (SELECT video_id, term, sum(tf) AS n, count(*) AS df FROM tf GROUP BY 1, 2)) WHERE k <= 500),
sizes AS (SELECT video_id, count(*) AS n FROM seg GROUP BY 1),
weights AS (SELECT tf.video_id, tf.seg_idx, tf.tf * (ln((1.0 + s.n) / (1 + t.df)) + 1) AS w FROM tf JOIN top t ON t.video_id = tf.video_id AND t.term = tf.term JOIN sizes s ON s.video_id = tf.video_id),
raw AS (
  SELECT s.video_id, s.seg_idx, coalesce(r.x, 0) AS tfidf
  FROM seg s LEFT JOIN (SELECT video_id, seg_idx, sum(w) / sqrt(sum(w * w)) AS x FROM weights GROUP BY 1, 2) r ON r.video_id = s.video_id AND r.seg_idx = s.seg_idx),
tfidf AS (
  SELECT video_id, seg_idx, CASE WHEN count(*) OVER v < 2 THEN 1.0 WHEN max(tfidf) OVER v > 0 THEN tfidf / max(tfidf) OVER v ELSE 0.0 END AS tfidf
  FROM raw WINDOW v AS (PARTITION BY video_id))"""


def semantic_sql(rows: str, place: str) -> str:
    """sem (video_id, place, semantic): as `_semantic` does it, features hashed and weighted in SQL."""
    features = lambda w: f"unnest(list_concat(['=' || {w}], list_transform(range(1, length({w}) + 1), lambda i: substr('<' || {w} || '>', CAST(i AS INT), 3))))"
    hashed = lambda f: f"CAST('0x' || substr(md5({f}), 1, 8) AS BIGINT)"
    value = f"sum(n * (1 - 2 * (h // {DIMENSIONS} % 2)) * idf)"
    return rf"""
ew AS (SELECT video_id, {place}, unnest(regexp_extract_all(lower(text), '[\pL\pN_]+')) AS w FROM {rows}),
eh AS (SELECT video_id, {place}, {hashed("f")} AS h, count(*) AS n FROM (SELECT video_id, {place}, {features("w")} AS f FROM ew) GROUP BY 1, 2, 3),
idf AS (SELECT h % {embedding.BUCKETS} AS bucket, ln((1.0 + (SELECT count(*) FROM {rows})) / (1.0 + count(DISTINCT (video_id, {place})))) + 1.0 AS idf FROM eh GROUP BY 1),
ev AS (SELECT video_id, {place}, h % {DIMENSIONS} AS dim, {value} AS v FROM eh JOIN idf ON bucket = h % {embedding.BUCKETS} GROUP BY 1, 2, 3),
ss AS (SELECT job, k, sentence FROM (SELECT item_id AS job, unnest(l) AS sentence, unnest(range(len(l))) AS k FROM (SELECT item_id, string_split(regexp_replace(text, '([.!?]) +', concat('\1', chr(1)), 'g'), chr(1)) AS l FROM benchmark))),
sw AS (SELECT job, k, unnest(regexp_extract_all(lower(sentence), '[\pL\pN_]+')) AS w FROM ss),
sh AS (SELECT job, k, {hashed("f")} AS h, count(*) AS n FROM (SELECT job, k, {features("w")} AS f FROM sw) GROUP BY 1, 2, 3),
sv AS (SELECT job, k, h % {DIMENSIONS} AS dim, {value.replace("idf", f"coalesce(idf, ln(1.0 + (SELECT count(*) FROM {rows})) + 1.0)")} AS v FROM sh LEFT JOIN idf ON bucket = h % {embedding.BUCKETS} GROUP BY 1, 2, 3),
en AS (SELECT video_id, {place}, sqrt(sum(v * v)) AS r FROM ev GROUP BY 1, 2),
sn AS (SELECT job, k, sqrt(sum(v * v)) AS r FROM sv GROUP BY 1, 2),
dots AS (SELECT video_id, {place}, k, sum(ev.v * sv.v) AS d FROM ev JOIN sv ON sv.job = CAST(video_id AS BIGINT) // 5 AND sv.dim = ev.dim GROUP BY 1, 2, 3),
best AS (
  SELECT x.video_id, x.{place}, max(CASE WHEN ss.job IS NOT NULL THEN coalesce(d / (en.r * sn.r), 0.0) END) AS best
  FROM {rows} x LEFT JOIN ss ON ss.job = CAST(x.video_id AS BIGINT) // 5 LEFT JOIN dots ON dots.video_id = x.video_id AND dots.{place} = x.{place} AND dots.k = ss.k
  LEFT JOIN en ON en.video_id = x.video_id AND en.{place} = x.{place} LEFT JOIN sn ON sn.job = ss.job AND sn.k = ss.k GROUP BY 1, 2),
sem AS (SELECT video_id, {place}, coalesce(CASE WHEN max(best) OVER v - min(best) OVER v > 1e-9 THEN (best - min(best) OVER v) / (max(best) OVER v - min(best) OVER v) END, 0.5) AS semantic FROM best WINDOW v AS (PARTITION BY video_id))"""


def _tfidf(texts: DataFrame, place: str) -> DataFrame:
    """(video_id, place, tfidf): TF-IDF of texts as a share of their video's greatest."""
    raw = scoring.tfidf(texts, "video_id", place)
    return raw.select("video_id", place, scoring.relative("tfidf", "video_id").alias("tfidf"))


def _semantic(spark: SparkSession, sf_dir: str, texts: DataFrame, embedder: embedding.Embedder | None = None) -> DataFrame:
    """`texts` with `semantic`: the greatest cosine to a sentence of their job's summary, between their video's least and greatest.

    Without an embedder, features are weighted by how few of these texts have them. 0.5 where a job has no summary.
    """
    embedder = embedder or embedding.HashingEmbedder(DIMENSIONS).fitted(texts)
    summaries = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("job"), T.sentences_at_spaces(F.col("text")).alias("sentences"))
    rows = embedding.likeness(texts.withColumn("job", F.expr("cast(video_id as bigint) div 5")), "job", summaries, embedder)
    return rows.withColumn("semantic", scoring.min_max("best", "video_id")).drop("job", "best")


SCORED = BLOCKS + r""",
said AS (SELECT r.video_id, r.b AS start, string_agg(s.text, ' ' ORDER BY r.i) AS text FROM run r JOIN s ON s.video_id = r.video_id AND s.i = r.i GROUP BY 1, 2),
num AS (SELECT b.*, t.text, row_number() OVER (PARTITION BY b.video_id ORDER BY b.start) - 1 AS place FROM blocks b JOIN said t ON t.video_id = b.video_id AND t.start = b.start),""" + TFIDF.replace("seg_idx", "place").replace("FROM seg", "FROM num") + "," + semantic_sql("num", "place") + r""",
scored AS (SELECT n.video_id, n.start, n.stop, n.words, round(0.7 * m.semantic + 0.3 * t.tfidf, 6) AS score
  FROM num n JOIN sem m ON m.video_id = n.video_id AND m.place = n.place JOIN tfidf t ON t.video_id = n.video_id AND t.place = n.place)"""
SELECTED = SCORED + r""",
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, start) AS i FROM scored),
pick AS (
  SELECT video_id, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS total, CAST([] AS STRUCT(b DOUBLE, e DOUBLE, score DOUBLE)[]) AS chosen FROM (SELECT DISTINCT video_id FROM o)
  UNION ALL
  SELECT x.video_id, x.i, CASE WHEN x.take THEN x.total + x.stop - x.start ELSE x.total END,
         CASE WHEN x.take THEN list_append(x.chosen, {'b': x.start, 'e': x.stop, 'score': x.score}) ELSE x.chosen END
  FROM (
    SELECT o.*, p.total, p.chosen,
           p.total < 120.0 AND o.stop > o.start AND p.total + o.stop - o.start <= 120.0 * 1.1
           AND len(list_filter(p.chosen, lambda c: NOT (c.e + 5.0 <= o.start OR c.b >= o.stop + 5.0))) = 0 AS take
    FROM pick p JOIN o ON o.video_id = p.video_id AND o.i = p.i + 1) x),
final AS (SELECT video_id, unnest(chosen) AS c FROM (SELECT *, max(i) OVER (PARTITION BY video_id) AS last FROM pick) WHERE i = last)"""


def _scored(spark: SparkSession, sf_dir: str, embedder: embedding.Embedder | None = None) -> DataFrame:
    """Blocks with their score: 0.7 for likeness to their job's summary and 0.3 for TF-IDF among the video's blocks.

    Blocks are made once and kept, as weights, likeness and TF-IDF all read them.
    """
    blocks = checkpoint(spread(_blocks(spark, sf_dir), "video_id").withColumn("place", F.row_number().over(Window.partitionBy("video_id").orderBy("start")) - 1))
    both = _semantic(spark, sf_dir, blocks, embedder).join(_tfidf(blocks, "place"), ["video_id", "place"])
    return both.withColumn("score", F.round(scoring.hybrid(F.col("semantic"), F.col("tfidf")), 6)).select("video_id", "start", "end", "words", "text", "score")


def _highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.select_highlights(_scored(spark, sf_dir), TARGET)


@query("WITH RECURSIVE " + SELECTED + " SELECT video_id, greatest(0.0, c.b - 3.0) AS start_time, c.e + 3.0 AS end_time, c.score AS importance_score FROM final")
def highlight_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: segments are grouped into blocks, scored, chosen within two minutes, and padded."""
    return _highlights(spark, sf_dir).select("video_id", F.greatest(F.lit(0.0), F.col("start") - 3.0).alias("start_time"), (F.col("end") + 3.0).alias("end_time"), F.col("score").alias("importance_score"))


@query("WITH RECURSIVE " + SELECTED + " SELECT video_id, round(sum(c.e - c.b), 2) AS seconds, count(*) AS clips FROM final GROUP BY video_id")
def highlight_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _highlights(spark, sf_dir).groupBy("video_id").agg(F.round(F.sum(F.col("end") - F.col("start")), 2).alias("seconds"), F.count("*").alias("clips"))


@query("WITH RECURSIVE " + SELECTED + r""" SELECT video_id, string_agg(printf('%.1f-%.1f', c.b, c.e), ' ' ORDER BY c.b) AS clips FROM final GROUP BY video_id""")
def highlight_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video's clips as one array of structs in order of time, written out."""
    clips = _highlights(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("c"))
    return clips.select("video_id", F.array_join(F.transform("c", lambda x: F.format_string("%.1f-%.1f", x["start"], x["end"])), " ").alias("clips"))


@query("WITH RECURSIVE " + SCORED + r""", j AS (SELECT CAST(video_id AS BIGINT) // 5 AS job, * FROM scored),
o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, video_id, start) AS i FROM j),
pick AS (
  SELECT job, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS total, CAST(NULL AS VARCHAR) AS video_id, CAST(NULL AS DOUBLE) AS start, CAST(NULL AS DOUBLE) AS stop, false AS take FROM (SELECT DISTINCT job FROM o)
  UNION ALL
  SELECT x.job, x.i, CASE WHEN x.ok THEN x.total + x.stop - x.start ELSE x.total END, x.video_id, x.start, x.stop, x.ok
  FROM (SELECT o.*, p.total, p.total < 300.0 AND o.stop > o.start AND p.total + o.stop - o.start <= 300.0 * 1.1 AS ok FROM pick p JOIN o ON o.job = p.job AND o.i = p.i + 1) x)
SELECT job, video_id, start, stop AS "end" FROM pick WHERE take""")
def fit_to_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of five videos a job, fitted into five minutes."""
    scored = _scored(spark, sf_dir).withColumn("job", F.expr("cast(video_id as bigint) div 5"))
    return folds.fit_to_duration(scored, "job", 300.0).select("job", "video_id", "start", "end")


@query("WITH RECURSIVE " + SEGMENTS + r""",
o AS (SELECT *, start + duration AS stop, row_number() OVER (PARTITION BY video_id ORDER BY length(text) DESC, seg_idx) AS i FROM seg),
pick AS (
  SELECT video_id, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS total, CAST(NULL AS DOUBLE) AS start, CAST(NULL AS DOUBLE) AS stop, CAST(NULL AS BIGINT) AS words, false AS take FROM (SELECT DISTINCT video_id FROM o)
  UNION ALL
  SELECT x.video_id, x.i, CASE WHEN x.ok THEN x.total + x.duration ELSE x.total END, x.start, x.stop, x.words, x.ok
  FROM (SELECT o.*, p.total, p.total < 120.0 AND o.duration BETWEEN 2.0 AND 60.0 AS ok FROM pick p JOIN o ON o.video_id = p.video_id AND o.i = p.i + 1) x)
SELECT video_id, start, stop AS "end", least(words / 50.0, 1.0) AS score FROM pick WHERE take""")
def length_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.longest_texts(B.segments(spark, sf_dir), TARGET)


# ---- scores

SUMMARY = r"""
summary AS (SELECT item_id AS job, unnest(string_split(regexp_replace(text, '([.!?]) +', concat('\1', chr(1)), 'g'), chr(1))) AS sentence FROM benchmark),
their AS (SELECT job, word, count(*) AS n FROM (SELECT job, unnest(list_distinct(regexp_extract_all(lower(sentence), '[\pL\pN_]+'))) AS word FROM summary) GROUP BY 1, 2),
our AS (SELECT CAST(video_id AS BIGINT) // 5 AS job, video_id, seg_idx, unnest(list_distinct(regexp_extract_all(lower(text), '[\pL\pN_]+'))) AS word FROM seg),
overlapped AS (
  SELECT s.video_id, s.seg_idx, CAST(coalesce(h.score, 0) AS BIGINT) AS score
  FROM seg s LEFT JOIN (SELECT video_id, seg_idx, sum(n) AS score FROM our JOIN their USING (job, word) GROUP BY 1, 2) h ON s.video_id = h.video_id AND s.seg_idx = h.seg_idx)"""


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job, k, sentence): an item of the benchmark stands for the summary of the job of its number."""
    return B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("job"), F.posexplode(T.sentences_at_spaces(F.col("text"))).alias("k", "sentence"))


def _of_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with their job, five videos each."""
    return B.segments(spark, sf_dir).withColumn("job", F.expr("cast(video_id as bigint) div 5"))


@query("WITH " + SEGMENTS + "," + SUMMARY + " SELECT * FROM overlapped")
def overlap_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that segments have in common with the sentences of their job's summary; 0 for jobs without one."""
    return scoring.overlap(_of_jobs(spark, sf_dir), _summaries(spark, sf_dir), "job")


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with their overlap; place: the video's in its job."""
    segments = _of_jobs(spark, sf_dir)
    scored = segments.join(scoring.overlap(segments, _summaries(spark, sf_dir), "job"), ["video_id", "seg_idx"])
    return scored.withColumn("place", (F.col("video_id").cast("long") % 5).cast("int"))


BUDGET = SEGMENTS + "," + SUMMARY + r""",
j AS (SELECT CAST(s.video_id AS BIGINT) // 5 AS job, CAST(CAST(s.video_id AS BIGINT) % 5 AS INT) AS place, s.seg_idx, s.start, s.duration, v.score FROM seg s JOIN overlapped v ON s.video_id = v.video_id AND s.seg_idx = v.seg_idx),
o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY score DESC, place, seg_idx) AS i FROM j),
pick AS (
  SELECT job, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS total, CAST([0, 0, 0, 0, 0] AS DOUBLE[]) AS used, CAST([] AS VARCHAR[]) AS chosen FROM (SELECT DISTINCT job FROM o)
  UNION ALL
  SELECT x.job, x.i, CASE WHEN x.ok THEN x.total + x.duration ELSE x.total END,
         CASE WHEN x.ok THEN list_transform(x.used, lambda u, k: CASE WHEN k = x.place + 1 THEN u + x.duration ELSE u END) ELSE x.used END,
         CASE WHEN x.ok THEN list_append(x.chosen, x.place || '_' || x.start) ELSE x.chosen END
  FROM (SELECT o.*, p.total, p.used, p.chosen,
               p.total < 300.0 AND NOT list_contains(p.chosen, o.place || '_' || o.start) AND p.used[o.place + 1] + o.duration <= 300.0 / 5 * 1.2 AND p.total + o.duration <= 300.0 * 1.1 AS ok
        FROM pick p JOIN o ON o.job = p.job AND o.i = p.i + 1) x),
final AS (SELECT job, total, chosen FROM (SELECT *, max(i) OVER (PARTITION BY job) AS last FROM pick) WHERE i = last)"""


@query("WITH RECURSIVE " + BUDGET + r"""
SELECT j.job, j.place, j.seg_idx, j.start, j.start + j.duration AS "end" FROM j JOIN final f ON f.job = j.job AND list_contains(f.chosen, j.place || '_' || j.start) WHERE j.duration > 0""")
def budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = folds.budget_select(_jobs(spark, sf_dir), "job", F.lit(5), 300.0)
    return picked.select("job", F.inline("chosen")).where(F.col("end") > F.col("start"))


@query("WITH RECURSIVE " + BUDGET.replace("300.0", "900.0") + r""",
e AS (SELECT j.*, f.total AS t0, f.chosen AS before, row_number() OVER (PARTITION BY j.job ORDER BY j.place, j.seg_idx) AS i FROM j JOIN final f ON f.job = j.job),
walk AS (
  SELECT job, CAST(0 AS BIGINT) AS i, any_value(t0) AS total, -1 AS place, CAST(0 AS DOUBLE) AS added, -1 AS seg_idx, false AS ok FROM e GROUP BY job
  UNION ALL
  SELECT x.job, x.i, CASE WHEN x.take THEN x.total + x.duration ELSE x.total END, x.place, x.a + CASE WHEN x.take THEN x.duration ELSE 0 END, x.seg_idx, x.take
  FROM (SELECT y.*, y.t0 < 900.0 * 0.8 AND y.total < 900.0 AND NOT list_contains(y.before, y.place || '_' || y.start) AND y.a + y.duration <= (900.0 - y.t0) / 5 * 1.5 AS take
        FROM (SELECT e.*, w.total, CASE WHEN w.place = e.place THEN w.added ELSE 0 END AS a FROM walk w JOIN e ON e.job = w.job AND e.i = w.i + 1) y) x)
SELECT job, place, seg_idx FROM walk WHERE ok AND seg_idx >= 0
UNION ALL SELECT j.job, j.place, j.seg_idx FROM j JOIN final f ON f.job = j.job AND list_contains(f.chosen, j.place || '_' || j.start)""")
def budget_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of an hour is more than the selection finds within its videos' shares, so segments are added."""
    rows = _jobs(spark, sf_dir)
    grown = folds.budget_expand(rows, folds.budget_select(rows, "job", F.lit(5), 900.0), "job", F.lit(5), 900.0)
    return grown.select("job", F.inline("chosen")).select("job", "place", "seg_idx")


@query("WITH " + SEGMENTS + "," + TFIDF + " SELECT video_id, seg_idx, round(tfidf, 6) AS tfidf FROM tfidf")
def tfidf_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tfidf(B.segments(spark, sf_dir), "seg_idx").select("video_id", "seg_idx", F.round("tfidf", 6).alias("tfidf"))


@query("WITH " + SEGMENTS + "," + TFIDF + "," + semantic_sql("seg", "seg_idx") + r"""
SELECT m.video_id, m.seg_idx, round(0.7 * semantic + 0.3 * tfidf, 4) AS score, printf('Semantic match: %.2f, TF-IDF: %.2f', round(semantic, 2), round(tfidf, 2)) AS reason
FROM sem m JOIN tfidf t ON t.video_id = m.video_id AND t.seg_idx = m.seg_idx""")
def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = checkpoint(spread(B.segments(spark, sf_dir).select("video_id", "seg_idx", "text"), "video_id"))
    both = _semantic(spark, sf_dir, segments).join(_tfidf(segments, "seg_idx"), ["video_id", "seg_idx"])
    reason = F.format_string("Semantic match: %.2f, TF-IDF: %.2f", F.round("semantic", 2), F.round("tfidf", 2))
    return both.select("video_id", "seg_idx", F.round(scoring.hybrid(F.col("semantic"), F.col("tfidf")), 4).alias("score"), reason.alias("reason"))


@query("WITH " + SEGMENTS + "," + semantic_sql("seg", "seg_idx") + " SELECT video_id, seg_idx, round(semantic, 4) AS semantic FROM sem")
def semantic_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of segments to their own job's summary, between their video's least and greatest."""
    segments = checkpoint(spread(B.segments(spark, sf_dir).select("video_id", "seg_idx", "text"), "video_id"))
    return _semantic(spark, sf_dir, segments).select("video_id", "seg_idx", F.round("semantic", 4).alias("semantic"))


@query("WITH RECURSIVE " + SEGMENTS + r""",
sent AS (SELECT item_id AS job, unnest(l) AS sentence, unnest(range(len(l))) AS k FROM (SELECT item_id, string_split(regexp_replace(text, '([.!?]) +', concat('\1', chr(1)), 'g'), chr(1)) AS l FROM benchmark)),
a AS (SELECT job, k, unnest(list_distinct(regexp_extract_all(lower(sentence), '[\pL\pN_]+'))) AS word FROM sent),
b AS (SELECT CAST(video_id AS BIGINT) // 5 AS job, video_id, seg_idx, unnest(list_distinct(regexp_extract_all(lower(text), '[\pL\pN_]+'))) AS word FROM seg),
hits AS (SELECT job, k, video_id, seg_idx, count(*) AS n FROM a JOIN b USING (job, word) GROUP BY 1, 2, 3, 4),
ranked AS (SELECT job, k, CAST(video_id AS BIGINT) AS v, seg_idx, row_number() OVER (PARTITION BY job, k ORDER BY n DESC, CAST(video_id AS BIGINT), seg_idx) AS r FROM hits),
lists AS (SELECT job, k, list(v * 1000 + seg_idx ORDER BY r) AS l FROM ranked GROUP BY 1, 2),
walk AS (
  SELECT job, CAST(-1 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS pick FROM (SELECT DISTINCT job FROM sent)
  UNION ALL
  SELECT w.job, w.k + 1, CASE WHEN x.p IS NULL THEN w.used ELSE list_append(w.used, x.p) END, x.p
  FROM walk w JOIN (SELECT s.job, s.k, l.l FROM sent s LEFT JOIN lists l ON l.job = s.job AND l.k = s.k) q ON q.job = w.job AND q.k = w.k + 1,
       LATERAL (SELECT list_filter(q.l, lambda y: NOT list_contains(w.used, y))[1] AS p) x)
SELECT job, k AS sentence, CAST(pick // 1000 AS VARCHAR) AS video_id, CAST(pick % 1000 AS INT) AS seg_idx FROM walk WHERE pick IS NOT NULL""")
def summary_to_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sentence of a job's summary takes the job's unused segment with most words in common, in order.

    Words meet by an equi-join within the job, then a fold per job. A sentence needs no more candidates than its summary
    has sentences: earlier ones use up one segment each at most.
    """
    sentences = _summaries(spark, sf_dir)
    a = sentences.select("job", "k", F.explode(T.word_set(F.col("sentence"))).alias("word"))
    b = _of_jobs(spark, sf_dir).select("job", F.col("video_id").cast("long").alias("v"), "seg_idx", F.explode(T.word_set(F.col("text"))).alias("word"))
    hits = b.join(a, ["job", "word"]).groupBy("job", "k", "v", "seg_idx").agg(F.count("*").alias("n"))
    sizes = sentences.groupBy("job").agg(F.count("*").alias("sentences"))
    best = Window.partitionBy("job", "k").orderBy(F.desc("n"), "v", "seg_idx")
    ranked = hits.withColumn("r", F.row_number().over(best)).join(sizes, "job").where("r <= sentences")
    lists = ranked.groupBy("job", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v", "seg_idx"))), lambda x: F.struct(x["v"].alias("v"), x["seg_idx"].alias("seg_idx"))).alias("l"))
    kind = "array<struct<k:int,v:long,seg_idx:int>>"

    def step(a: Column, x: Column) -> Column:
        free = F.filter(x["l"], lambda c: ~F.exists(a, lambda u: (u["v"] == c["v"]) & (u["seg_idx"] == c["seg_idx"])))
        first = F.get(free, F.lit(0))
        return F.when(first.isNull(), a).otherwise(F.concat(a, F.array(F.struct(x["k"].alias("k"), first["v"].alias("v"), first["seg_idx"].alias("seg_idx")))))

    out = folds.ordered_fold(lists, ["job"], [F.col("k")], [F.col("k"), F.col("l")], F.array().cast(kind), step)
    return out.select("job", F.inline("out")).select("job", F.col("k").cast("long").alias("sentence"), F.col("v").cast("string").alias("video_id"), "seg_idx")


# ---- time


@query("WITH RECURSIVE " + BLOCKS + r"""
SELECT a.video_id, a.start AS start_a, b.start AS start_b FROM blocks a JOIN blocks b ON a.video_id = b.video_id AND a.start < b.start AND b.start < a.stop + 5.0""")
def interval_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a video's blocks that come within five seconds: met by slices of time, so no video's blocks all meet."""
    width, gap = 60.0, 5.0
    blocks = _blocks(spark, sf_dir).select("video_id", "start", "end")
    slot = lambda c: F.floor(c / width)
    a = blocks.select("video_id", F.col("start").alias("start_a"), F.col("end").alias("end_a"), F.explode(F.sequence(slot(F.col("start")), slot(F.col("end") + gap))).alias("slot"))
    b = blocks.select("video_id", F.col("start").alias("start_b"), slot(F.col("start")).alias("slot"))
    return a.join(b, ["video_id", "slot"]).where((F.col("start_a") < F.col("start_b")) & (F.col("start_b") < F.col("end_a") + gap)).select("video_id", "start_a", "start_b")


@query("WITH " + SEGMENTS + r"""
SELECT video_id, seg_idx, coalesce(start - lag(start + duration) OVER (PARTITION BY video_id ORDER BY seg_idx), 0.0) AS gap,
       coalesce(start - lag(start + duration) OVER (PARTITION BY video_id ORDER BY seg_idx) > 2.0, false) AS pause FROM seg""")
def pause_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.coalesce(F.col("start") - F.lag("end").over(Window.partitionBy("video_id").orderBy("seg_idx")), F.lit(0.0))
    return B.segments(spark, sf_dir).select("video_id", "seg_idx", gap.alias("gap")).withColumn("pause", F.col("gap") > 2.0)


@query("WITH RECURSIVE " + SELECTED + r"""
SELECT video_id, c.b AS start, coalesce(sum(c.e - c.b) OVER (PARTITION BY video_id ORDER BY c.b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS "offset" FROM final""")
def edl_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each chosen clip begins in the merged video."""
    before = Window.partitionBy("video_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return _highlights(spark, sf_dir).select("video_id", "start", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0.0)).alias("offset"))


@query("WITH " + SEGMENTS + r""", hit AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS k FROM seg WHERE contains(lower(text), 'the'))
SELECT video_id, CAST(floor(min(start)) AS BIGINT) AS clip_start, CAST(floor(max(start)) AS BIGINT) + 30 AS clip_end FROM hit WHERE k <= 3 GROUP BY video_id""")
def clip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a video's first match to thirty seconds after its third."""
    hits = B.segments(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("the")))
    first = hits.withColumn("k", F.row_number().over(Window.partitionBy("video_id").orderBy("seg_idx"))).where("k <= 3")
    return first.groupBy("video_id").agg(F.floor(F.min("start")).alias("clip_start"), (F.floor(F.max("start")) + 30).alias("clip_end"))


@query("WITH " + SEGMENTS + r""" SELECT video_id, seg_idx, CAST(floor(start) AS BIGINT) AS at FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) AS k FROM seg WHERE contains(lower(text), 'en')) WHERE k <= 5""")
def top_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = B.segments(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("en")))
    return hits.withColumn("k", F.row_number().over(Window.partitionBy("video_id").orderBy("seg_idx"))).where("k <= 5").select("video_id", "seg_idx", F.floor("start").alias("at"))
