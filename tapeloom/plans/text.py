"""Queries over texts: sentences, cleaning, packing, extracts, durations, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions import text as T
from tapeloom.operators import folds, profiles, scoring, summaries
from tapeloom.sources import bindings as B

from .highlights import STOPS
from .registry import SEGMENTS, query

WORDS = r"list_filter(string_split_regex({}, '\s+'), lambda x: x <> '')"
COUNT = "len(" + WORDS + ")"
SENTENCES = r"string_split(regexp_replace({}, '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query(f"SELECT doc_id, CAST({COUNT.format('text')} AS BIGINT) AS words, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_]+'))) AS BIGINT) AS distinct_words FROM documents")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", T.word_count(text).cast("long").alias("words"), F.size(T.word_set(text)).cast("long").alias("distinct_words"))


@query(r"""SELECT doc_id, CASE WHEN length(t) > 10 THEN length(t) ELSE 0 END AS kept_chars, md5(CASE WHEN length(t) > 10 THEN t ELSE '' END) AS digest
FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.cleaned(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("kept_chars"), F.md5(t).alias("digest"))


@query(f"SELECT doc_id, pos, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, CAST(unnest(range(len(l))) AS INT) AS pos FROM (SELECT doc_id, {SENTENCES.format('text')} AS l FROM documents)) WHERE {COUNT.format('s')} >= 5")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of five words or more, as they are indexed."""
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.where(T.word_count(F.col("sentence")) >= 5)


@query(rf"""SELECT source AS video_id, coalesce(n_name, 'Video ' || left(source, 8)) AS video_title, doc_id, pos AS position, trim(s) AS text
FROM (SELECT source, doc_id, unnest(l) AS s, CAST(unnest(range(len(l))) AS INT) AS pos FROM (SELECT source, doc_id, string_split_regex(text, '[.!?]+') AS l FROM documents)) LEFT JOIN nation ON source = 'src' || (n_nationkey + 10)
WHERE {COUNT.format('s')} BETWEEN 5 AND 100""")
def sentence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of 5 to 100 words with their place and their video's title; one without a title gets one from its id.

    Names of nations stand for titles of the videos from the tenth on; those before have none.
    """
    titles = B.table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey") + 10).alias("video_id"), F.col("n_name").alias("title"))
    rows = _docs(spark, sf_dir).select(F.col("source").alias("video_id"), "doc_id", F.posexplode(T.statements(F.col("text"))).alias("position", "s"))
    kept = rows.where(T.word_count(F.col("s")).between(5, 100)).join(titles, "video_id", "left")
    return kept.select("video_id", F.coalesce("title", F.concat(F.lit("Video "), F.left("video_id", F.lit(8)))).alias("video_title"), "doc_id", "position", F.trim("s").alias("text"))


@query(rf"""WITH s AS (SELECT doc_id, unnest(l) AS s, CAST(unnest(range(len(l))) AS INT) AS pos FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]) +', concat('\1', chr(1)), 'g'), chr(1)) AS l FROM documents))
SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, lower(trim(s)) ORDER BY pos) AS k FROM s WHERE length(trim(s)) > 10) WHERE k = 1""")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's sentences of over ten characters, the first of equal ones: by a minimum, which is combined before the shuffle."""
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences_at_spaces(F.col("text"))).alias("pos", "s"))
    keyed = rows.where(F.length(F.trim("s")) > 10).select("doc_id", "pos", F.sha2(T.dedupe_key(F.col("s")), 256).alias("key"))
    return keyed.groupBy("doc_id", "key").agg(F.min("pos").alias("pos")).select("doc_id", "pos")


LINKS = """CASE page_id % 7 WHEN 0 THEN 'https://www.youtube.com/watch?v=' || id || '&t=1' WHEN 1 THEN 'https://youtu.be/' || id WHEN 2 THEN 'youtube.com/embed/' || id
WHEN 3 THEN ' youtube.com/shorts/' || id WHEN 4 THEN 'https://youtube.com/live/' || id WHEN 5 THEN ' ' || id || ' ' ELSE url END"""


@query(f"""SELECT page_id, CASE WHEN page_id % 7 < 6 THEN id ELSE trim(url) END AS video_id
FROM (SELECT page_id, url, left(md5(url), 11) AS id FROM pages)""")
def extract_video_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each known shape, made from the pages' URLs, give back the id that was put in."""
    pages = B.table(spark, sf_dir, "pages").select("page_id", "url", F.left(F.md5("url"), F.lit(11)).alias("id"))
    return pages.select("page_id", F.expr(LINKS).alias("link")).select("page_id", T.video_id(F.col("link")).alias("video_id"))


@query(rf"""SELECT page_id, regexp_extract({LINKS}, '(?:youtube\.com/.*v=|youtu\.be/)([^&\n?#]+)', 1) AS video_id FROM (SELECT page_id, url, left(md5(url), 11) AS id FROM pages)""")
def loose_video_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The looser pattern: whatever follows v= or the short host, '' if neither is there."""
    pages = B.table(spark, sf_dir, "pages").select("page_id", "url", F.left(F.md5("url"), F.lit(11)).alias("id"))
    return pages.select("page_id", F.expr(LINKS).alias("link")).select("page_id", T.loose_video_id(F.col("link")).alias("video_id"))


@query(rf"SELECT item_id, array_to_string(({WORDS.format('text')})[1:12], ' ') AS by_words, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS by_chars FROM benchmark")
def truncate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = B.table(spark, sf_dir, "benchmark")
    return b.select("item_id", T.first_words(F.col("text"), 12).alias("by_words"), T.truncated(F.col("text"), 100).alias("by_chars"))


@query(r"""WITH p AS (SELECT conv_id, trim(text) AS para, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, md5(string_agg(CASE WHEN i > 0 AND NOT regexp_matches(para, '^(Additionally|Furthermore|Moreover|However|In contrast)') THEN '... ' || para ELSE para END, chr(10) || chr(10) ORDER BY i)) AS digest
FROM p WHERE para <> '' GROUP BY conv_id""")
def narration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the paragraphs of a text."""
    c = B.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")
    return c.select("conv_id", F.md5(T.narration(text)).alias("digest"))


@query("SELECT doc_id, md5(text || ':' || lang) AS cache_key, sha256(text) AS digest, regexp_matches(sha256(text), '^[0-9a-fA-F]{64}$') AS is_digest FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2("text", 256)
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.concat_ws(":", "text", "lang")).alias("cache_key"), digest.alias("digest"), digest.rlike("(?i)^[0-9a-f]{64}$").alias("is_digest"))


CHUNKS = rf"""
sent AS (SELECT doc_id, pos, {COUNT.format('s')} AS n FROM (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {SENTENCES.format('text')} AS l FROM documents))),
pack AS (
  SELECT doc_id, pos, CAST(n AS BIGINT) AS size, 0 AS batch FROM sent WHERE pos = 0
  UNION ALL
  SELECT s.doc_id, s.pos, CASE WHEN p.size + s.n > 800 THEN s.n ELSE p.size + s.n END, CASE WHEN p.size + s.n > 800 THEN p.batch + 1 ELSE p.batch END
  FROM pack p JOIN sent s ON s.doc_id = p.doc_id AND s.pos = p.pos + 1)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences of a document stand in its row, so they are packed there, without a shuffle."""
    sizes = F.transform(T.sentences(F.col("text")), T.word_count)
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(folds.packed(sizes, 800)).alias("batch", "b"))
    return rows.select("doc_id", "batch", F.col("b.items").cast("long").alias("sentences"), F.col("b.size").alias("words"))


@query("WITH RECURSIVE " + CHUNKS + " SELECT p.doc_id, p.batch, count(*) AS sentences, CAST(sum(s.n) AS BIGINT) AS words FROM pack p JOIN sent s USING (doc_id, pos) GROUP BY 1, 2")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed into chunks of up to 800 words."""
    return _chunks(spark, sf_dir)


@query("WITH RECURSIVE " + CHUNKS + r""",
c AS (SELECT p.doc_id, p.batch, CAST(sum(s.n) AS INT) AS w FROM pack p JOIN sent s USING (doc_id, pos) GROUP BY 1, 2),
d AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, sum(w) OVER (PARTITION BY doc_id) AS total FROM c),
t AS (SELECT doc_id, batch, least(greatest(50, CAST(trunc(greatest(50, 750 // n) * (w / (total / n))) AS INT)), w) AS target FROM d WHERE n > 1 AND total > 750 * 1.15)
SELECT doc_id, batch, target, CASE WHEN lo >= hi THEN greatest(10, hi // 2) ELSE lo END AS min_length, hi AS max_length
FROM (SELECT *, least(300, greatest(CAST(trunc(target * 1.3) AS INT), 100)) AS hi, greatest(80, CAST(trunc(target * 0.5) AS INT)) AS lo FROM t)""")
def chunk_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over 1.15 times the five-minute target: what each chunk's summary may take, and the model's bounds for it."""
    target, least, most = F.lit(750), F.lit(80), F.lit(300)
    by = Window.partitionBy("doc_id")
    rows = _chunks(spark, sf_dir).withColumn("n", F.count("*").over(by)).withColumn("total", F.sum("words").over(by)).where((F.col("n") > 1) & (F.col("total") > target * 1.15))
    planned = rows.select("doc_id", "batch", summaries.chunk_target(target, F.col("n"), F.col("words").cast("int"), F.col("total")).alias("target"))
    low, top = profiles.length_bounds(F.col("target"), least, most)
    return planned.select("doc_id", "batch", "target", low.alias("min_length"), top.alias("max_length"))


@query(r"""WITH RECURSIVE c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
start AS (SELECT doc_id, list_filter(string_split(CASE WHEN length(t) > 10 THEN t ELSE '' END, ' '), lambda x: x <> '') AS w FROM c),
r AS (
  SELECT doc_id, 0 AS rounds, w, len(w) <= 150 * 1.15 AS done FROM start
  UNION ALL
  SELECT doc_id, rounds + 1, CASE WHEN len(p) = 1 THEN w[:150] ELSE short END, len(p) = 1 OR len(short) <= 150 * 1.15
  FROM (
    SELECT *, flatten(list_transform(range(1, len(p) + 1), lambda i: w[q + 1 + list_sum(p[:i - 1] || [0]) : q + list_sum(p[:i - 1] || [0]) + least(greatest(50, CAST(trunc(greatest(50, 150 // len(p)) * (p[i] / (len(w) / len(p)))) AS INT)), p[i])])) AS short
    FROM (
      SELECT doc_id, rounds, w, 0 AS q, list_reduce(list_transform(string_split(regexp_replace(array_to_string(w, ' '), '([.!?]) ', concat('\1', chr(1)), 'g'), chr(1)), lambda s: [len(string_split(s, ' '))]),
             lambda a, x: CASE WHEN a[len(a)] + x[1] > 800 THEN list_concat(a, x) ELSE list_append(a[:len(a) - 1], a[len(a)] + x[1]) END) AS p
      FROM r WHERE NOT done AND rounds < 3))),
last AS (SELECT * FROM r WHERE done OR rounds = 3),
f AS (SELECT doc_id, rounds, CASE WHEN len(w) > 150 * 1.15 AND len(w) <= 960 AND NOT done THEN w[:150] ELSE w END AS w FROM last)
SELECT doc_id, CAST(rounds AS BIGINT) AS rounds, len(w) AS words, array_to_string(w, ' ') AS text FROM f""")
def recursive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document brought down to a minute's words, level by level, by the first words of chunks."""
    return summaries.summarised(_docs(spark, sf_dir), "doc_id", target=150)


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, trim(s) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS i
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents) WHERE trim(s) <> ''),
pack AS (
  SELECT doc_id, i, length(s) AS size, 0 AS batch FROM l WHERE i = 0
  UNION ALL
  SELECT l.doc_id, l.i, CASE WHEN p.size + 1 + length(l.s) > 4500 THEN length(l.s) ELSE p.size + 1 + length(l.s) END, CASE WHEN p.size + 1 + length(l.s) > 4500 THEN p.batch + 1 ELSE p.batch END
  FROM pack p JOIN l ON l.doc_id = p.doc_id AND l.i = p.i + 1)
SELECT doc_id, batch, count(*) AS lines, CAST(max(size) AS BIGINT) AS chars FROM pack GROUP BY 1, 2""")
def batch_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed into requests of up to 4500 characters, line breaks counted."""
    lines = F.filter(F.transform(F.split("text", "\n"), T.trimmed), lambda s: s != "")
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(folds.packed(F.transform(lines, F.length), 4500, separator=1)).alias("batch", "b"))
    return rows.select("doc_id", "batch", F.col("b.items").cast("long").alias("lines"), F.col("b.size").alias("chars"))


@query("""SELECT doc_id, CAST(i AS INT) AS pos, CAST(length(substr(text, i * 4500 + 1, 4500)) AS INT) AS chars, md5(substr(text, i * 4500 + 1, 4500)) AS digest
FROM (SELECT doc_id, text, unnest(range((length(text) + 4499) // 4500)) AS i FROM documents)""")
def fixed_chunks(spark: SparkSession, sf_dir: str, size: int = 4500) -> DataFrame:
    """Texts cut every 4500 characters."""
    at = F.when(F.length("text") > 0, F.sequence(F.lit(1), F.length("text"), F.lit(size)))
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.transform(at, lambda i: F.substring("text", i, F.lit(size)))).alias("pos", "c"))
    return rows.select("doc_id", "pos", F.length("c").alias("chars"), F.md5("c").alias("digest"))


# ---- transcripts as text


@query("WITH " + SEGMENTS + " SELECT video_id, seg_idx, start AS timestamp, text FROM seg WHERE contains(lower(text), lower('The'))")
def keyword_search(spark: SparkSession, sf_dir: str, keyword: str = "The") -> DataFrame:
    hits = B.segments(spark, sf_dir).where(F.contains(F.lower("text"), F.lower(F.lit(keyword))))
    return hits.select("video_id", "seg_idx", F.col("start").alias("timestamp"), "text")


@query("SELECT CAST(conv_id AS VARCHAR) AS video_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.segments(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))).alias("t"))
    return rows.select("video_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


@query("""WITH asked AS (SELECT conv_id AS job, unnest([conv_id + 1, -5, conv_id, conv_id + 100000000, conv_id - 1]) AS id, unnest([0, 1, 2, 3, 4]) AS place FROM (SELECT DISTINCT conv_id FROM conversations)),
whole AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
SELECT job, count(*) AS found, md5(string_agg(text, chr(10) ORDER BY place)) AS digest FROM asked JOIN whole ON id = conv_id GROUP BY job""")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in the order of a list of ids; ids that aren't there are left out."""
    c = B.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    whole = c.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))
    k = F.col("conv_id")
    asked = c.select(k.alias("job"), F.posexplode(F.array(k + 1, F.lit(-5).cast("long"), k, k + 100_000_000, k - 1)).alias("place", "id"))
    found = asked.join(whole, asked.id == whole.conv_id).groupBy("job").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("t"))
    return found.select("job", F.size("t").cast("long").alias("found"), F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("digest"))


@query("WITH " + SEGMENTS + r""", s AS (SELECT *, CAST(floor(start) AS BIGINT) % 86400 AS k FROM seg)
SELECT video_id, md5(string_agg(printf('%02d:%02d:%02d - %s', k // 3600, k % 3600 // 60, k % 60, text), chr(10) ORDER BY seg_idx)) AS clock_lines,
       md5(string_agg(printf('%.2fs: %s', start, text), chr(10) ORDER BY seg_idx)) AS second_lines FROM s GROUP BY video_id""")
def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("seg_idx", F.concat(T.clock(F.col("start")), F.lit(" - "), F.col("text")).alias("a"), F.concat(F.format_string("%.2fs: ", "start"), F.col("text")).alias("b"))
    rows = B.segments(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(line)).alias("l"))
    joined = lambda f: F.md5(F.array_join(F.transform("l", lambda x: x[f]), "\n"))
    return rows.select("video_id", joined("a").alias("clock_lines"), joined("b").alias("second_lines"))


@query("WITH " + SEGMENTS + " SELECT video_id, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM seg WHERE start BETWEEN 20 AND 120 GROUP BY video_id")
def segment_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.segments(spark, sf_dir).where(F.col("start").between(20, 120)).groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))).alias("t"))
    return rows.select("video_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"))


@query("WITH " + SEGMENTS + " SELECT video_id, seg_idx, start, text FROM seg WHERE words >= 3")
def index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.segments(spark, sf_dir).where("words >= 3").select("video_id", "seg_idx", "start", "text")


# ---- local enrichment

TOP = rf"""
sent AS (SELECT conv_id, trim(s) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS i FROM (
  SELECT conv_id, turn, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT conv_id, turn, {SENTENCES.format('trim(text)')} AS l FROM conversations)) WHERE {COUNT.format('s')} >= 6),
term AS (SELECT conv_id, i, unnest(list_filter(regexp_extract_all(lower(s), '[\pL\pN_]{{2,}}'), lambda w: w NOT IN ({STOPS}))) AS term FROM sent),
tf AS (SELECT conv_id, i, term, count(*) AS tf FROM term GROUP BY 1, 2, 3),
feat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, term) AS k FROM (SELECT conv_id, term, sum(tf) AS n, count(*) AS df FROM tf GROUP BY 1, 2)) WHERE k <= 300),
sizes AS (SELECT conv_id, count(*) AS n FROM sent GROUP BY 1),
w AS (SELECT tf.conv_id, tf.i, tf.tf * (ln((1.0 + z.n) / (1 + f.df)) + 1) AS w FROM tf JOIN feat f USING (conv_id, term) JOIN sizes z USING (conv_id)),
score AS (SELECT s.conv_id, s.i, s.s, round(coalesce(x.v, 0), 9) AS v FROM sent s LEFT JOIN (SELECT conv_id, i, sum(w) / sqrt(sum(w * w)) AS v FROM w GROUP BY 1, 2) x ON x.conv_id = s.conv_id AND x.i = s.i),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY v DESC, i DESC) AS k FROM score) WHERE k <= 5)"""


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, i, text): a conversation's sentences of six words or more."""
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(summaries.kept_sentences(F.col("text"), 6)).alias("pos", "text"))
    return c.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "pos")) - 1).alias("i"), "text")


def _top(sentences: DataFrame, n: int = 5) -> DataFrame:
    scored = scoring.tfidf(sentences, "conv_id", "i", features=300, pairs=False)
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.round("tfidf", 9)), F.desc("i"))
    return scored.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).join(sentences, ["conv_id", "i"]).select("conv_id", "i", "text")


@query("WITH " + TOP + " SELECT conv_id, CAST(i AS INT) AS i, s AS text FROM top")
def top_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's five sentences of highest TF-IDF, in order."""
    return _top(_sentences(spark, sf_dir))


@query("WITH " + TOP + rf""", c AS (SELECT conv_id, least(i // greatest(1, n // 3), 2) AS part, s, i FROM sent JOIN (SELECT conv_id, count(*) AS n FROM sent GROUP BY 1) USING (conv_id))
SELECT conv_id, (['Introduction & Overview', 'Core Discussion', 'Conclusions & Key Points'])[part + 1] AS title, md5(string_agg(s, ' ' ORDER BY i)) AS digest FROM c GROUP BY conv_id, part""")
def local_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sentences(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("t"))
    cut = rows.select("conv_id", F.inline(summaries.chapters(F.transform("t", lambda x: x["text"]))))
    return cut.select("conv_id", "title", F.md5("text").alias("digest"))


@query("WITH " + TOP + r""", t AS (SELECT conv_id, string_agg(s, ' ' ORDER BY i) AS tldr FROM sent WHERE i < 2 GROUP BY 1),
k AS (SELECT conv_id, md5(string_agg(s, chr(10) ORDER BY i)) AS takeaways, count(*) AS n_takeaways FROM top GROUP BY 1)
SELECT conv_id, tldr, takeaways, n_takeaways FROM t JOIN k USING (conv_id)""")
def local_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a model: the first two sentences in short, and the top five as takeaways."""
    sentences = _sentences(spark, sf_dir)
    listed = lambda df: df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("t"))
    short = listed(sentences.where("i < 2")).select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("tldr"))
    top = listed(_top(sentences)).select("conv_id", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("takeaways"), F.size("t").cast("long").alias("n_takeaways"))
    return short.join(top, "conv_id")


@query("SELECT source, count(*) AS texts, count(CASE WHEN lang <> 'en' THEN 1 END) AS to_translate, bool_or(lang <> 'en') AS mixed FROM documents GROUP BY source")
def language_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.col("lang") != "en"
    return _docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("texts"), F.count_if(other).alias("to_translate"), F.bool_or(other).alias("mixed"))


# ---- durations

JOBS = "(SELECT o_orderkey AS job_id, CAST(o_custkey % 25 AS INT) AS m FROM orders)"


@query(f"SELECT job_id, m AS minutes, CASE WHEN m <= 5 THEN 'headline' WHEN m <= 10 THEN 'brief' WHEN m <= 15 THEN 'standard' ELSE 'comprehensive' END AS style FROM {JOBS}")
def duration_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.jobs(spark, sf_dir).select("job_id", F.col("target_minutes").alias("minutes"), profiles.style(F.col("target_minutes")).alias("style"))


@query(f"SELECT job_id, m AS minutes, CASE WHEN m <= 7 THEN 5 WHEN m <= 12 THEN 10 WHEN m <= 17 THEN 15 ELSE 20 END AS profile, CASE WHEN m <= 7 THEN 750 WHEN m <= 12 THEN 1500 WHEN m <= 17 THEN 2200 ELSE 2800 END AS target_words FROM {JOBS}")
def nearest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile itself, else the nearest one: a lookup by key, since the nearest key is an expression."""
    jobs = B.jobs(spark, sf_dir).select("job_id", F.col("target_minutes").alias("minutes"), profiles.nearest_minutes(F.col("target_minutes")).alias("profile"))
    four = profiles.profiles(spark).select(F.col("minutes").alias("profile"), "target_words")
    return jobs.join(F.broadcast(four), "profile").select("job_id", "minutes", "profile", "target_words")


@query(f"""SELECT doc_id, round(w / 160.0, 4) AS minutes, least(512, greatest(100, w // 3)) AS max_tokens, greatest(30, least(512, greatest(100, w // 3)) // 3) AS min_tokens
FROM (SELECT doc_id, CAST({COUNT.format('text')} AS BIGINT) AS w FROM documents)""")
def duration_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    top = F.least(F.lit(512).cast("long"), F.greatest(F.lit(100).cast("long"), F.floor(w / 3)))
    rows = _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).cast("long").alias("w"))
    return rows.select("doc_id", F.round(w / F.lit(160.0), 4).alias("minutes"), top.alias("max_tokens"), F.greatest(F.lit(30).cast("long"), F.floor(top / 3)).alias("min_tokens"))


@query(f"""SELECT job_id, CASE WHEN n > 0 THEN w // n END AS each_words, CASE WHEN n > 0 THEN CAST(trunc(w * 1.0 / (n * (n + 1) / 2.0)) AS INT) END AS first_weighted
FROM (SELECT o_orderkey AS job_id, CAST(o_orderkey % 13 AS INT) AS n, CASE WHEN m <= 7 THEN 750 WHEN m <= 12 THEN 1500 WHEN m <= 17 THEN 2200 ELSE 2800 END AS w FROM (SELECT *, o_custkey % 25 AS m FROM orders))""")
def words_per_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal shares, and the first of shares weighted 1, 2, 3 and so on."""
    n, w = F.col("n_videos"), F.col("target_words")
    jobs = B.jobs(spark, sf_dir).withColumn("profile", profiles.nearest_minutes(F.col("target_minutes")))
    rows = jobs.join(F.broadcast(profiles.profiles(spark).select(F.col("minutes").alias("profile"), "target_words")), "profile")
    return rows.select("job_id", F.when(n > 0, F.floor(w / n).cast("int")).alias("each_words"), F.when(n > 0, (w * 1.0 / (n * (n + 1) / 2.0)).cast("int")).alias("first_weighted"))


@query(f"""SELECT t.*, coalesce(jobs, 0) AS jobs FROM (VALUES (5, '5 min', 'headline', 'Quick highlights - key points only', 750, 300, 80, 0), (10, '10 min', 'brief', 'Brief summary with main ideas', 1500, 600, 200, 4),
(15, '15 min', 'standard', 'Full coverage with examples', 2200, 900, 350, 7), (20, '20 min', 'comprehensive', 'Deep dive with all details', 2800, 1024, 450, 9)) AS t(value, label, style, description, target_words, max_output, min_output, transitions)
LEFT JOIN (SELECT CASE WHEN m <= 7 THEN 5 WHEN m <= 12 THEN 10 WHEN m <= 17 THEN 15 ELSE 20 END AS value, count(*) AS jobs FROM {JOBS} GROUP BY 1) j ON j.value = t.value""")
def profiles_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles by minutes, with how many jobs each is for."""
    p = profiles.profiles(spark)
    used = B.jobs(spark, sf_dir).groupBy(profiles.nearest_minutes(F.col("target_minutes")).alias("minutes")).agg(F.count("*").alias("jobs"))
    told = p.join(used, "minutes", "left")
    return told.select(F.col("minutes").alias("value"), F.concat("minutes", F.lit(" min")).alias("label"), "style", "description", "target_words", "max_output", "min_output", "transitions", F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs")).orderBy("value")


TRANSITION_CASE = " ".join(f"WHEN '{k}' THEN '" + "|".join(v).replace("'", "''") + "'" for k, v in profiles.STYLE_TRANSITIONS.items())


@query(f"""SELECT job_id, style, CASE style {TRANSITION_CASE} ELSE '' END AS transitions FROM (
SELECT job_id, CASE WHEN m % 6 = 5 THEN 'podcast' WHEN m <= 5 THEN 'headline' WHEN m <= 10 THEN 'brief' WHEN m <= 15 THEN 'standard' ELSE 'comprehensive' END AS style FROM {JOBS})""")
def style_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's transitions by style; a style that isn't known has none."""
    m = F.col("target_minutes")
    jobs = B.jobs(spark, sf_dir).select("job_id", F.when(m % 6 == 5, "podcast").otherwise(profiles.style(m)).alias("style"))
    return profiles.with_transitions(jobs, "style").select("job_id", "style", F.array_join("transitions", "|").alias("transitions"))


# ---- reports and answers


@query(rf"""WITH s AS (SELECT item_id, text, {SENTENCES.format('text')} AS l FROM benchmark), r AS (SELECT item_id,
'TL;DR: ' || l[1] || chr(10) || chr(10) || repeat('=', 60) || chr(10) || 'SUMMARY' || chr(10) || repeat('=', 60) || chr(10) || text || chr(10) || chr(10)
|| repeat('-', 40) || chr(10) || 'KEY TAKEAWAYS' || chr(10) || repeat('-', 40) || chr(10) || array_to_string(list_transform(l[1:3], lambda x, i: '  ' || i || '. ' || x), chr(10)) || chr(10) || chr(10)
|| repeat('-', 40) || chr(10) || 'CHAPTERS' || chr(10) || repeat('-', 40) || chr(10) || chr(10) || '  1. All' || chr(10) || '     ' || text || chr(10) || chr(10)
|| repeat('-', 40) || chr(10) || 'BEST QUOTES' || chr(10) || repeat('-', 40) || chr(10) || '  "' || l[1] || '" — Host' || chr(10) || chr(10)
|| repeat('-', 40) || chr(10) || 'WHO SHOULD WATCH: everyone' || chr(10) || chr(10)
|| repeat('=', 60) || chr(10) || 'Generated by Transcript Summarizer' || chr(10) || repeat('=', 60) AS report FROM s)
SELECT item_id, length(report) AS chars, md5(report) AS digest FROM r""")
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, text = T.sentences(F.col("text")), F.col("text")
    none = F.array().cast("array<string>")
    chapters = F.array(F.struct(F.lit("All").alias("title"), text.alias("text")))
    quotes = F.array(F.struct(F.get(l, F.lit(0)).alias("text"), F.lit("Host").alias("speaker")))
    out = summaries.report(text, F.get(l, F.lit(0)), F.slice(l, 1, 3), chapters, quotes, F.lit("everyone"), F.lit(None).cast("string"), none)
    return B.table(spark, sf_dir, "benchmark").select("item_id", out.alias("r")).select("item_id", F.length("r").cast("long").alias("chars"), F.md5("r").alias("digest"))


@query("SELECT event_id, CAST(event_id % 97 AS INT) AS seconds FROM events")
def regex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delay in messages such as "Please retry in 12.5s"."""
    message = F.concat(F.lit("Quota exceeded. Please retry in "), F.col("event_id") % 97, F.lit(".5s."))
    return B.table(spark, sf_dir, "events").select("event_id", F.regexp_extract(message, r"retry in (\d+(?:\.\d+)?)\s*s", 1).cast("double").cast("int").alias("seconds"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'not json ' || user_id ELSE 's' || user_id END AS summary, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 2 END AS takeaways,
CASE WHEN event_id % 4 = 3 THEN 0 ELSE 2 END AS quotes, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 1 END AS chapters FROM events""")
def json_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as plain JSON, in a fenced block, amid other text, and unreadable ones."""
    body = F.concat(F.lit('{"summary": "s'), F.col("user_id"), F.lit('", "key_takeaways": ["a", "b"], "best_quotes": ["q", {"text": "t", "speaker": "p"}], "chapters": [{"title": "c"}, "x"]}'))
    k = F.col("event_id") % 4
    answer = F.when(k == 0, body).when(k == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure! "), body, F.lit(" Bye"))).otherwise(F.concat(F.lit(" not json "), F.col("user_id")))
    rows = B.table(spark, sf_dir, "events").select("event_id", summaries.tolerant(answer).alias("a"))
    return rows.select("event_id", "a.summary", F.size("a.key_takeaways").alias("takeaways"), F.size("a.best_quotes").alias("quotes"), F.size("a.chapters").alias("chapters"))


@query("""SELECT event_id, CAST(k AS INT) AS k, CASE WHEN k = 0 THEN 'q' || user_id ELSE 't' END AS text, CASE WHEN k = 1 AND event_id % 2 = 0 THEN 'p' ELSE '' END AS speaker, 'c' || event_id AS chapter
FROM (SELECT *, unnest([0, 1]) AS k FROM events)""")
def answer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of answers, given as strings or objects, with or without a speaker; chapters that aren't objects are dropped."""
    speaker = F.when(F.col("event_id") % 2 == 0, F.lit(', "speaker": "p"')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"best_quotes": ["q'), F.col("user_id"), F.lit('", {"text": "t"'), speaker, F.lit('}], "chapters": ["x", {"title": "c'), F.col("event_id"), F.lit('"}]}'))
    rows = B.table(spark, sf_dir, "events").select("event_id", summaries.tolerant(body).alias("a"))
    out = rows.select("event_id", F.get("a.chapters", F.lit(0))["title"].alias("chapter"), F.posexplode("a.best_quotes").alias("k", "q"))
    return out.select("event_id", "k", "q.text", "q.speaker", "chapter")


@query("""SELECT event_id, CAST(s AS DOUBLE) AS start_time, CAST(s + 10 AS DOUBLE) AS end_time, CAST(CASE WHEN k = 0 THEN 0.9 ELSE 0.5 END AS DOUBLE) AS score
FROM (SELECT event_id, k, event_id % 50 + k * 20 AS s FROM (SELECT *, unnest([0, 1]) AS k FROM events WHERE event_id % 5 <> 4))""")
def json_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights of a model's answer: rows need a start and an end; the score is 0.5 if it isn't given."""
    s = F.col("event_id") % 50
    listed = F.concat(F.lit('[{"start": '), s, F.lit(', "end": '), s + 10, F.lit(', "score": 0.9}, {"start": 3}, {"end": 4, "score": 1}, {"start": '), s + 20, F.lit(', "end": '), s + 30, F.lit("}]"))
    answer = F.when(F.col("event_id") % 5 == 4, F.lit("none found")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), listed, F.lit("\n```"))).otherwise(listed)
    rows = B.table(spark, sf_dir, "events").select("event_id", F.explode(summaries.highlight_rows(answer)).alias("h"))
    return rows.select("event_id", F.col("h.start").alias("start_time"), F.col("h.end").alias("end_time"), F.col("h.score").alias("score"))
