"""Queries that read transcripts from several sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import tables
from tapeloom.session import checkpoint, shared_folder
from tapeloom.sources import bindings as B
from tapeloom.sources import readers, versions

from .registry import SEGMENTS, query


@query("WITH " + SEGMENTS + """ SELECT video_id, count(*) AS segments, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS chars, round(max(start + duration), 3) AS seconds FROM seg GROUP BY video_id""")
def cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts written to a cache, its keys listed and its contents read back."""
    folder = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    one = F.struct("seg_idx", "text", "start", "end")
    by = B.segments(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(one)).alias("s"))
    segments = F.transform("s", lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end")))
    readers.write_cache(by.select("video_id", segments.alias("segments"), F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("full_text"), F.lit("2024-01-01").alias("cached_at")), folder)
    listed = readers.cached_videos(spark, f"{folder}/json").join(readers.cached_transcripts(spark, f"{folder}/json"), F.col("key") == F.col("video_id"))
    last = F.round(F.array_max(F.transform("segments", lambda x: x["end"])), 3)
    out = checkpoint(listed.select("video_id", F.size("segments").cast("long").alias("segments"), F.length("full_text").cast("long").alias("chars"), last.alias("seconds")))
    versions.delete(spark, folder)
    return out


@query("WITH " + SEGMENTS + " SELECT video_id, seg_idx, text, start FROM seg WHERE video_id = '7'")
def transcript_lookup(spark: SparkSession, sf_dir: str, video: int = 7) -> DataFrame:
    """One video's transcript; the filter reaches the Parquet scan."""
    turns = B.table(spark, sf_dir, "conversations").where(F.col("conv_id") == video)
    return B.timed(turns).select("video_id", "seg_idx", "text", "start")


@query("""SELECT CAST(conv_id AS VARCHAR) AS video_id, CASE WHEN conv_id % 3 <> 0 THEN 1 WHEN conv_id % 2 = 0 THEN 2 ELSE 3 END AS tier, CASE WHEN conv_id % 3 <> 0 THEN 'api' WHEN conv_id % 2 = 0 THEN 'download' ELSE 'speech' END AS source,
count(*) AS segments FROM conversations GROUP BY conv_id""")
def tier_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three sources that has a video's transcript."""
    turns = B.table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("video_id"), "turn")
    has = (("api", "conv_id % 3 <> 0"), ("download", "conv_id % 2 = 0"), ("speech", "true"))
    best = tables.first_source([turns.where(c).withColumn("source", F.lit(n)) for n, c in has], "video_id")
    return best.groupBy("video_id", "tier", "source").agg(F.count("*").alias("segments"))


PRIORITY = "CASE WHEN lang = 'en' AND doc_id % 3 = 0 THEN 1 WHEN lang = 'en' THEN 2 WHEN doc_id % 5 <> 0 THEN 3 ELSE 4 END"


@query(f"SELECT source AS video_id, doc_id, lang, p AS priority FROM (SELECT *, {PRIORITY} AS p, row_number() OVER (PARTITION BY source ORDER BY {PRIORITY}, doc_id) AS k FROM documents) WHERE k = 1")
def language_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual English, else generated English, else translatable, else as it is: the first of each video, combined before the shuffle."""
    d = B.table(spark, sf_dir, "documents").select(F.col("source").alias("video_id"), "doc_id", "lang", F.expr(PRIORITY).alias("priority"))
    best = F.min(F.struct("priority", "doc_id", "lang")).alias("b")
    return d.groupBy("video_id").agg(best).select("video_id", "b.doc_id", "b.lang", "b.priority")


PLACED = "CAST(row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) - 1 AS INT) AS place"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, json): segments written as JSON subtitles, a line a piece, every fifth event without pieces."""
    ms = lambda c: (F.col(c) * 1000).cast("long")
    pieces = F.when(F.col("seg_idx") % 5 != 4, F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("utf8"))))
    event = F.struct("seg_idx", ms("start").alias("tStartMs"), ms("duration").alias("dDurationMs"), pieces.alias("segs"))
    return B.segments(spark, sf_dir).groupBy("video_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(event)).alias("events"))).alias("json"))


def _placed(rows: DataFrame) -> DataFrame:
    found = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "text", "start", "duration"))).alias("s"))
    return found.select("video_id", F.posexplode("s").alias("place", "s")).select("video_id", "place", "s.seg_idx", "s.text", "s.start", "s.duration")


@query("WITH " + SEGMENTS + rf""" SELECT video_id, {PLACED}, seg_idx, trim(replace(text, chr(10), '')) AS text, start, duration
FROM seg WHERE seg_idx % 5 <> 4 AND trim(replace(text, chr(10), '')) <> ''""")
def json_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON subtitles: events with pieces, joined and trimmed, blank ones left out."""
    return _placed(readers.subtitles(_files(spark, sf_dir), "video_id", "json"))


@query("WITH " + SEGMENTS + rf""" SELECT video_id, {PLACED}, seg_idx, replace(text, chr(10), '') AS text, start, duration FROM seg WHERE seg_idx % 5 <> 4""")
def json_subtitles_untrimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with texts as they are, blank ones too."""
    return _placed(readers.subtitles(_files(spark, sf_dir), "video_id", "json", keep_blank=True))


@query("WITH " + SEGMENTS + rf""" SELECT video_id, {PLACED}, seg_idx, trim(replace(text, chr(10), ' ')) AS text, start, duration
FROM seg WHERE seg_idx % 5 <> 4 AND trim(replace(text, chr(10), ' ')) <> ''""")
def json_subtitles_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with spaces between an event's pieces."""
    return _placed(readers.subtitles(_files(spark, sf_dir), "video_id", "json", separator=" "))


@query("WITH " + SEGMENTS + """ SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY seg_idx) - 1 AS INT) AS seg_idx, replace(text, chr(10), ' ') AS text, start, CASE WHEN seg_idx % 3 = 2 THEN 0.0 ELSE duration END AS duration FROM seg""")
def timed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments written as timed text, every third without a duration, and read again: line breaks are spaces."""
    text = F.col("text")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    dur = F.when(F.col("seg_idx") % 3 == 2, "").otherwise(F.concat(F.lit(' dur="'), F.col("duration").cast("decimal(18,3)"), F.lit('"')))
    element = F.struct("seg_idx", F.concat(F.lit('<text start="'), F.col("start").cast("decimal(18,3)"), F.lit('"'), dur, F.lit(">"), text, F.lit("</text>")).alias("x"))
    files = B.segments(spark, sf_dir).groupBy("video_id").agg(F.array_sort(F.collect_list(element)).alias("e"))
    xml = F.concat(F.lit("<transcript>"), F.array_join(F.transform("e", lambda e: e["x"]), ""), F.lit("</transcript>"))
    return readers.timed_text(files.select("video_id", xml.alias("xml")), "video_id", "xml")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://captions/' || page_id WHEN page_id % 3 = 1 THEN 'https://player/' || page_id END AS url FROM pages""")
def caption_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first caption track's address in a page's scripts (the last that lists tracks), else in its player response."""
    k = F.col("page_id")
    track = lambda host: F.concat(F.lit('[{"baseUrl": "https://'), F.lit(host), F.lit("/"), k, F.lit('"}, {"baseUrl": "second"}]'))
    script = F.concat(F.lit('<script>old = {"captionTracks": []}</script><script>p = {"captionTracks": '), track("captions"), F.lit("};</script>"))
    player = F.concat(F.lit('<div>ytInitialPlayerResponse = {"captions": {"playerCaptionsTracklistRenderer": {"captionTracks": '), track("player"), F.lit("}}};</div>"))
    page = F.concat("html", F.when(k % 3 == 0, script).when(k % 3 == 1, player).otherwise(F.lit("")))
    return B.table(spark, sf_dir, "pages").select("page_id", readers.caption_url(page).alias("url"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 2 END AS segments, CASE WHEN event_id % 4 <> 3 THEN 'a' || user_id END AS first_text FROM events""")
def transcript_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are a list of segments or an object that holds one; others have none."""
    k = F.col("event_id") % 4
    listed = F.concat(F.lit('[{"text": "a'), F.col("user_id"), F.lit('", "start": 0, "duration": 1.5}, {"text": "b", "start": 2}]'))
    answer = F.when(k == 0, listed).when(k == 3, F.lit('{"error": "none"}')).otherwise(F.concat(F.lit('{"transcript": '), listed, F.lit(', "cached": true}')))
    rows = B.table(spark, sf_dir, "events").select("event_id", readers.unwrapped(answer).alias("s"))
    return rows.select("event_id", F.size("s").alias("segments"), F.get("s", F.lit(0))["text"].alias("first_text"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS video_id, CASE WHEN conv_id % 5 = 0 THEN 1 WHEN conv_id % 3 = 0 THEN 2 WHEN conv_id % 2 = 0 THEN 3 ELSE 4 END AS tier, count(*) AS segments FROM conversations GROUP BY conv_id""")
def tier_fallback_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of four sources that has a video's transcript: interface, download, page, speech."""
    turns = B.table(spark, sf_dir, "conversations").select("conv_id", F.col("conv_id").cast("string").alias("video_id"), "turn")
    best = tables.first_source([turns.where(c) for c in ("conv_id % 5 = 0", "conv_id % 3 = 0", "conv_id % 2 = 0", "true")], "video_id")
    return best.groupBy("video_id", "tier").agg(F.count("*").alias("segments"))


@query(r"""WITH s AS (SELECT page_id, html, list_filter(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), lambda x: contains(x, 'track(')) AS l FROM pages)
SELECT page_id, CAST(regexp_extract(l[len(l)], 'track\((\d+)\)', 1) AS BIGINT) AS track, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM s WHERE len(l) > 0""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value between two markers in the last script that holds the first one, and the title."""
    script = readers.last_script(F.col("html"), "track(")
    pages = B.table(spark, sf_dir, "pages").select("page_id", script.alias("s"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title")).where("s is not null")
    return pages.select("page_id", F.regexp_extract("s", r"track\((\d+)\)", 1).cast("long").alias("track"), "title")


@query("WITH " + SEGMENTS + """ SELECT video_id, seg_idx, CASE WHEN seg_idx % 6 = 5 THEN '' ELSE text END AS text, start, CASE WHEN seg_idx % 7 = 6 THEN 0.0 ELSE duration END AS duration FROM seg""")
def segment_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with missing texts and ends."""
    raw = B.segments(spark, sf_dir).select("video_id", "seg_idx", F.when(F.col("seg_idx") % 6 != 5, F.col("text")).alias("text"), "start", F.when(F.col("seg_idx") % 7 != 6, F.col("end")).alias("end"))
    return readers.normalized(raw, "video_id").select("video_id", "seg_idx", "text", "start", "duration")


@query("WITH " + SEGMENTS + """, c AS (SELECT video_id, seg_idx, start, CASE WHEN seg_idx % 3 = 2 THEN start - 1 ELSE start + duration END AS stop FROM seg)
SELECT video_id, seg_idx, stop > start AS ok, CASE WHEN stop > start THEN NULL ELSE 'end is not after start' END AS reason FROM c""")
def segment_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips, every third of which ends before it begins."""
    clips = B.segments(spark, sf_dir).select("video_id", "seg_idx", "start", F.when(F.col("seg_idx") % 3 == 2, F.col("start") - 1).otherwise(F.col("end")).alias("end"))
    good, bad = readers.validated(clips)
    a = good.select("video_id", "seg_idx", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"))
    return a.unionByName(bad.select("video_id", "seg_idx", F.lit(False).alias("ok"), "reason"))
