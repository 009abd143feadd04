"""Readers of transcripts as sites give them: JSON subtitles, timed text, pages; and of a cache of files."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUBTITLES = "struct<events:array<struct<tStartMs:bigint,dDurationMs:bigint,segs:array<struct<utf8:string>>>>>"
SEGMENTS = "video_id string, segments array<struct<text:string,start:double,end:double>>, full_text string, cached_at string"


def subtitles(rows: DataFrame, key: str, json: str, keep_blank: bool = False, separator: str = "") -> DataFrame:
    """(key, seg_idx, text, start, duration) of JSON subtitles: events with pieces, joined; seconds from milliseconds.

    Blank texts go and others are trimmed, unless `keep_blank`. A missing time is 0.
    """
    events = rows.select(key, F.posexplode(F.from_json(json, SUBTITLES)["events"]).alias("seg_idx", "e")).where("e.segs is not null")
    text = F.array_join(F.transform("e.segs", lambda s: F.coalesce(s["utf8"], F.lit(""))), separator)
    out = events.select(key, "seg_idx", (text if keep_blank else F.trim(text)).alias("text"), (F.coalesce("e.tStartMs", F.lit(0)) / 1000).alias("start"), (F.coalesce("e.dDurationMs", F.lit(0)) / 1000).alias("duration"))
    return out if keep_blank else out.where("text <> ''")


def timed_text(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, seg_idx, text, start, duration) of <text start dur> elements; line breaks become spaces, dur may be missing."""
    found = rows.select(key, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)(<text\b.*?</text>)"), 1)).alias("seg_idx", "x"))
    number = lambda name: F.regexp_extract("x", rf'\b{name}="([0-9.]+)"', 1).try_cast("double")
    body = F.regexp_replace(F.regexp_extract("x", r"(?s)<text[^>]*>(.*?)</text>", 1), "\n", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        body = F.replace(body, F.lit(name), F.lit(sign))
    return found.select(key, "seg_idx", body.alias("text"), F.coalesce(number("start"), F.lit(0.0)).alias("start"), F.coalesce(number("dur"), F.lit(0.0)).alias("duration"))


def last_script(html: Column, marker: str) -> Column:
    """The last of a page's scripts that holds the marker, null if none does."""
    scripts = F.filter(F.regexp_extract_all(html, F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1), lambda s: F.contains(s, F.lit(marker)))
    return F.when(F.size(scripts) > 0, F.element_at(scripts, -1))


def caption_url(html: Column) -> Column:
    """The first caption track's address, from the JSON that a page's player script holds."""
    tracks = F.regexp_extract(last_script(html, "captionTracks"), r'(?s)"captionTracks":\s*(\[.*?\])', 1)
    response = F.regexp_extract(html, r"(?s)ytInitialPlayerResponse\s*=\s*(\{.*?\});", 1)
    path = "$.captions.playerCaptionsTracklistRenderer.captionTracks[0].baseUrl"
    return F.coalesce(F.get_json_object(tracks, "$[0].baseUrl"), F.get_json_object(response, path))


def normalized(rows: DataFrame, key: str) -> DataFrame:
    """(key, seg_idx, text, start, duration, end) of (key, seg_idx, text, start, end): missing text is '', times are 0."""
    start = F.coalesce("start", F.lit(0.0))
    end = F.greatest(F.coalesce("end", start), start)
    return rows.select(key, "seg_idx", F.coalesce("text", F.lit("")).alias("text"), start.alias("start"), (end - start).alias("duration"), end.alias("end"))


def validated(clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) clips (…, start, end): those that end after they begin, and the others with a reason."""
    ok = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    return clips.where(ok), clips.where(~ok).withColumn("reason", F.lit("end is not after start"))


def cached_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """(video_id, segments, full_text, cached_at) of a folder of JSON files, a line for each video."""
    return spark.read.schema(SEGMENTS).json(folder)


def cached_videos(spark: SparkSession, folder: str) -> DataFrame:
    """(key): the videos of such a folder; only that field of a line is parsed."""
    return spark.read.schema("video_id string").json(folder).select(F.col("video_id").alias("key"))


def cached_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(key): the names of a folder's .json files without the ending; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select(F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.json$", "").alias("key"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of `schema` if there is none yet or its files are damaged."""
    try:
        table = spark.read.schema(schema).parquet(path)
        table.count()  # footers only
        return table
    except (PySparkException, Py4JJavaError):
        return spark.createDataFrame([], schema)


def unwrapped(answer: Column) -> Column:
    """Segments (text, start, duration) of a JSON answer: a list as it is, or an object's list `transcript`; else none."""
    kind = "array<struct<text:string,start:double,duration:double>>"
    as_list = F.when(F.ltrim(answer).startswith("["), F.from_json(answer, kind))
    inside = F.when(F.ltrim(answer).startswith("{"), F.from_json(answer, f"transcript {kind}")["transcript"])
    return F.coalesce(as_list, inside, F.array().cast(kind))


def write_cache(rows: DataFrame, folder: str) -> None:
    """Transcripts (as cached_transcripts gives them) as JSON, a line each and many a file, and their texts beside them."""
    rows.write.mode("overwrite").json(f"{folder}/json")
    rows.select("full_text").write.mode("overwrite").text(f"{folder}/text")
