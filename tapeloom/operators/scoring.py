"""Relevance scores of texts: TF-IDF, word overlap, and their mix with likeness to a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import text as T
from tapeloom.functions.stopwords import STOP_WORDS
from tapeloom.session import spread


def terms(text: Column, pairs: bool = True) -> Column:
    """Lower-cased words of two characters or more that aren't stop words, and pairs of neighbours among them."""
    kept = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\b\w\w+\b)"), 1), lambda w: ~w.isin(*STOP_WORDS))
    if not pairs:
        return kept
    return F.concat(kept, F.zip_with(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def tfidf(texts: DataFrame, key: str, place: str, features: int = 500, pairs: bool = True) -> DataFrame:
    """(key, place, tfidf) of texts (key, place, text): the sum of each text's unit-length TF-IDF row.

    The key's `features` most frequent terms count (ties by term). A text without any has 0. All of a key's terms meet in
    one exchange by the key, which windows and sums then share: terms are counted once, and nothing is joined.
    """
    sized = spread(texts.select(key, place, "text"), key).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    counts = sized.select(key, place, "n", F.explode_outer(terms(F.col("text"), pairs)).alias("term")).groupBy(key, place, "term").agg(F.count("term").alias("tf"), F.first("n").alias("n"))
    same = Window.partitionBy(key, "term")
    known = counts.withColumns({"all": F.sum("tf").over(same), "df": F.count("*").over(same)})
    ranked = known.withColumn("k", F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("all"), "term")))  # no term: last
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    weight = ranked.withColumn("w", F.when(F.col("term").isNotNull() & (F.col("k") <= features), F.col("tf") * idf).otherwise(F.lit(0.0)))
    length = F.nullif(F.sqrt(F.sum(F.col("w") * F.col("w"))), F.lit(0.0))
    return weight.groupBy(key, place).agg(F.coalesce(F.sum("w") / length, F.lit(0.0)).alias("tfidf"))


def relative(value: str, key: str) -> Column:
    """A value as a share of its key's greatest; 1 for a key's only row, 0 if the greatest is 0."""
    by = Window.partitionBy(key)
    top = F.max(value).over(by)
    return F.when(F.count("*").over(by) < 2, F.lit(1.0)).otherwise(F.when(top > 0, F.col(value) / top).otherwise(F.lit(0.0)))


def min_max(value: str, key: str) -> Column:
    """A value between its key's least (0) and greatest (1); 0.5 if they are equal or it is missing."""
    by = Window.partitionBy(key)
    low, high = F.min(value).over(by), F.max(value).over(by)
    return F.when(high - low > 1e-9, F.coalesce((F.col(value) - low) / (high - low), F.lit(0.5))).otherwise(F.lit(0.5))


def hybrid(semantic: Column, tfidf_: Column) -> Column:
    return 0.7 * semantic + 0.3 * tfidf_


def overlap(segments: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """(video_id, seg_idx, score): words in common with each sentence of the key's summary (key, sentence), summed; 0 if none.

    A word counts once in a segment and once in a sentence: the rows of both meet by key and word.
    """
    theirs = summaries.select(key, F.explode(T.word_set(F.col("sentence"))).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    ours = segments.select(key, "video_id", "seg_idx", F.explode(T.word_set(F.col("text"))).alias("word"))
    hits = ours.join(theirs, [key, "word"]).groupBy("video_id", "seg_idx").agg(F.sum("n").alias("score"))
    return segments.select("video_id", "seg_idx").join(hits, ["video_id", "seg_idx"], "left").select("video_id", "seg_idx", F.coalesce("score", F.lit(0)).cast("long").alias("score"))
