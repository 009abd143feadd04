"""Duration profiles: what a summary of so many minutes is like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "minutes int, style string, description string, target_words int, words_per_minute int, max_tokens_per_source int, include_examples boolean, include_transitions boolean, "
    "include_sources boolean, include_conflicts boolean, max_topics int, compression_target double, max_output int, min_output int, beams int, length_penalty double, transitions int"
)
# The profiles by minutes, with their generation settings and how many transitions their style has.
PROFILES = (
    (5, "headline", "Quick highlights - key points only", 750, 160, 200, False, False, False, False, 5, 0.05, 300, 80, 2, 1.0, 0),
    (10, "brief", "Brief summary with main ideas", 1500, 150, 400, True, True, False, True, 8, 0.10, 600, 200, 4, 1.5, 4),
    (15, "standard", "Full coverage with examples", 2200, 145, 600, True, True, True, True, 12, 0.15, 900, 350, 4, 2.0, 7),
    (20, "comprehensive", "Deep dive with all details", 2800, 140, 800, True, True, True, True, 15, 0.20, 1024, 450, 4, 2.5, 9),
)
# Transitions between a narrative's paragraphs, in turn.
TRANSITIONS = [
    "Additionally,", "Furthermore,", "Moreover,", "In related terms,", "Building on this,", "Another key point is that", "It's also worth noting that", "Expanding on this idea,",
]


# Transitions by style.
STYLE_TRANSITIONS = {
    "headline": [],
    "brief": ["Also,", "Additionally,", "Furthermore,", "Moreover,"],
    "standard": ["Building on this point,", "In a related vein,", "Expanding further,", "Another key insight is that", "It's also worth noting that", "This connects to", "Looking at another perspective,"],
    "comprehensive": [
        "To elaborate on this concept,", "Diving deeper into this topic,", "From a broader perspective,", "Examining this more closely,", "An important nuance here is that",
        "This raises an interesting point about", "Connecting this to the bigger picture,", "One critical aspect to consider is", "Taking a step back,",
    ],
}


def with_transitions(rows: DataFrame, style: str) -> DataFrame:
    """`rows` with the transitions of their style, an empty list for a style that isn't known."""
    spark = rows.sparkSession
    table = spark.createDataFrame(list(STYLE_TRANSITIONS.items()), "known string, transitions array<string>")
    joined = rows.join(F.broadcast(table), F.col(style) == F.col("known"), "left").drop("known")  # four rows
    return joined.withColumn("transitions", F.coalesce("transitions", F.array().cast("array<string>")))


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, SCHEMA)


def nearest_minutes(minutes: Column) -> Column:
    """The profile nearest to so many minutes, the shorter one of two as near."""
    keys = F.array(*(F.lit(p[0]) for p in PROFILES))
    return F.element_at(F.array_sort(F.transform(keys, lambda k: F.struct(F.abs(k - minutes).alias("off"), k.alias("k")))), 1)["k"]


def style(minutes: Column) -> Column:
    """The style by thresholds, which for some minutes is not that of the nearest profile."""
    return F.when(minutes <= 5, "headline").when(minutes <= 10, "brief").when(minutes <= 15, "standard").otherwise("comprehensive")


def length_bounds(target: Column, least: Column, most: Column) -> tuple[Column, Column]:
    """A model's (min, max) output length for a target in words, within its profile's settings."""
    top = F.least(most, F.greatest((target * 1.3).cast("int"), F.lit(100)))
    low = F.greatest(least, (target * 0.5).cast("int"))
    return F.when(low >= top, F.greatest(F.lit(10), F.floor(top / 2).cast("int"))).otherwise(low), top
