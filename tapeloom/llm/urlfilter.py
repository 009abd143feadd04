"""URL filters by a temporal list join.

A block list is a log of dated entries: on a date, a domain is added to a category or removed from it. The entries of a
domain and category become validity intervals. A capture is held against the list as it was when it was fetched: the
URL's host and its parent domains are looked up, and an entry counts if the fetch time lies in its interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a year's slice: intervals and captures also meet by slice, so a much listed domain is searched in one only.
SLICE_DAYS = 365
FOREVER = "9999-12-31"


def host(url: Column) -> Column:
    """The host, lower-cased, without user, port and a final dot; null if there is none."""
    found = F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.nullif(F.lower(F.rtrim(found, F.lit("."))), F.lit(""))


def domains(host_: Column) -> Column:
    """The host and its parent domains of two labels or more, longest first; [null] for a null host."""
    labels = F.split(host_, r"\.")
    n = F.size(labels)
    return F.when(host_.isNull(), F.array(F.lit(None).cast("string"))).when(n < 2, F.array(host_)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, category, valid_from, valid_to), end exclusive, of entries' (domain, category, day, action).

    Of the entries of one day for a domain and category, a removal counts last. An entry holds until the next one; only
    additions give intervals, and touching ones are one. Rows with a null domain, category or day don't count.
    """
    log = entries.where("domain is not null and category is not null and day is not null").select(F.lower("domain").alias("domain"), "category", F.col("day").cast("date").alias("day"), (F.col("action") == "add").alias("on"))
    daily = log.groupBy("domain", "category", "day").agg(F.min("on").alias("on"))
    by = Window.partitionBy("domain", "category").orderBy("day")
    changes = daily.withColumn("was", F.coalesce(F.lag("on").over(by), F.lit(False))).where("on <> was")
    spans = changes.withColumn("valid_to", F.coalesce(F.lead("day").over(by), F.lit(FOREVER).cast("date"))).where("on")
    return spans.select("domain", "category", F.col("day").alias("valid_from"), "valid_to")


def filtered(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, host, fetched, blocked, domain, category, valid_from) for every row of captures' (key, url, fetched).

    Of several entries in force, the longest domain counts, then the category that is first by name. A null or odd URL
    has a null host and isn't blocked; neither is a capture with a null fetch date. Repeated captures are looked up once
    and keep their rows. Without entries nothing is blocked; no captures give no rows.
    """
    spans = intervals(entries)
    number = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / SLICE_DAYS)
    last = spans.agg(F.max("valid_from").alias("d")).select(F.greatest("d", F.lit("1970-01-01").cast("date")).alias("d")).first()["d"]
    seen = captures.select(key, host(F.col("url")).alias("host"), F.col("fetched").cast("date").alias("fetched"))
    seen = seen.groupBy(key, "host", "fetched").agg(F.count("*").cast("int").alias("copies"))
    # captures after the last entry look it up in its slice: nothing changes later
    at = F.least(number(F.col("fetched")), number(F.lit(last)))
    asked = seen.select(key, "host", "fetched", "copies", at.alias("slice"), F.posexplode(domains(F.col("host"))).alias("place", "domain"))
    kept = spans.withColumn("slice", F.explode(F.sequence(number(F.col("valid_from")), F.least(number(F.date_sub("valid_to", 1)), number(F.lit(last))))))
    hits = asked.join(kept, ["domain", "slice"], "left").withColumn("hit", F.col("fetched").between(F.col("valid_from"), F.date_sub("valid_to", 1)))
    best = F.min(F.when(F.col("hit"), F.struct("place", "category", "domain", "valid_from"))).alias("best")
    found = hits.groupBy(key, "host", "fetched").agg(best, F.max("copies").alias("copies"))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return found.select(key, "host", "fetched", F.col("best").isNotNull().alias("blocked"), "best.domain", "best.category", "best.valid_from")
