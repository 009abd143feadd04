"""Changes to tables as new tables: upsert, update, delete, and checks before an insert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.session import checkpoint

def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose key `new` doesn't have."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def update(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the non-null values of `new` (key and some of its columns); keys that `old` lacks are ignored."""
    changed = [c for c in new.columns if c != key]
    sent = new.select(key, *(F.col(c).alias(f"__{c}") for c in changed))
    return old.join(sent, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in old.columns))


def delete_first(rows: DataFrame, keys: list[str], order: list[str], match: Column) -> DataFrame:
    """`rows` less the first matching one of each key."""
    by = Window.partitionBy(*keys, match).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(by)).where(~match | (F.col("__k") > 1)).drop("__k")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, combined before the shuffle."""
    kept = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("r")).select(key, "r.*")


def last_values(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """(key, *fields): each field's last value that isn't null, in a log of changes."""
    at = F.struct(*order)
    return log.groupBy(key).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields))


def taken(new: DataFrame, existing: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, *taken_<field>): of new rows, whether a field's value exists already; a lookup for each field, not one by OR."""
    out = new.select(key, *fields)
    for f in fields:
        known = existing.select(F.col(f)).where(F.col(f).isNotNull()).distinct().withColumn(f"taken_{f}", F.lit(True))
        out = out.join(known, f, "left")
    return out.select(key, *(F.coalesce(f"taken_{f}", F.lit(False)).alias(f"taken_{f}") for f in fields))


def user_error(username: Column, email: Column, password: Column, role: Column) -> Column:
    """What is wrong with a new user's fields, the first of: something is missing, the address, the password; else null."""
    missing = F.lit(False)
    for c in (username, email, password, role):
        missing = missing | (F.coalesce(c, F.lit("")) == "")
    shape = email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
    return F.when(missing, "missing_fields").when(~shape, "bad_email").when(F.length(password) < 6, "short_password")


def first_source(sources: list[DataFrame], key: str) -> DataFrame:
    """Of sources in order of preference, all rows of the first one that has a key, with tier from 1.

    A cascade: a later source gives only rows of keys that no earlier one has, so only those are worked on further.
    """
    out = sources[0].withColumn("tier", F.lit(1))
    known = sources[0].select(key).distinct()
    for i, source in enumerate(sources[1:], 2):
        rest = source.join(known, key, "left_anti")
        out = out.unionByName(rest.withColumn("tier", F.lit(i)))
        known = known.unionByName(rest.select(key).distinct())
    return out


#: What a change comes to: nothing asked, no difference, values replaced, a row added, a row gone, no such row.
KEPT, MATCHED, MODIFIED, INSERTED, DELETED, UNKNOWN = "kept", "matched", "modified", "inserted", "deleted", "unknown"


def merge(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """All rows of `old` and `changes` by key, with their values afterwards and `outcome`; `merged` has the new table.

    changes: (key, action, some of the columns), one row a key; action `set` replaces values that aren't null where there
    is such a row, `upsert` adds one where there is none, `delete` takes it away. `set` and `delete` of a key that `old`
    lacks are `unknown`; a `set` that changes nothing is `matched`. The join keeps both sides, so table and counts come
    from one pass.
    """
    fields = [c for c in changes.columns if c not in (key, "action")]
    there = old.withColumn("__there", F.lit(True))
    sent = changes.select(key, F.col("action").alias("__action"), *(F.col(c).alias(f"__{c}") for c in fields))
    both = there.join(sent, key, "full_outer")
    is_, action = F.col("__there").isNotNull(), F.col("__action")
    differs = F.lit(False)
    for c in fields:
        differs = differs | (F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)))
    outcome = (
        F.when(action.isNull(), KEPT).when(is_ & (action == "delete"), DELETED).when(is_, F.when(differs, MODIFIED).otherwise(MATCHED)).when(action == "upsert", INSERTED).otherwise(UNKNOWN)
    )
    deleted = is_ & F.coalesce(action == "delete", F.lit(False))
    return both.select(*(F.when(deleted, F.col(c)).otherwise(F.coalesce(f"__{c}", c)).alias(c) if c in fields else F.col(c) for c in old.columns), outcome.alias("outcome"))


def merged(tagged: DataFrame) -> DataFrame:
    """The table after a `merge`."""
    return tagged.where(F.col("outcome").isin(KEPT, MATCHED, MODIFIED, INSERTED)).drop("outcome")


def merge_counts(tagged: DataFrame) -> DataFrame:
    """(matched, modified, inserted, deleted, unknown) of a `merge`: one row. Modified rows count as matched too."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return tagged.agg(n(MATCHED, MODIFIED, DELETED).alias("matched"), n(MODIFIED).alias("modified"), n(INSERTED).alias("inserted"), n(DELETED).alias("deleted"), n(UNKNOWN).alias("unknown"))


def nearest(rows: DataFrame, known: DataFrame, value: str, slots: int | None = None) -> DataFrame:
    """`rows` with `nearest`: the one of known's values (value) that is nearest to their own, the smaller of two as near.

    Both may be large. Values that aren't between known ones have the least or the greatest of these. The others and the
    known ones are dealt out by ranges that hold about as many each (as many ranges as shuffles have partitions), in each
    of which the last and the next known value are carried along in order; what comes from other ranges follows from their
    least and greatest values. Null where there is nothing known, or the row's own value is null.
    """
    slots = slots or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = known.select(F.col(value).cast("double").alias("__k")).where("__k is not null").distinct()
    ends = checkpoint(keys.agg(F.min("__k").alias("__low"), F.max("__k").alias("__high")))  # one row
    own = rows[value].cast("double")
    asked = rows.select(own.alias("__v")).crossJoin(F.broadcast(ends)).where("__v > __low and __v < __high").select("__v").distinct()  # a value that many rows have counts once
    both = asked.select("__v", F.lit(None).cast("double").alias("__k")).unionByName(keys.select(F.col("__k").alias("__v"), "__k"))
    dealt = checkpoint(both.repartitionByRange(slots, "__v").withColumn("__slot", F.spark_partition_id()))  # kept: ranges come from samples
    tie = F.col("__k").isNull()  # known values before asked ones of the same value
    up = Window.partitionBy("__slot").orderBy("__v", tie).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("__slot").orderBy(F.desc("__v"), tie).rowsBetween(Window.unboundedPreceding, 0)
    near = dealt.select("*", F.last("__k", True).over(up).alias("__below"), F.last("__k", True).over(down).alias("__above")).where("__k is null")
    filled = dealt.groupBy("__slot").agg(F.min("__k").alias("lo"), F.max("__k").alias("hi"))  # a row for each slot
    before, after = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("__slot")).rowsBetween(Window.unboundedPreceding, -1)
    carried = filled.select("__slot", F.last("hi", True).over(before).alias("__from"), F.last("lo", True).over(after).alias("__to"))
    met = near.join(F.broadcast(carried), "__slot", "left")
    below, above = F.coalesce("__below", "__from"), F.coalesce("__above", "__to")
    found = met.select("__v", F.when(F.col("__v") - below <= above - F.col("__v"), below).otherwise(above).alias("__near"))
    joined = rows.join(found, own == found["__v"], "left").crossJoin(F.broadcast(ends))
    pick = F.when(own <= F.col("__low"), F.col("__low")).when(own >= F.col("__high"), F.col("__high")).otherwise(F.col("__near"))
    return joined.withColumn("nearest", pick).drop("__v", "__near", "__low", "__high")


def evict(entries: DataFrame, most: int, cutoff: Column) -> DataFrame:
    """`entries` (id, size, last_accessed) with evicted: older than `cutoff`, or oldest first until `most` bytes remain.

    An entry goes if the total less the sizes of older ones is over `most`. Older sizes are summed within days and over
    the days before, so that no task holds all entries.
    """
    total = entries.agg(F.sum("size").alias("total"))  # one row
    dated = entries.withColumn("day", F.to_date("last_accessed"))
    days = dated.groupBy("day").agg(F.sum("size").alias("n"))
    before = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each day
    inside = Window.partitionBy("day").orderBy("last_accessed", "id").rowsBetween(Window.unboundedPreceding, -1)
    run = dated.withColumn("older", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(before, "day").crossJoin(total)
    gone = (F.col("last_accessed") < cutoff) | (F.col("total") - F.col("base") - F.col("older") > most)
    return run.select("id", "size", "last_accessed", gone.alias("evicted"))
