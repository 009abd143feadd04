"""Queries over activity history, users and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators import folds, tables
from tapeloom.sources import bindings as B

from .registry import query

HISTORY = """h AS (SELECT event_id, CAST(user_id AS VARCHAR) AS username, event_type AS type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS video_id, value, ts FROM events)"""
WINDOW_S, MOST = 7 * 86400.0, 10


@query("SELECT c_name AS username, 'user' || c_custkey || '@mail' AS email, c_mktsegment AS role FROM customer")
def users_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.users(spark, sf_dir).drop("secret", "user_key")


@query("SELECT c_name AS username FROM customer WHERE contains(lower(c_name), '00001') OR contains(lower('user' || c_custkey || '@mail'), 'r12')")
def user_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c, what: F.coalesce(F.contains(F.lower(c), F.lit(what)), F.lit(False))
    return B.users(spark, sf_dir).where(has("username", "00001") | has("email", "r12")).select("username")


@query("SELECT c_name AS username, c_mktsegment AS role FROM customer WHERE c_mktsegment = 'BUILDING'")
def role_filter(spark: SparkSession, sf_dir: str, role: str = "BUILDING") -> DataFrame:
    """Users of one role."""
    return B.users(spark, sf_dir).where(F.col("role") == role).select("username", "role")


@query(r"""WITH n AS (SELECT c_custkey AS user_key, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS username, CASE c_custkey % 5 WHEN 0 THEN 'user' || c_custkey || '@mail' WHEN 1 THEN 'user ' || c_custkey || '@mail.org' WHEN 2 THEN '' ELSE 'user' || c_custkey || '@mail.org' END AS email, repeat('p', CAST(c_custkey % 11 AS INT)) AS password, c_mktsegment AS role FROM customer)
SELECT user_key, CASE WHEN coalesce(username, '') = '' OR email = '' OR password = '' OR coalesce(role, '') = '' THEN 'missing_fields' WHEN NOT regexp_full_match(email, '[^\s@]+@[^\s@]+\.[^\s@]+') THEN 'bad_email' WHEN length(password) < 6 THEN 'short_password' END AS error FROM n""")
def user_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New users' fields: all there, an address of the right shape, a password of six characters or more."""
    k = F.col("user_key")
    mail = F.when(k % 5 == 0, F.concat(F.lit("user"), k, F.lit("@mail"))).when(k % 5 == 1, F.concat(F.lit("user "), k, F.lit("@mail.org"))).when(k % 5 == 2, F.lit("")).otherwise(F.concat(F.lit("user"), k, F.lit("@mail.org")))
    rows = B.users(spark, sf_dir).select("user_key", F.when(k % 7 != 0, F.col("username")).alias("username"), mail.alias("email"), F.repeat(F.lit("p"), (k % 11).cast("int")).alias("password"), "role")
    return rows.select("user_key", tables.user_error(*(F.col(c) for c in ("username", "email", "password", "role"))).alias("error"))


@query("WITH " + HISTORY + " SELECT username, count(*) AS rows_after, count(DISTINCT event_id) AS distinct_events FROM (SELECT * FROM h UNION ALL SELECT * FROM h WHERE type = 'click') GROUP BY 1")
def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History with rows appended; an insert doesn't look for equal ones."""
    h = B.history(spark, sf_dir)
    rows = h.unionByName(h.where("type = 'click'"))
    return rows.groupBy("username").agg(F.count("*").alias("rows_after"), F.countDistinct("event_id").alias("distinct_events"))


@query("WITH " + HISTORY + " SELECT event_id, username, video_id, CAST(row_number() OVER (PARTITION BY username ORDER BY event_id DESC) AS INT) AS place FROM h WHERE type = 'click'")
def history_filter(spark: SparkSession, sf_dir: str, kind: str = "click") -> DataFrame:
    """A user's events of one kind ('all': any), the last one first."""
    rows = B.history(spark, sf_dir).where((F.lit(kind) == "all") | (F.col("type") == kind))
    return rows.select("event_id", "username", "video_id", F.row_number().over(Window.partitionBy("username").orderBy(F.desc("event_id"))).alias("place"))


KINDS = ("view", "click", "purchase", "signup", "error")


@query("WITH " + HISTORY + " SELECT username, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE type = '{k}') AS {k}" for k in KINDS) + " FROM h GROUP BY username")
def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.history(spark, sf_dir).groupBy("username").agg(F.count("*").alias("total"), *(F.count_if(F.col("type") == k).alias(k) for k in KINDS))


@query("WITH " + HISTORY + " SELECT h.event_id, h.type, c.c_name AS name, c.c_mktsegment AS role FROM h JOIN customer c ON h.username = CAST(c.c_custkey AS VARCHAR)")
def history_with_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = B.users(spark, sf_dir).select(F.col("user_key").cast("string").alias("username"), F.col("username").alias("name"), "role")
    return B.history(spark, sf_dir).join(users, "username").select("event_id", "type", "name", "role")


@query("WITH " + HISTORY + r""", old AS (SELECT username, arg_max(event_id, (ts, event_id)) AS event_id FROM h WHERE event_id % 2 = 0 GROUP BY 1),
new AS (SELECT username, arg_max(event_id, (ts, event_id)) AS event_id FROM h WHERE event_id % 4 = 1 GROUP BY 1)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE username NOT IN (SELECT username FROM new)""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of users' latest events, and later rows that replace or add some."""
    h = B.history(spark, sf_dir).select("username", "event_id", "timestamp")
    side = lambda keep: tables.latest(h.where(keep), "username", ["timestamp", "event_id"]).select("username", "event_id")
    return tables.upsert(side("event_id % 2 = 0"), side("event_id % 4 = 1"), "username")


@query("SELECT c_custkey AS user_key, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' ELSE c_name END AS username, CASE WHEN c_custkey % 6 = 0 THEN 'ADMIN' ELSE c_mktsegment END AS role FROM customer")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = B.users(spark, sf_dir).select("user_key", "username", "role")
    new = old.where("user_key % 3 = 0").select("user_key", F.concat("username", F.lit("!")).alias("username"), F.when(F.col("user_key") % 6 == 0, "ADMIN").alias("role"))
    return tables.update(old, new, "user_key")


CHANGES = """c AS (
  SELECT CASE WHEN n % 6 IN (3, 4, 5) AND n % 2 = 1 THEN -k ELSE k END AS user_key, CASE n % 6 WHEN 0 THEN 'delete' WHEN 1 THEN 'set' WHEN 2 THEN 'set' WHEN 3 THEN 'upsert' WHEN 4 THEN 'upsert' ELSE CASE WHEN n % 4 = 1 THEN 'set' ELSE 'delete' END END AS action,
         CASE WHEN n % 6 IN (1, 4) THEN 'ADMIN' END AS role, CASE WHEN n % 6 = 3 THEN 'new' || k END AS username
  FROM (SELECT o_custkey AS k, max(o_orderkey) AS n FROM orders GROUP BY 1)),
m AS (
  SELECT coalesce(u.c_custkey, c.user_key) AS user_key, u.c_custkey IS NOT NULL AS there, c.action, coalesce(c.username, u.c_name) AS username, coalesce(c.role, u.c_mktsegment) AS role,
         c.role IS NOT NULL AND c.role IS DISTINCT FROM u.c_mktsegment OR c.username IS NOT NULL AND c.username IS DISTINCT FROM u.c_name AS differs
  FROM customer u FULL JOIN c ON c.user_key = u.c_custkey)"""


def _merged_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and changes to them, one for each user with orders: what it does follows from the last order's number."""
    n, k = F.col("n"), F.col("k")
    asked = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("n"))
    kinds = F.array(*map(F.lit, ("delete", "set", "set", "upsert", "upsert")))
    action = F.coalesce(F.get(kinds, n % 6), F.when(n % 4 == 1, "set").otherwise("delete"))
    key = F.when((n % 6).isin(3, 4, 5) & (n % 2 == 1), -k).otherwise(k)  # a negative one is nobody's yet
    changes = asked.select(key.alias("user_key"), action.alias("action"), F.when((n % 6).isin(1, 4), "ADMIN").alias("role"), F.when(n % 6 == 3, F.concat(F.lit("new"), k)).alias("username"))
    return tables.merge(B.users(spark, sf_dir).select("user_key", "username", "role"), changes, "user_key")


@query("WITH " + CHANGES + " SELECT user_key, username, role FROM m WHERE action IS NULL OR (there AND action <> 'delete') OR (NOT there AND action = 'upsert')")
def user_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users after replacements, additions and deletions by key."""
    return tables.merged(_merged_users(spark, sf_dir))


@query("WITH " + CHANGES + """ SELECT count(*) FILTER (WHERE there AND action IS NOT NULL) AS matched, count(*) FILTER (WHERE there AND action <> 'delete' AND differs) AS modified, count(*) FILTER (WHERE NOT there AND action = 'upsert') AS inserted,
count(*) FILTER (WHERE there AND action = 'delete') AS deleted, count(*) FILTER (WHERE NOT there AND action <> 'upsert') AS unknown FROM m""")
def user_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of those changes met a user, changed one, added or took one away, or named an unknown one."""
    return tables.merge_counts(_merged_users(spark, sf_dir))


@query(r"""WITH k AS (SELECT DISTINCT CAST(p_retailprice AS DOUBLE) AS p FROM part), o AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) / 100 AS price FROM orders),
below AS (SELECT o_orderkey, price, k.p AS b FROM o ASOF LEFT JOIN k ON o.price >= k.p), both_ AS (SELECT x.*, k.p AS a FROM below x ASOF LEFT JOIN k ON x.price <= k.p)
SELECT o_orderkey, price, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN price - b <= a - price THEN b ELSE a END AS nearest FROM both_""")
def nearest_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For a hundredth of each order's total, the nearest price of a part, the smaller of two as near."""
    orders = B.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") / 100).alias("price"))
    return tables.nearest(orders, B.table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("price")), "price")


@query("WITH " + HISTORY + " SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY username, type = 'error' ORDER BY ts, event_id) AS k FROM h) WHERE type <> 'error' OR k > 1")
def delete_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History less each user's first error."""
    return tables.delete_first(B.history(spark, sf_dir), ["username"], ["timestamp", "event_id"], F.col("type") == "error").select("event_id")


@query("WITH " + HISTORY + " SELECT username, count(*) FILTER (WHERE type = 'view') AS deleted, count(*) FILTER (WHERE type <> 'view') AS remaining FROM h GROUP BY 1")
def delete_many_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.col("type") == "view"
    return B.history(spark, sf_dir).groupBy("username").agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("remaining"))


@query(r"""WITH n AS (SELECT c_custkey AS user_key, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || 'x' END AS username, CASE WHEN c_custkey % 3 = 0 THEN 'user' || (c_custkey + 1) || '@mail' ELSE 'none' || c_custkey END AS email FROM customer)
SELECT user_key, username IN (SELECT c_name FROM customer) AS taken_username, email IN (SELECT 'user' || c_custkey || '@mail' FROM customer) AS taken_email FROM n""")
def duplicate_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New users, some under names and addresses that exist."""
    old = B.users(spark, sf_dir)
    k = F.col("user_key")
    name = F.when(k % 2 == 0, F.col("username")).otherwise(F.concat("username", F.lit("x")))
    mail = F.when(k % 3 == 0, F.concat(F.lit("user"), k + 1, F.lit("@mail"))).otherwise(F.concat(F.lit("none"), k))
    return tables.taken(old.select("user_key", name.alias("username"), mail.alias("email")), old, "user_key", ["username", "email"])


@query("WITH " + HISTORY + " SELECT username, video_id, count(*) AS n, min(event_id) AS first_seen FROM h GROUP BY 1, 2")
def distinct_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's videos with where they were first seen, which is their order."""
    return B.history(spark, sf_dir).groupBy("username", "video_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen"))


@query("WITH " + HISTORY + " SELECT username, string_agg(v, ',' ORDER BY v) AS selected FROM (SELECT username, v, count(*) AS n FROM (SELECT username, 'v' || event_id % 5 AS v FROM h) GROUP BY 1, 2) WHERE n % 2 = 1 GROUP BY 1")
def array_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that select a video or take it back: what was clicked an odd number of times is selected, in whatever order."""
    h = B.history(spark, sf_dir).select("username", F.concat(F.lit("v"), F.col("event_id") % 5).alias("v"))
    odd = h.groupBy("username", "v").agg(F.count("*").alias("n")).where("n % 2 = 1")
    return odd.groupBy("username").agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("selected"))


REQUESTS = """r AS (SELECT CAST(user_id AS VARCHAR) AS client, event_id AS request_id, epoch(ts) AS t FROM events)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.history(spark, sf_dir).select(F.col("username").alias("client"), F.col("event_id").alias("request_id"), (F.unix_micros("timestamp") / 1e6).alias("t"))


@query("WITH RECURSIVE " + REQUESTS + r""", o AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY t, request_id) AS i FROM r),
walk AS (
  SELECT client, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS request_id, CAST([] AS DOUBLE[]) AS times, false AS allowed FROM (SELECT DISTINCT client FROM o)
  UNION ALL
  SELECT x.client, x.i, x.request_id, CASE WHEN len(x.recent) < 10 THEN list_append(x.recent, x.t) ELSE x.recent END, len(x.recent) < 10
  FROM (SELECT o.*, list_filter(w.times, lambda y: y > o.t - 604800.0) AS recent FROM walk w JOIN o ON o.client = w.client AND o.i = w.i + 1) x)
SELECT client, request_id, allowed FROM walk WHERE i > 0""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten requests a week and client; rejected ones don't count."""
    return folds.rate_limit(_requests(spark, sf_dir), WINDOW_S, MOST)


@query("WITH " + REQUESTS + " SELECT client, request_id, count(*) OVER (PARTITION BY client ORDER BY CAST(floor(t) AS BIGINT) RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS recent FROM r")
def rate_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests of the week before each one, rejected ones too."""
    by = Window.partitionBy("client").orderBy(F.floor("t")).rangeBetween(-604800, 0)
    return _requests(spark, sf_dir).select("client", "request_id", F.count("*").over(by).alias("recent"))
