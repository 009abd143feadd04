"""Fusing several videos' sentences: topic clusters, their statistics, conflicts, paragraphs, narrative."""

from __future__ import annotations

import functools
import itertools
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import text as T
from tapeloom.functions import vectors as V
from tapeloom.operators import folds
from tapeloom.session import checkpoint, shared_folder
from tapeloom.sources import versions

# Words that speak against or for a statement, wherever they stand in it.
AGAINST = ("not", "never", "wrong", "false", "incorrect", "disagree", "however", "but", "although", "contrary", "opposite")
FOR = ("is", "are", "will", "should", "must", "always", "definitely")


#: Clusters of a job that one task ends; more of them are joined in rounds first. Numbers (clusters by dimensions) of a block.
LOCAL, BLOCK = 2_000, 1 << 20
#: A job's rounds are one task's work while it has so many numbers, and a round so many comparisons, at most; rows compared at once.
HELD, FEW, STRIP = 8 << 20, 200_000_000, 256


def linkage_joins(total: np.ndarray, size: np.ndarray) -> list[tuple[float, int, int]]:
    """All joins (distance, a, b) of clusters given by the sums of their unit vectors and their sizes, average linkage.

    The mean distance of two clusters is one less the product of their mean unit vectors, so a cluster's size and sum are
    all that is held: memory grows as the rows. Chains of nearest neighbours find all joins; in order of distance, they are
    those that joining the nearest two each time gives, but for ties. A joined cluster stands in the smaller place.
    """
    total, size, live = total.copy(), size.astype(float), np.ones(len(size), bool)
    joins, chain = [], []
    while live.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(live)[0])]
        a = chain[-1]
        d = 1.0 - (total @ total[a]) / (size * size[a])
        d[~live] = np.inf
        d[a] = np.inf
        b = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            b = chain[-2]
            del chain[-2:]
            joins.append((float(d[b]), a, b))
            low, high = sorted((a, b))
            total[low], size[low], live[high] = total[low] + total[high], size[low] + size[high], False
        else:
            chain.append(b)
    return joins


def average_linkage(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Cluster of each row by agglomeration, cosine distance and average linkage; numbered by their first rows."""
    n = len(vectors)
    joins = linkage_joins(vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9), np.ones(n))
    label = np.arange(n)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for _, a, b in sorted(joins)[: max(0, n - clusters)]:
        low, high = sorted((root(a), root(b)))
        label[high] = low
    return np.unique([root(i) for i in range(n)], return_inverse=True)[1]


def topic_clusters(sentences: DataFrame, key: str, place: str, local: int | None = None, block: int | None = None) -> DataFrame:
    """(key, place, cluster) of sentences (key, place, embedding), a fifth as many clusters, from 3 to 20.

    A job of under three sentences is one cluster each. Jobs of up to `local` sentences are a task's work each; larger
    ones are joined in rounds until as many clusters are left. Places differ within a job; clusters are numbered by
    their first sentences.
    """
    local = local or LOCAL

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(place)
        n = len(frame)
        label = np.arange(n) if n < 3 else average_linkage(np.array(frame["embedding"].tolist(), float), max(3, min(n // 5, 20)))
        return frame[[key, place]].assign(cluster=label.astype("int64"))

    kinds = dict(sentences.dtypes)
    rows = sentences.select(key, place, "embedding")
    schema = f"{key} {kinds[key]}, {place} {kinds[place]}, cluster long"
    large = checkpoint(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > local))  # a row for each large job
    if large.isEmpty():
        return rows.groupBy(key).applyInPandas(run, schema)
    small = rows.join(large, key, "left_anti").groupBy(key).applyInPandas(run, schema)
    return small.unionByName(_clustered_in_rounds(rows.join(large, key), key, place, local, block).select(key, F.col(place).cast(kinds[place]).alias(place), "cluster"))


def nearest_of(ids: np.ndarray, means: np.ndarray, all_ids: np.ndarray, all_means: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, lo, hi) of each of `ids`: the nearest other one of `all_ids` (ascending), as a pair; of equals the least pair, -1 if none.

    Single precision finds those that may be the nearest, double precision decides. A pair's distance is the same to the
    bit from both sides, so two that are nearest to each other agree.
    """
    d, lo, hi = np.full(len(ids), np.nan), np.full(len(ids), -1), np.full(len(ids), -1)
    if not len(ids) or not len(all_ids):
        return d, lo, hi
    y = all_means.astype(np.float32).T
    doubt = 2.4e-7 * means.shape[1] * np.linalg.norm(means, axis=1) * np.linalg.norm(all_means, axis=1).max() + 4e-12
    for k in range(0, len(ids), STRIP):
        own = ids[k : k + STRIP]
        s = means[k : k + STRIP].astype(np.float32) @ y
        at = np.minimum(np.searchsorted(all_ids, own), len(all_ids) - 1)
        self_ = np.flatnonzero(all_ids[at] == own)
        s[self_, at[self_]] = -np.inf
        first, every = s.argmax(axis=1), np.arange(len(own))
        top = s[every, first]
        s[every, first] = -np.inf
        close = np.flatnonzero(s.max(axis=1) >= top - doubt[k : k + STRIP])  # few rows have a second one that may be nearer
        more, others = np.nonzero(s[close] >= (top - doubt[k : k + STRIP])[close, None])
        rows, columns = np.r_[every, close[more]], np.r_[first, others]
        rows, columns = (x[all_ids[columns] != own[rows]] for x in (rows, columns))
        for i in range(0, len(rows), 50_000):
            r, c = rows[i : i + 50_000] + k, columns[i : i + 50_000]
            x = np.round(1.0 - (means[r] * all_means[c]).sum(axis=1), 12)
            low, high = np.minimum(ids[r], all_ids[c]), np.maximum(ids[r], all_ids[c])
            order = np.lexsort((high, low, x, r))
            best = order[np.unique(r[order], return_index=True)[1]]
            r, x, low, high = r[best], x[best], low[best], high[best]
            better = np.isnan(d[r]) | (x < d[r]) | ((x == d[r]) & ((low < lo[r]) | ((low == lo[r]) & (high < hi[r]))))
            d[r[better]], lo[r[better]], hi[r[better]] = x[better], low[better], high[better]
    return d, lo, hi


def _clusters(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, sizes and totals of a table's clusters."""
    ids, size = table["id"].to_numpy(), table["size"].to_numpy()
    total, order = table["total"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1), np.argsort(ids)
    return ids[order], size[order], total[order]


def _nearest_in_blocks(state: DataFrame, key: str, block: int | None) -> DataFrame:
    """(key, id, d, lo, hi): the nearest other one of each cluster of `state` (key, id, size, total, d, n, stale, width) without one.

    A job's clusters are dealt out into blocks, those that ask likewise; a block is one row of bytes, and a task holds one of each.
    """
    most = F.lit(block) if block else F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / F.col("width")))
    deal = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.least(most, F.greatest(F.lit(LOCAL), F.ceil(F.col("n") / 6))))).cast("int")
    at, kind = lambda n: F.pmod(F.xxhash64("id"), deal(n)).cast("int"), dict(state.dtypes)[key]

    def pack(table: pa.Table) -> pa.Table:
        ids, size, total = _clusters(table)
        one = table.slice(0, 1).select([key, "at", "others"])
        return one.append_column("ids", pa.array([ids.tobytes()], pa.binary())).append_column("means", pa.array([(total / size[:, None]).tobytes()], pa.binary()))

    def packed(rows: DataFrame, own: str, others: str) -> DataFrame:
        dealt = rows.select(key, at(own).alias("at"), deal(others).alias("others"), "id", "size", "total")
        return dealt.groupBy(key, "at").applyInArrow(pack, f"{key} {kind}, at int, others int, ids binary, means binary")

    every = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    asking = packed(state.where("d is null"), "stale", "n").select(key, F.col("at").alias("i"), every.alias("j"), F.lit(True).alias("asks"), "ids", "means")
    met = asking.unionByName(packed(state, "n", "stale").select(key, every.alias("i"), F.col("at").alias("j"), F.lit(False).alias("asks"), "ids", "means"))

    def run(table: pa.Table) -> pa.Table:
        side = {r["asks"]: np.frombuffer(r["ids"], np.int64) for r in table.select(["asks", "ids"]).to_pylist()}
        if len(side) < 2:  # hashing left a block of one side empty
            return pa.table({key: table[key][:0], "id": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64())})
        means = {r["asks"]: np.frombuffer(r["means"]).reshape(len(side[r["asks"]]), -1) for r in table.select(["asks", "means"]).to_pylist()}
        a = side[True]
        d, lo, hi = nearest_of(a, means[True], side[False], means[False])
        some = np.flatnonzero(lo >= 0)
        out = pa.table({"id": a, "d": d, "lo": lo, "hi": hi}).take(some)
        return out.add_column(0, key, table[key].combine_chunks().take(pa.array(np.zeros(len(some), np.int64))))

    near = met.groupBy(key, "i", "j").applyInArrow(run, f"{key} {kind}, id long, d double, lo long, hi long")
    best = near.groupBy(key, "id").agg(F.min(F.struct("d", "lo", "hi")).alias("p"))
    return best.select(key, "id", "p.*")


def _rounds_in_a_task(state: DataFrame, key: str, local: int, step: int) -> DataFrame:
    """Rounds of jobs of bounded size while they compare little: joins (key, d, lo, hi, step), and clusters, whose step is null."""

    def run(table: pa.Table) -> pa.Table:
        ids, size, total = _clusters(table)
        order = np.argsort(table["id"].to_numpy())
        d, (lo, hi) = table["d"].to_numpy()[order], (table[c].fill_null(-1).to_numpy()[order] for c in ("lo", "hi"))
        mean, made = total / size[:, None], []
        while len(ids) > local and (not made or np.isnan(d).sum() * len(ids) <= FEW):
            at = np.flatnonzero(np.isnan(d))
            d[at], lo[at], hi[at] = nearest_of(ids[at], mean[at], ids, mean)
            a = np.flatnonzero(lo == ids)
            b = np.searchsorted(ids, hi[a])
            both = (lo[b] == lo[a]) & (hi[b] == hi[a])
            a, b = a[both], b[both]
            if not len(a):
                raise ValueError("no two clusters are nearest to each other: are all vectors numbers?")
            made.append(pa.table({"id": ids[a], "d": d[a], "lo": lo[a], "hi": hi[a], "step": np.full(len(a), step + len(made))}))
            total[a], size[a] = total[a] + total[b], size[a] + size[b]
            mean[a] = total[a] / size[a][:, None]
            touched, live = np.zeros(len(ids), bool), np.ones(len(ids), bool)
            touched[a], touched[b], live[b] = True, True, False
            d[touched | touched[np.searchsorted(ids, np.where(lo == ids, hi, lo))]] = np.nan
            ids, size, total, mean, d, lo, hi = (x[live] for x in (ids, size, total, mean, d, lo, hi))
        gone = np.isnan(d)
        ends = np.arange(0, total.size + 1, total.shape[1], dtype=np.int32)
        left = pa.table({"id": ids, "size": size, "total": pa.ListArray.from_arrays(ends, total.ravel()), **{c: pa.array(x, mask=gone) for c, x in (("d", d), ("lo", lo), ("hi", hi))}})
        out = pa.concat_tables([left, *made], promote_options="default")
        out = out.add_column(0, key, table[key].combine_chunks().take(pa.array(np.zeros(len(out), np.int64))))
        return out.select([key, "id", "size", "total", "d", "lo", "hi", "step"])

    return state.groupBy(key).applyInArrow(run, f"{key} {dict(state.dtypes)[key]}, id long, size long, total array<double>, d double, lo long, hi long, step long")


def _clustered_in_rounds(rows: DataFrame, key: str, place: str, local: int, block: int | None) -> DataFrame:
    """As topic_clusters, of jobs (key, place, embedding, n): each round joins all pairs of clusters that are nearest to each other.

    A cluster is the sum of its unit vectors, its size, its smallest place as its id, and its nearest other one: that
    stays so until one of the two is joined (a joined cluster is never nearer than the nearer of its parts), so only
    then is it looked for again, by blocks. Rounds of few comparisons, of jobs of bounded size, follow one another
    within a task, and jobs of which `local` clusters are left are ended there. The joins of the least distances are
    the clusters' (heights never fall), and sentences find their cluster by following joins, twice as far in each round.
    """
    spark = rows.sparkSession
    folder, kept = f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}", itertools.count()

    def keep(df: DataFrame) -> DataFrame:
        """Written and read again: a checkpoint would hand on what its joins were thought to be worth, multiplied each round."""
        path = f"{folder}/{next(kept)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    unit = rows.select(key, F.col(place).cast("long").alias("id"), F.lit(1).cast("long").alias("size"), V.normalized(F.col("embedding")).alias("total"))
    ids = keep(rows.select(key, F.col(place).cast("long").alias("id"), "n"))
    unknown = [F.lit(None).cast(t).alias(c) for c, t in (("d", "double"), ("lo", "long"), ("hi", "long"))]
    state, joins, step = keep(unit.select("*", *unknown)), [], 0
    here = f"n > {local} and n * width <= {HELD} and n * stale <= {FEW}"
    while True:
        sized = keep(state.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.isnull("d")).alias("stale"), F.max(F.size("total")).alias("width")))
        of = {"end": f"n <= {local}", "here": here, "wide": f"n > {local} and not ({here})"}
        some = sized.agg(*(F.count_if(F.expr(c)).alias(k) for k, c in of.items())).first()
        part = {k: state.join(F.broadcast(sized.where(c)), key) for k, c in of.items()}
        states = []
        if some["end"]:
            joins.append(keep(_ended_locally(part["end"].select(key, "id", "size", "total"), key)))
        if some["here"]:
            out = keep(_rounds_in_a_task(part["here"], key, local, step << 20))
            joins.append(out.where("step is not null").select(key, "d", "step", "lo", "hi"))
            states.append(out.where("step is null").drop("step"))
        if some["wide"]:
            near = keep(_nearest_in_blocks(part["wide"], key, block))
            found = near.select(key, "id", *(F.col(c).alias(f"new_{c}") for c in ("d", "lo", "hi")))
            told = part["wide"].join(found, [key, "id"], "left").select(key, "id", "size", "total", *(F.coalesce(c, f"new_{c}").alias(c) for c in ("d", "lo", "hi")))
            mutual = told.groupBy(key, "lo", "hi").agg(F.count("*").alias("both"), F.min("d").alias("d")).where("both = 2 and lo is not null")
            made = keep(mutual.select(key, "d", F.lit(step << 20).cast("long").alias("step"), "lo", "hi"))
            if made.isEmpty():
                raise ValueError("no two clusters are nearest to each other: are all vectors numbers?")
            joins.append(made)
            joined = made.select(key, F.explode(F.array("lo", "hi")).alias("id"), F.col("lo").alias("into"))
            other = joined.select(key, F.col("id").alias("other"), F.lit(True).alias("moved"))
            into = told.withColumn("other", F.col("lo") + F.col("hi") - F.col("id")).join(joined, [key, "id"], "left").join(other, [key, "other"], "left")
            still = F.col("into").isNull() & F.col("moved").isNull()
            named = into.select(key, F.coalesce("into", "id").alias("id"), "size", "total", *(F.when(still, F.col(c)).alias(c) for c in ("d", "lo", "hi")))
            add = lambda x, y: F.zip_with(x, y, lambda p, q: p + q)
            one = named.groupBy(key, "id").agg(F.sum("size").alias("size"), F.collect_list("total").alias("t"), *(F.min(c).alias(c) for c in ("d", "lo", "hi")))  # one or two
            sums = F.when(F.size("t") == 2, add(F.get("t", F.lit(0)), F.get("t", F.lit(1)))).otherwise(F.get("t", F.lit(0)))
            states.append(one.select(key, "id", "size", sums.alias("total"), "d", "lo", "hi"))
        if not states:
            break
        state = keep(functools.reduce(DataFrame.unionByName, states))
        step += 1
    joins = functools.reduce(DataFrame.unionByName, joins)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("d", "step", "lo", "hi"))
    clusters = F.greatest(F.lit(3), F.least(F.floor(F.col("n") / 5), F.lit(20)))
    sizes = ids.select(key, "n").distinct()
    taken = joins.withColumn("k", rank).join(sizes, key).where(F.col("k") <= F.col("n") - clusters).select(key, F.col("hi").alias("id"), F.col("lo").alias("up"))
    up = keep(ids.join(taken, [key, "id"], "left").select(key, "id", F.coalesce("up", "id").alias("up")))
    while True:
        further = up.select(key, F.col("id").alias("up"), F.col("up").alias("next"))
        now = keep(up.join(further, [key, "up"]).select(key, "id", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("moved")))
        up = now.select(key, "id", "up")
        if now.where("moved").isEmpty():
            break
    number = up.select(key, "up").distinct().withColumn("cluster", (F.row_number().over(Window.partitionBy(key).orderBy("up")) - 1).cast("long"))  # 20 at most
    out = checkpoint(up.join(number, [key, "up"]).select(key, F.col("id").alias(place), "cluster"))
    versions.delete(spark, folder)
    return out


def _ended_locally(state: DataFrame, key: str) -> DataFrame:
    """(key, d, step, lo, hi): all further joins of jobs of which few clusters (key, id, size, total) are left."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        own, rows = frame["id"].to_numpy(), []
        for i, (d, a, b) in enumerate(linkage_joins(np.array(frame["total"].tolist(), float), frame["size"].to_numpy())):
            rows.append((round(d, 12), (1 << 50) + i, own[min(a, b)], own[max(a, b)]))
        return pd.DataFrame(rows, columns=["d", "step", "lo", "hi"]).assign(**{key: frame[key].iloc[0]})[[key, "d", "step", "lo", "hi"]]

    return state.groupBy(key).applyInPandas(run, f"{key} {dict(state.dtypes)[key]}, d double, step long, lo long, hi long")


def stats(sentences: DataFrame) -> DataFrame:
    """(cluster, sentences, videos, importance, first_pos) of sentences (cluster, video_id, pos)."""
    out = sentences.groupBy("cluster").agg(F.count("*").alias("sentences"), F.countDistinct("video_id").alias("videos"), F.min("pos").alias("first_pos"))
    return out.select("cluster", "sentences", "videos", (F.col("sentences") * F.col("videos")).alias("importance"), "first_pos")


def centroids(vectors: DataFrame) -> DataFrame:
    """(cluster, dim, value): the mean of (cluster, embedding) by dimension, combined before the shuffle."""
    return vectors.select("cluster", F.posexplode("embedding").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def representatives(vectors: DataFrame) -> DataFrame:
    """(cluster, pos): the row of (cluster, pos, embedding) nearest to its cluster's centroid, the first of ties."""
    means = centroids(vectors).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("c"))
    mean = F.transform("c", lambda x: x["value"])
    near = vectors.join(means, "cluster").select("cluster", "pos", F.round(V.distance(F.col("embedding"), mean), 9).alias("d"))
    return near.groupBy("cluster").agg(F.min(F.struct("d", "pos"))["pos"].alias("pos"))


def stances(statements: DataFrame) -> DataFrame:
    """(cluster, video_id, against, supports, stance, first_pos, first_text) of statements (cluster, video_id, pos, text).

    How many indicators occur in any of a video's statements, as parts of words too. Counted per indicator by a maximum,
    so texts aren't gathered.
    """
    text = F.lower("text")
    marks = {f"a{i}": F.max(F.contains(text, F.lit(w)).cast("int")) for i, w in enumerate(AGAINST)} | {f"f{i}": F.max(F.contains(text, F.lit(w)).cast("int")) for i, w in enumerate(FOR)}
    found = statements.groupBy("cluster", "video_id").agg(*(m.alias(k) for k, m in marks.items()), F.min(F.struct("pos", "text")).alias("first"))
    total = lambda p, n: sum((F.col(f"{p}{i}") for i in range(1, n)), F.col(f"{p}0"))
    out = found.select("cluster", "video_id", total("a", len(AGAINST)).alias("against"), total("f", len(FOR)).alias("supports"), F.col("first.pos").alias("first_pos"), F.col("first.text").alias("first_text"))
    return out.withColumn("stance", F.when(F.col("against") > F.col("supports"), "disagrees/negative").otherwise("agrees/positive"))


def conflicts(statements: DataFrame) -> DataFrame:
    """(cluster, videos, positions): clusters whose videos take different stances, positions by video as a map."""
    said = F.concat(F.col("stance"), F.lit(": "), F.left("first_text", F.lit(100)), F.lit("..."))
    by = stances(statements).groupBy("cluster").agg(F.countDistinct("stance").alias("n"), F.count("*").alias("videos"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("video_id", said.alias("said"))))).alias("positions"))
    return by.where("n > 1 and videos > 1").select("cluster", "videos", "positions")


def pairs(statements: DataFrame, chars: int = 512) -> DataFrame:
    """(cluster, video_a, video_b, text_a, text_b): a cluster's pairs of videos, in order of appearance, two statements each."""
    order = Window.partitionBy("cluster", "video_id").orderBy("pos")
    two = statements.withColumn("k", F.row_number().over(order)).where("k <= 2")
    videos = two.groupBy("cluster", "video_id").agg(F.min("pos").alias("first_pos"), F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " "), F.lit(chars)).alias("text"))
    a, b = videos.alias("a"), videos.alias("b")
    met = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.first_pos") < F.col("b.first_pos")))
    return met.select("a.cluster", F.col("a.video_id").alias("video_a"), F.col("b.video_id").alias("video_b"), F.col("a.text").alias("text_a"), F.col("b.text").alias("text_b"))


def paragraphs(sentences: DataFrame, kept: DataFrame, representative: DataFrame, sources: bool = True) -> DataFrame:
    """(cluster, importance, first_pos, text, words): the representative, then the second to fifth kept sentence.

    sentences: (cluster, video_id, pos, text); kept: those (cluster, pos) that deduplication leaves. Importance and
    videos are those before deduplication.
    """
    order = Window.partitionBy("cluster").orderBy("pos")
    more = sentences.join(kept, ["cluster", "pos"], "left_semi").withColumn("k", F.row_number().over(order)).where("k between 2 and 5")
    rest = more.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("rest"))
    rep = sentences.join(representative, ["cluster", "pos"]).select("cluster", F.col("text").alias("rep"))
    joined = rep.join(rest, "cluster", "left").join(stats(sentences), "cluster")
    others = F.filter(F.transform(F.coalesce("rest", F.array().cast("array<struct<pos:bigint,text:string>>")), lambda x: x["text"]), lambda t: t != F.col("rep"))
    text = F.array_join(F.concat(F.array("rep"), others), ". ")
    told = F.when(F.lit(sources) & (F.col("videos") > 1), F.concat(text, F.lit(" (discussed in "), F.col("videos"), F.lit(" videos)"))).otherwise(text)
    return joined.select("cluster", "importance", "first_pos", told.alias("text")).withColumn("words", T.word_count(F.col("text")).cast("long"))


def narrative(rows: DataFrame, key: str, target: int, transitions: list[str], topics: DataFrame | None = None) -> DataFrame:
    """(key, words, text) of paragraphs (key, importance, first_pos, text, words), the most important first.

    topics: (key, topic, pos) of conflicts; a text under the target ends with a note on the first three.
    """
    order = Window.partitionBy(key).orderBy(F.desc("importance"), "first_pos")
    out = folds.assemble(rows.withColumn("pos", F.row_number().over(order)), key, target, transitions)
    if topics is None:
        return out
    first = Window.partitionBy(key).orderBy("pos")
    three = topics.withColumn("k", F.row_number().over(first)).where("k <= 3").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", "topic"))).alias("t"))
    lines = F.transform("t", lambda x: F.concat(F.lit("- On '"), x["topic"], F.lit("': sources presented varying viewpoints")))
    note = F.concat_ws(" ", F.lit("Note: Some sources had differing perspectives:"), F.array_join(lines, " "))
    with_note = F.when(F.col("t").isNotNull() & (F.col("words") < target), F.concat_ws("\n\n", F.nullif("text", F.lit("")), note)).otherwise(F.col("text"))
    return out.join(three, key, "left").select(key, "words", with_note.alias("text"))


def ratios(source_words: Column, output_words: Column, kept: Column, total: Column) -> tuple[Column, Column]:
    """(compression, deduplication) ratios; an empty source or cluster counts as 1."""
    one = lambda c: F.greatest(c, F.lit(1))
    return F.round(output_words / one(source_words), 6), F.round(kept / one(total), 6)


