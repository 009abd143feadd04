"""What round 3's findings named, on small tables that were wrong or grew too fast before."""

from __future__ import annotations

import duckdb

import __spark_entry__

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def both(spark, folder, name, **tables):
    """The query's rows and its SQL's, sorted, over tables given as Arrow tables."""
    import pyarrow.parquet as pq

    con = duckdb.connect()
    for k, t in tables.items():
        pq.write_table(t, f"{folder}/{k}.parquet")
        con.execute(f"CREATE VIEW {k} AS SELECT * FROM '{folder}/{k}.parquet'")
    ours, theirs = QUERIES[name](spark, str(folder)).toArrow(), con.sql(SQL[name]).to_arrow_table()
    columns = sorted(ours.column_names)
    return [sorted(map(repr, zip(*(t.column(c).to_pylist() for c in columns), strict=True))) for t in (ours, theirs)]


def test_batch_pack_trims_spaces_only(spark, tmp_path):
    """A line that begins or ends with the digits of its own place kept all of its characters, and spaces went, in SQL alone."""
    import pyarrow as pa

    texts = ["0 zero\nof 1\n  two 2  \n3\n\n 44 \n5 five", " a \u00a0\n\u3000\u2003\nb\t\n ", "", None, "x" * 4499 + " \n1\n2", "\n".join(f"{i} line {i}" for i in range(2000))]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    ours, theirs = both(spark, tmp_path, "batch_pack", documents=docs)
    assert ours == theirs and len(ours) > 5


def test_progress_keeps_few_states_for_many_jobs(spark, tmp_path):
    """Python is called, and a state kept, for a group of jobs and not for each; over batches the changes are the plain ones."""
    import random
    from datetime import datetime, timedelta

    from tapeloom.streaming import streams

    rng, rows = random.Random(5), []
    for i in range(600):
        status = rng.choice(["pending", "fusing", "fusing", None, "completed" if i > 150 else "pending"])
        rows.append((f"job{rng.randrange(60)}", i, datetime(2024, 1, 1) + timedelta(seconds=i // 3), status, rng.choice([0, 10])))
    kind = "job_id string, seq long, at timestamp, status string, progress int"
    for k in range(3):
        spark.createDataFrame(rows[200 * k : 200 * k + 200], kind).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    read = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = streams.progress_changes(read, groups=3).writeStream.format("memory").queryName("told").trigger(availableNow=True).start()
    run.awaitTermination()
    last, told = {}, []
    for j, seq, _, s, p in rows:
        before = last.get(j)
        if before is None or before[0] not in streams.ENDED:
            if before != (s, p):
                told.append(seq)
            last[j] = s, p
    assert sorted(r["seq"] for r in spark.table("told").collect()) == told
    assert max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]) <= 3


def test_nearest_deals_out_evenly(spark, monkeypatch):
    """Neither values beyond the known ones nor crowded ones meet in one slot, and the result is the plain one."""
    import random

    from tapeloom.operators import tables

    rng, kept = random.Random(3), []
    known = sorted({round(900 + rng.random(), 4) for _ in range(300)} | {1e6})  # one far off: all others are in a sliver
    values = [round(900 + rng.random(), 4) for _ in range(900)] + [rng.uniform(2e6, 3e6) for _ in range(900)] + [1.0, known[0], known[-1], None]
    monkeypatch.setattr(tables, "checkpoint", lambda df, real=tables.checkpoint: kept.append(real(df)) or kept[-1])
    out = tables.nearest(spark.createDataFrame(list(enumerate(values)), "i long, v double"), spark.createDataFrame([(k,) for k in known], "v double"), "v", 8)
    got = {r["i"]: r["nearest"] for r in out.collect()}
    assert got == {i: None if v is None else min(known, key=lambda k: (abs(v - k), k)) for i, v in enumerate(values)}
    sizes = [r["count"] for r in kept[-1].groupBy("__slot").count().collect()]
    assert sum(sizes) < 1300 and len(sizes) == 8 and max(sizes) < 400


def test_embedder_keeps_little_for_each_word():
    """Vectors are those of the definition, and what is kept of 20,000 words is bytes: some 100 for each, and no arrays."""
    import hashlib
    import sys

    import numpy as np

    from tapeloom.operators import embedding

    own = embedding.HashingEmbedder(48, weights=np.linspace(1, 2, embedding.BUCKETS))
    texts = ["", "a", "Über die Brücke über", *(f"w{i}x{i * 7919} die" for i in range(20_000))]
    got = own.encode(texts)
    for text, row in list(zip(texts, got, strict=True))[:40]:
        want = np.zeros(48)
        for w in embedding.WORD.findall(text.lower()):
            for f in [f"={w}", *(f"<{w}>"[i : i + 3] for i in range(len(w)))]:
                h = int.from_bytes(hashlib.md5(f.encode()).digest()[:4], "big")
                want[h % 48] += (1 - 2 * (h // 48 % 2)) * own.weights[h % embedding.BUCKETS]
        assert np.allclose(row, want / max(np.linalg.norm(want), 1e-9))
    assert len(own._known) > 20_000 and all(type(v) is bytes for v in own._known.values())
    assert sum(map(sys.getsizeof, own._known.values())) < 120 * len(own._known)


def test_clusters_joined_one_by_one_take_few_jobs(spark, monkeypatch):
    """Each round joins two clusters here: rounds are not a handful of Spark jobs each, and by blocks the result is the same."""
    import numpy as np

    from tapeloom.operators import fusion

    turn = np.cumsum(1.6 ** np.arange(24)) * 2e-5
    rows = [(1, p, [float(np.cos(x)), float(np.sin(x))]) for p, x in enumerate(turn)]
    frame, want = spark.createDataFrame(rows, "job int, pos long, embedding array<double>"), {p: max(0, p - 20) for p in range(24)}
    spark.sparkContext.setJobGroup("one by one", "")
    out = {r["pos"]: r["cluster"] for r in fusion.topic_clusters(frame, "job", "pos", 2).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out == want and len(spark.sparkContext.statusTracker().getJobIdsForGroup("one by one")) < 80
    monkeypatch.setattr(fusion, "FEW", 0)
    assert {r["pos"]: r["cluster"] for r in fusion.topic_clusters(frame, "job", "pos", 18, 5).collect()} == want


def test_nearest_by_single_precision_is_that_of_double(monkeypatch):
    """Nearest ones that single precision can't tell apart, equal ones and copies: the least pair of the least distance."""
    import numpy as np

    from tapeloom.operators import fusion

    rng = np.random.default_rng(9)
    v = rng.normal(0, 1, (300, 6))
    v = np.concatenate([v, v[:80] + rng.normal(0, 1e-8, (80, 6)), v[:30]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids, asks = np.arange(len(v)) * 3 + 1, np.sort(rng.permutation(len(v))[:150])
    monkeypatch.setattr(fusion, "STRIP", 64)
    got = list(zip(*(x.tolist() for x in fusion.nearest_of(ids[asks], v[asks], ids, v)), strict=True))
    far = lambda i, j: round(1.0 - float((v[i] * v[j]).sum()), 12)
    assert got == [min((far(i, j), int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))) for j in range(len(v)) if j != i) for i in asks]


def test_pieces_meet_chunks_by_one_exchange_and_are_decoded_at_once(spark):
    """Words are exchanged once, their masks not again; rows decoded together are those decoded one by one."""
    import re

    import numpy as np

    from tapeloom.llm import pieces
    from tapeloom.llm.queries import MODEL

    v = pieces.Vocabulary.load(MODEL)
    rows = [[], [v.ids["▁the"], *(v.bytes_[b] for b in "é".encode())], [0, 1, 2], [v.bytes_[255], v.ids["▁the"]], [v.ids["▁the"]] * 3]
    ends = np.cumsum([0, *map(len, rows)])
    for more in ([], [10**6]):
        ids = np.array([i for r in rows for i in r] + more, np.int32)
        assert v.decode_all(ids, ends) == [v.decode(r) for r in rows]
    docs = spark.createDataFrame([(1, "some words, and some more"), (2, None), (3, "  ünï  一丁 x")], "doc_id long, text string")
    found = pieces.encoded(docs, v, decode=True)
    assert {r["doc_id"]: r["decoded"] for r in found.collect()} == {1: "some words, and some more", 2: "", 3: "  ünï  一丁 x"}
    plan = pieces.encoded(docs, v)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(word", plan)) == 2  # the same one, for the lattice and for the chunks


def test_pieces_of_many_units_take_few_python_calls():
    """op8's CPU: units, words and ids of a chunk are those found one by one, but no Python call is made for each of them."""
    import random
    import sys

    import numpy as np
    import pyarrow as pa

    from tapeloom.llm import pieces
    from tapeloom.llm.queries import MODEL

    v, rng, calls = pieces.Vocabulary.load(MODEL), random.Random(8), 0
    odd = ["".join(rng.choice(' aeThé.,\n\t(12"_▁日²½') for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, "", " ", "▁", "a ", "  "]
    for texts in (odd, [], [None], ["", None], [t or "x  y" for t in odd], ["a b"] * 900):
        units = v.units(pa.array(["é" * 5000, *texts], pa.string())[1:])  # a slice, as tasks hold them
        want = [[] if not t else [t.replace(" ", "▁")] if "  " in t or t[0] == " " or "▁" in t else t.split(" ") for t in texts]
        assert [u or [] for u in units.to_pylist()] == want
        distinct = units.flatten().unique()
        assert v.unit_words(distinct).to_pylist() == [pieces.WORDS.findall("▁" + u) for u in distinct.to_pylist()]

    def count(frame, event, arg):
        nonlocal calls
        calls += 1

    units = pa.array(sorted({f"{rng.choice(['the', 'Über', 'x日'])}{rng.choice('aeiou')}{i}{rng.choice(['', '.', 'ed,'])}" for i in range(4000)}))
    words = v.unit_words(units).flatten().unique()
    words = words.filter(pieces._in_lattice(words))
    masks = [v.mask(w) for w in words.to_pylist()]
    twice = pa.table([pa.array(np.arange(2 * len(words)) % 2), pa.concat_arrays([words, words]), pa.array(masks * 2)], names=["chunk", "word", "mask"])
    v.pieces  # noqa: B018  made once
    sys.setprofile(count)
    try:
        rows = pieces._with_ids(twice, v)
        of = pieces._Units(v, {})
        of.words, of.ids = (rows.column(k).combine_chunks()[: len(words)] for k in (1, 2))
        found = of.of(units)
    finally:
        sys.setprofile(None)
    assert calls < 1500
    assert [np.array(x, "<i4").tobytes() for x in rows["ids"].to_pylist()] == [v.word_ids(w, m) for w, m in zip(words.to_pylist() * 2, masks * 2, strict=True)]
    assert [np.array(x, "<i4").tobytes() for x in found.to_pylist()] == [b"".join(v.word_ids(w) for w in pieces.WORDS.findall("▁" + u)) for u in units.to_pylist()]
