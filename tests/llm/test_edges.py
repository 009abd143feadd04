"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import chat, digest, langid, media, mixing, pieces, pii, quality, simhash, urlfilter
from tapeloom.llm.queries import MODEL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the quick brown fox jumps over the lazy dog " * 4_000 + "x" * 50_000
ROWS = [
    (None, None, None, None, None), (None, "no id here", "en", "s", 10), (1, None, "en", "s", 0), (2, "", "en", None, 0), (3, " \n\t ", None, "", 4), (4, "word", "en", "s", 4),
    (5, LONG, "en", "s", len(LONG)), (6, "twice the same row", "en", "t", 18), (6, "twice the same row", "en", "t", 18), (7, "Twice  the same ROW", "de", "t", 19), (8, "é ﬁ ² 日本 😀", None, None, 11),
]
CLASHING = ["fp", "rep", "src", "row", "size", "start", "bucket", "block", "score", "digest", "media", "html", "key", "chunk", "word", "ids", "label", "id", "same", "taken", "part", "pos", "kind", "a.b", "__text", "__row", "__id", "__own", "__times", "__n", "c0", "gone", "twice", "times", "first", "name", "own", "row id"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *(F.lit(f"other {c}").alias(c) for c in CLASHING))  # "a.b" needs quoting by those who name it


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(MODEL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")


def operators(spark, labels, vocabulary):
    model = langid.learn(spark.createDataFrame([(1, "the and of to in", "en"), (2, "der die das und", "de"), (3, None, "fr"), (4, "x", None)], "doc_id long, text string, lang string"))
    ranker = quality.fit_on(spark.createDataFrame(ROWS, DOCS), labels)
    return {
        "langid": lambda d: langid.predicted(d, model, spans=True),
        "pii": pii.personal_data,
        "media": media.sampled,
        "digest": digest.compared,
        "mixing": mixing.mixed,
        "quality": lambda d: quality.scored(d, ranker),
        "pieces": lambda d: pieces.encoded(d, vocabulary, decode=True),
        "simhash": simhash.near_duplicates,
    }


@pytest.mark.parametrize("name", ["langid", "pii", "media", "digest", "mixing", "quality", "pieces", "simhash"])
def test_every_row_has_a_result(spark, docs, wide, empty, labels, vocabulary, name):
    f = operators(spark, labels, vocabulary)[name]
    ids = sorted((r[0] is not None, r[0] or 0) for r in ROWS)
    out = f(docs).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out) == ids
    again = f(wide)
    assert sorted(map(repr, f(wide).select(*f(docs).columns).collect())) == sorted(map(repr, out))
    assert f(empty).collect() == []


def test_whole_rows_pass_the_stages(spark, docs, wide, labels):
    ranker = quality.fit_on(docs, labels)
    assert quality.accepted(wide, ranker).schema == wide.schema
    good = sorted(repr(r["doc_id"]) for r in quality.scored(docs, ranker).where(F.col("score") >= quality.CUT).collect())
    assert sorted(repr(r["doc_id"]) for r in quality.accepted(wide, ranker).collect()) == good
    assert pii.redacted(wide).columns == wide.columns
    assert pii.redacted(docs).count() == len(ROWS)
    kept = simhash.deduplicated(wide)
    assert kept.columns == wide.columns
    # null ids stay; blank texts are copies of one another, and so are 6, its repetition and 7
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 8]
    assert mixing.repeated(wide).columns == wide.columns


def test_no_labels_or_one_label(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] >= quality.CUT for r in quality.scored(docs, quality.fit_on(docs, none)).collect()} == {True}
    bad = spark.createDataFrame([(4, 0)], "doc_id long, quality int")
    assert {r["score"] >= quality.CUT for r in quality.scored(docs, quality.fit_on(docs, bad)).collect()} == {False}


def test_no_language_is_learned(spark, docs, empty):
    assert {r["lang_pred"] for r in langid.predicted(docs, langid.learn(empty)).collect()} == {"und"}


def test_undetermined_without_letters(spark, docs, labels, vocabulary):
    out = {r["doc_id"]: r for r in operators(spark, labels, vocabulary)["langid"](docs).collect() if r["doc_id"]}
    assert [out[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and out[4]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, p string"
    rows = [(1, 0, None, None, "x"), (1, 0, None, None, "x"), (1, None, "assistant", "a", "x"), (None, 0, "user", "u", "x"), (None, 1, "assistant", "", "x"), (2, 5, "assistant", "</s>[SEP]" * 2000, "x"), (2, 5, "assistant", "[\\INST]", "x")]
    out = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, schema)).collect()}
    assert {k: r["n_turns"] for k, r in out.items()} == {1: 3, None: 2, 2: 2}
    assert out[2]["loss_chars"] == 9 * 2000 + len("[\\INST]") and out[None]["loss_chars"] == 0
    assert chat.digests(spark.createDataFrame([], schema)).collect() == []
    clash = spark.createDataFrame(rows, schema).select("*", *(F.lit("x").alias(c) for c in ("t", "x", "formatted", "loss", "turns", "mask", "a.b")))
    assert {r["conv_id"]: tuple(r) for r in chat.digests(clash).collect()} == {k: tuple(r) for k, r in out.items()}


def test_captures(spark):
    seen = spark.createDataFrame([(1, None, None, 1), (2, "not a url", "2024-01-01", 1), (3, "http://a.b.com/x", None, 1), (4, "http://A.B.com./x", "2024-01-02", 1), (4, "http://A.B.com./x", "2024-01-02", 1), (None, "http://b.com", "2024-01-02", 1)], "page_id long, url string, fetched string, category int")
    entries = spark.createDataFrame([("b.com", "spam", "2024-01-01", "add", "z"), (None, "spam", "2024-01-01", "add", "z"), ("c.com", None, "2024-01-01", "add", "z"), ("d.com", "spam", None, "add", "z")], "domain string, category string, day string, action string, host string")
    rows = urlfilter.filtered(seen, entries).collect()
    assert sorted(r["page_id"] or 0 for r in rows) == [0, 1, 2, 3, 4, 4]
    out = {r["page_id"]: r["blocked"] for r in rows}
    assert out == {1: False, 2: False, 3: False, 4: True, None: True}
    assert {r["blocked"] for r in urlfilter.filtered(seen, entries.limit(0)).collect()} == {False}
    assert urlfilter.filtered(seen.limit(0), entries).collect() == []


@pytest.mark.parametrize("name", ["quality", "near_dedup", "pii", "mixing"])
def test_stages_on_odd_tables(spark, name, docs, wide, empty, tmp_path):
    """Every stage but the last: an empty table, clashing names, ties and repeated rows give the columns and rows they should."""
    stage = dict(corpus_pipeline.STAGES)[name]
    labels_ = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels_.write.parquet(str(tmp_path / "labels.parquet"))
    assert stage(spark, empty, str(tmp_path)).collect() == [] and stage(spark, empty, str(tmp_path)).columns == empty.columns
    some, more = stage(spark, docs, str(tmp_path)), stage(spark, wide, str(tmp_path))
    assert more.columns == wide.columns and some.columns == docs.columns
    assert sorted(map(repr, more.toDF(*(f"x{i}" for i in range(len(wide.columns)))).select("x0", "x1").collect())) == sorted(map(repr, some.toDF(*(f"x{i}" for i in range(len(docs.columns)))).select("x0", "x1").collect()))
