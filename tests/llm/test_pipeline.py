"""The pipeline on small tables: each stage against what it promises."""

from __future__ import annotations

import sentencepiece

import corpus_pipeline
from tapeloom.llm import pii, queries, simhash
from tapeloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    all_ = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    good = {r["doc_id"] for r in table(spark, SF, "labels").where("quality = 1").collect()}
    assert len(good & seen["quality"].keys()) >= 0.95 * len(good & all_.keys())
    # one of each group stays: nothing that is left has a near copy, and what went has one
    kept = {i: simhash.shingle_set(t) for i, t in seen["near_dedup"].items()}
    ids = sorted(kept)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if simhash.likeness(kept[a], kept[b]) >= simhash.ALIKE]
    before = {i: simhash.shingle_set(t) for i, t in seen["quality"].items()}
    for gone in before.keys() - kept.keys():
        assert any(simhash.likeness(before[gone], before[k]) >= simhash.ALIKE for k in before if k != gone)
    for i, t in seen["pii"].items():
        assert t == pii.redact(all_[i], pii.find(all_[i]))
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == docs.count() and all(list(r["ids"]) == sp.encode(seen["mixing"][r["doc_id"]]) for r in out)


def test_run_repeats(spark):
    a, b = (sorted((r["doc_id"], r["n_pieces"]) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a
