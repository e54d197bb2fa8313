from __future__ import annotations

import corpus_pipeline
from sourcemark.llm import decontaminate, langid, neardup, packing, pii
from sourcemark.llm.queries import BYTE_BPE


def test_stages_one_by_one(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
            counts.append(docs.count())
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    assert counts == sorted(counts, reverse=True)
    assert counts[-1] > counts[0] // 2

    def read(name):
        return spark.read.parquet(str(tmp_path / name))

    kept = read("near_dedup")
    assert neardup.groups(kept).where("NOT kept").isEmpty()
    clean = read("decontamination")
    assert decontaminate.leaks(clean, spark.read.parquet(f"{small}/benchmark.parquet")).isEmpty()
    assert kept.count() - clean.count() <= 60
    private = pii.report(read("pii")).selectExpr("sum(n_email + n_ip + n_card + n_phone) AS n").first()
    assert private.n == 0
    assert docs.select("doc_id").distinct().count() == read("pii").count()
    assert langid and packing and BYTE_BPE


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
