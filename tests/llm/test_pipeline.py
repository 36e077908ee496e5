from helpers import DATA

import corpus_pipeline
from attestra.llm import packing, quality_rules, secrets, simhash


def test_stages_and_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "secret_scan", "best_fit_packing"]
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cleaned = quality_rules.clean(docs)
    one = simhash.unique(cleaned)
    safe = secrets.redact(one)
    assert docs.columns == cleaned.columns == one.columns == safe.columns
    assert one.count() == simhash.classes(cleaned, shingle=5).select("component_id").distinct().count() == safe.count()
    expected = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.packed(safe).collect())
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()) == expected


def test_odd_documents(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[0] == "doc_id"
