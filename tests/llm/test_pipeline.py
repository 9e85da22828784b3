import corpus_pipeline as pipeline
from depweave.llm import quality_crf

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_their_effects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == docs.columns, name
        now = {r["doc_id"] for r in out.select("doc_id").collect()}
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert now <= before and out.count() == len(now)
        assert (now == before) == (name == "line_dedup") or name in ("near_dedup", "decontamination")
        kept = out
    assert len(now) < len(ids)
    packed = pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == now


def test_quality_stage_keeps_what_the_labels_call_good(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    held = {r["doc_id"]: r["quality"] for r in labels.where(quality_crf.in_fold("doc_id", 3, 1)).collect()}
    assert sum((i in kept) == bool(q) for i, q in held.items()) / len(held) > 0.9
