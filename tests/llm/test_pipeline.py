"""The pipeline's stages against what each must do on its own input."""

import zlib

import corpus_pipeline
from newspulse.llm import decontam, neardup, quality

SF = "/root/testdata/sf0.01"


def test_each_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, kept[-1], SF).write.parquet(path)
        kept.append(spark.read.parquet(path))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert all(b <= a and b for a, b in zip(ids, ids[1:], strict=False))
    assert all(k.columns == docs.columns for k in kept[:-1])
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((i in ids[1]) == bool(truth[i]) for i in out) > 0.97 * len(out)
    texts = kept[1].groupBy("text").agg({"doc_id": "max"}).collect()
    assert ids[2] == {r[1] for r in texts}
    assert ids[3] == {r.doc_id for r in neardup.cluster(kept[2], 5, 80).where("kept").collect()}
    leaks = {r.doc_id for r in decontam.leaks(kept[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert leaks and ids[4] == ids[3] - leaks and ids[5] == ids[4]


def test_run_equals_its_stages(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert sorted(corpus_pipeline.run(spark, small).collect()) == sorted(docs.collect())
    assert quality.FIT_ROWS == 20_000 and corpus_pipeline.ORACLE_SQL is None
