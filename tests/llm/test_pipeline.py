"""The pipeline's stages, and the queries on the small tables."""

import corpus_pipeline
from conftest_rows import SCHEMA, prose


def test_stages(spark, tmp_path):
    item = prose(500)
    rows = [(i, prose(i), "xa", f"s{i % 3}", 1) for i in range(120)]
    rows += [(200, prose(3), "xa", "s0", 1), (201, prose(4) + " tail", "xa", "s0", 1), (202, item + "\n" + prose(600), "xa", "s1", 1), (203, "too short", "xa", "s1", 1), (204, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left.append({r["doc_id"] for r in docs.collect()})
    assert {203, 204} & left[0] == set() and set(range(120)) <= left[0]
    assert {200, 201} & left[1] == set() and set(range(120)) <= left[1]
    assert left[2] == left[1] - {202}
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    per = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(per.values()) <= 3 and set(per) <= left[2]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == mixed.count()
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1
