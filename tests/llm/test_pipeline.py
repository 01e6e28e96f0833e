from __future__ import annotations

import shutil

import corpus_pipeline

from .helpers import DOCS
from .test_toxicity import corpus


def test_stages(spark, tmp_path):
    rows, labels = corpus()
    copies = [(1000 + i, rows[i][1], "t") for i in range(1, 7)]
    near = [(2000 + i, rows[i][1].replace(" w", " v", 1), "t") for i in range(8, 14)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows + copies + near] + [(3000, None, "en", "t", None), (3001, "", None, None, 0)], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "mixing", "BPE encoding"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    clean = {i for i in range(600) if i % 7}
    assert len(kept[0] & clean) >= 0.99 * len(clean) and len(kept[0] & {i for i in range(600) if i % 7 == 0}) <= 5
    # Documents of one line: a copy goes here if it has more than 50 words, else in the next stage.
    assert kept[0] - kept[1] == {i for i, t, _ in copies if len(t.split()) > 50} & kept[0]
    assert not kept[2] & {i for i, _, _ in copies} and not kept[2] & {2000 + i for i in range(8, 14)}
    assert kept[2] >= kept[1] & clean
    n = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert n == docs.count() > 0
    shutil.rmtree(tmp_path)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
