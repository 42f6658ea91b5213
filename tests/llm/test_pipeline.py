from __future__ import annotations

import corpus_pipeline as pipeline
from sparkdigest.llm.common import table, written
from tests.conftest import SMALL


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_dedup", "personal_data", "packing"]
    sizes = []
    for name, stage in pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SMALL), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.where("n_chars <> length(text)").count() == 0 if name in ("substring_dedup", "personal_data") else True
        assert out.select("doc_id").distinct().count() == out.count()
        sizes.append(out.count())
        docs = out
    assert 0 < sizes[1] <= sizes[0] and sizes[1] == sizes[2] == sizes[3]
    packed = pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.select("doc_id").distinct().count() == sizes[3]
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_of_odd_documents(spark, odd, empty):
    for docs in (odd.select("doc_id", "text", "found", "kept"), empty.select("doc_id", "text", "found", "kept")):
        for name, stage in pipeline.STAGES[1:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            assert (out.count() == 0) == (docs.count() == 0)
