from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext

import corpus_pipeline as pipeline
from sparkdigest.llm import common, widehash
from tests.conftest import SMALL


def own_mb() -> float:
    with open("/proc/self/status") as f:
        return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) / 1024


def test_a_worker_gives_freed_memory_back_after_a_task():
    if not getattr(common, "_trim", True):
        pytest.skip("no malloc_trim here")
    last = []

    def run(batches):
        held = [np.ones(10_000, np.uint8) for _ in range(12_000)]
        last.append(np.ones(10_000, np.uint8))  # stays, above what is freed
        yield from batches
        del held

    before = own_mb()
    assert len(list(common.tidy(run)(iter([pa.record_batch({"x": [1]})])))) == 1
    assert own_mb() < before + 40


def test_tables_that_the_driver_makes_start_no_python_on_the_executors(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"the words of text {k // 2} are told here again and again") for k in range(20)], "doc_id long, text string")
    none = df.limit(0)

    def refused(*args, **kwargs):
        raise AssertionError("an RDD of Python objects")

    monkeypatch.setattr(SparkContext, "parallelize", refused)
    assert [r.component_id for r in widehash.near_copies(df).orderBy("doc_id").collect()] == [k // 2 * 2 for k in range(20)]
    assert pipeline.pack(spark, df, SMALL).count() == 20 and pipeline.pack(spark, none, SMALL).count() == 0
