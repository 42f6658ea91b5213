"""Embedding near copies against all pairs of each label."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import types as T

from sparkdigest.llm import neighbours, queries
from tests.conftest import SMALL, same_rows

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def _unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _at(rng, v, cosine):
    """A vector at just this cosine from each v."""
    e = rng.normal(size=v.shape)
    e = _unit(e - (e * v).sum(-1, keepdims=True) * v)
    return cosine * v + np.sqrt(1 - cosine**2) * e


def _all_pairs(rows):
    """n_links and component of each row, by comparing every pair."""
    root = {k: k for k in range(len(rows))}
    links = [0] * len(rows)
    good = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [_unit(np.array(r[1], np.float32).astype(float)) if g else None for r, g in zip(rows, good, strict=True)]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= neighbours.COSINE:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return [(r[0], links[k], least.get(find(k)), r[0] is not None and r[0] == least.get(find(k))) for k, r in enumerate(rows)]


def _found(spark, rows):
    df = spark.createDataFrame([(r[0], None if r[1] is None else [None if x is None else float(x) for x in r[1]], r[2]) for r in rows], SCHEMA)
    return sorted(map(tuple, neighbours.near_copies(df).collect()), key=repr)


def _planted(rng, width=32):
    """A crowd of near copies, a chain, pairs just over and just under the bound, exact copies, and clean vectors of three labels."""
    base = _unit(rng.normal(size=(150, width)))
    crowd = _at(rng, np.repeat(base[:1], 60, 0), 0.985)
    chain = [base[1]]
    for _ in range(8):
        chain.append(_at(rng, chain[-1], 0.95))
    over, under = _at(rng, base[10:40], 0.935), _at(rng, base[40:70], 0.925)
    vectors = [*base, *crowd, *chain[1:], *over, *under, *np.repeat(base[70:72], 9, 0)]
    labels = [*(k % 3 for k in range(150)), *[0] * 60, *[1] * 8, *(k % 3 for k in range(10, 40)), *(k % 3 for k in range(40, 70)), *[70 % 3] * 9, *[71 % 3] * 9]
    ids = rng.permutation(len(vectors))
    return [(int(i), v.tolist(), int(x)) for i, v, x in zip(ids, vectors, labels, strict=True)]


@pytest.mark.parametrize("block", [neighbours.BLOCK, 7])
def test_planted_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rows = _planted(np.random.default_rng(5))
    assert _found(spark, rows) == sorted(_all_pairs(rows), key=repr)


def test_recall_at_the_bound(spark):
    rng = np.random.default_rng(6)
    base = _unit(rng.normal(size=(1500, 64)))
    rows = [(k, v.tolist(), 0) for k, v in enumerate([*base, *_at(rng, base, 0.9305)])]
    linked = sum(r[1] for r in _found(spark, rows))
    assert 0.98 * 3000 <= linked <= 3000


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (1, v, 0), (2, v, 1), (3, v, None), (4, None, 0), (5, [], 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 2.0], 0), (8, [1.0, float("nan"), 2.0], 0), (9, [float("inf"), 0.0, 1.0], 0), (None, v, 0), (None, [9.0, -1.0, 0.0], 0), (10, [2.0, 4.0, 6.0], 0), (11, [1.0, 2.0], 0), (12, [1e-30, 2e-30, 3e-30], 0)]
    assert _found(spark, rows) == sorted(_all_pairs(rows), key=repr)
    assert _found(spark, []) == []


def test_further_columns_may_clash(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0, 7, 7), (2, [1.0, 0.0], 0, 7, 7)], "vec_id long, embedding array<float>, label int, node int, links int")
    assert sorted(map(tuple, neighbours.near_copies(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_query_equals_sql(spark, duck):
    same_rows(queries.queries()["op13_embedding_near_dedup"](spark, SMALL), duck, queries.oracle_sql()["op13_embedding_near_dedup"])
