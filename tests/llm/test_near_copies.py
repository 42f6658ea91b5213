from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sparkdigest.llm import simhash, widehash
from tests.conftest import SMALL


def edited(rng: random.Random, words: list[str], n: int) -> str:
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def brute(texts: dict[int, str]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """The class of each text, and all links."""
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in ((k, t.lower().split()) for k, t in texts.items())}
    root, links = {k: k for k in texts}, []
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links.append((a, b))
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    return root, links


def test_near_copies_are_those_of_brute_force(spark):
    rng = random.Random(3)
    texts = {}
    for size in (60, 120, 200, 400):
        for _ in range(4):
            words = [f"w{rng.randrange(4000)}" for _ in range(size)]
            for n in (0, 0, 1, 2, size // 60, size // 40, size // 25):
                texts[len(texts)] = edited(rng, words, n)
    words = [f"w{rng.randrange(4000)}" for _ in range(150)]
    for _ in range(80):
        texts[len(texts)] = edited(rng, words, rng.randint(1, 4))
    want, links = brute(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in widehash.near_copies(df).collect()}
    assert 16 < len(set(want.values())) < len(texts) - 100
    assert all(want[a] == want[b] for a in got for b in got if a < b and got[a] == got[b])
    assert sum(got[a] == got[b] for a, b in links) >= 0.97 * len(links)
    kept = pipeline.drop_near_duplicates(spark, df, SMALL)
    assert {r.doc_id for r in kept.collect()} == set(got.values())


def test_crowds_below_the_bound_make_no_rows_of_their_pairs(spark, monkeypatch):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common = say(180)
    own = [say(24) for _ in range(150)]
    texts = dict(enumerate(" ".join(common + x) for x in own + [[*x[:-1], "edit"] for x in own[:30]]))
    want, links = brute(texts)
    assert len(links) == 30
    rows, write = {}, widehash.written

    def counted(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(widehash, "written", counted)
    monkeypatch.setattr(widehash, "BLOCK", 40, raising=False)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in widehash.near_copies(df).collect()}
    assert got == want
    assert rows["pairs"] <= 10 * len(texts) and rows["crowds"] > 0


def test_different_texts_of_one_id_stay(spark):
    rng = random.Random(4)
    say = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(60))
    one = say()
    df = spark.createDataFrame([(1, one, 0), (1, one, 0), (1, say(), 1), (1, say(), 2), (2, one, 3), (None, say(), 4), (None, None, 5), (None, "", 6)], "doc_id long, text string, row_ int")
    df = df.withColumnRenamed("row_", "id_").withColumn("rid", F.col("id_")).withColumn("row", F.col("id_"))
    kept = simhash.keep_first(df, lambda: widehash.near_copies(df))
    assert kept.columns == df.columns and sorted(r.id_ for r in kept.collect())[:4] == [0, 1, 2, 4] and kept.count() == 5


def test_near_copies_of_odd_documents(spark, odd, empty):
    rows = widehash.near_copies(odd).collect()
    assert len(rows) == odd.count() and widehash.near_copies(empty).count() == 0
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == by[3] == 1 and by[6] == by[7] == by[8] == 6 and by[4] == 4 and by[5] == 5
