"""State in streams against their batch twins and plain Python."""

from __future__ import annotations

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkdigest.streaming import state

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, state.ROCKS)
    yield spark
    spark.conf.set(key, before)


def _at(minutes):
    return None if minutes is None else DAY + dt.timedelta(minutes=minutes)


def _events(seed, n):
    rng = random.Random(seed)
    rows, seq = [], 0
    for minute in range(n):
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice(["planned", "planned", "failed", "failed", "sent", "cancelled", "odd"])
            start = minute + rng.choice([0, 1, 3, 10, 40]) if kind == "planned" and rng.random() < 0.9 else None
            rows.append((f"a{rng.randint(0, 11)}", _at(minute), seq, kind, _at(None if start is None else start - 5), _at(start)))
            seq += 1
    return rows


def _plain(rows, now):
    out, held = [], {}
    for key, at, seq, kind, reminder, start in [*rows, *((k, now, 1 << 40, None, None, None) for k in dict.fromkeys(r[0] for r in rows))]:
        s = held.get(key)
        if s and s[0] in state.OPEN and at >= s[3]:
            s = held[key] = ("expired", *s[1:])
            out.append((key, s[3], -1, *s[:2]))
        if kind == "planned" and reminder and start and (not s or s[0] in state.OPEN and s[2:] != (reminder, start)):
            held[key] = ("pending", 0, reminder, start)
            out.append((key, at, seq, "pending", 0))
        elif kind in state.BECOMES and s and s[0] in state.OPEN:
            held[key] = (state.BECOMES[kind], s[1] + (kind == "failed"), *s[2:])
            out.append((key, at, seq, *held[key][:2]))
    return sorted(out)


def _run(spark, stream, folder, name):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.read.parquet(f"{folder}/{name}")


def _run_until(spark, stream, folder, rows):
    """Run until so many rows are there: a query in processing time never says that it is done."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/out-state").trigger(processingTime="1 second").start()
    end = time.time() + 120
    while time.time() < end and query.exception() is None:
        if os.path.isdir(f"{folder}/out/_spark_metadata") and spark.read.schema(state.ANSWER).parquet(f"{folder}/out").count() >= rows:
            break
        time.sleep(0.5)
    query.stop()
    return spark.read.schema(state.ANSWER).parquet(f"{folder}/out")


def test_transitions_equal_plain_python(spark):
    rows = _events(1, 60)
    df = state.attempt_transitions(spark.createDataFrame([*rows, (None, DAY, 0, "planned", DAY, DAY), ("late", _at(999), 0, "planned", _at(1000), _at(1001))], state.EVENT), F.lit(_at(70)))
    assert sorted(map(tuple, df.collect())) == _plain(rows, _at(70)) != []


def test_the_stream_gives_the_transitions_of_the_batch(rocks, tmp_path):
    rows = _events(2, 40)
    for k in range(0, len(rows), 25):  # several micro-batches, each in order
        rocks.createDataFrame(rows[k : k + 25], state.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken by their time
    # the clock goes on to the end, so that timers fire; one more row lets the watermark of the last batch count
    for minute in (200, 201):
        rocks.createDataFrame([("clock", _at(minute), 0, "tick", None, None)], state.EVENT).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = rocks.readStream.schema(state.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = _run(rocks, state.attempt_stream(stream), tmp_path, "out")
    batch = state.attempt_transitions(rocks.createDataFrame(rows, state.EVENT), F.lit(_at(200)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect())) == _plain(rows, _at(200))


def _resolver(url):
    return (None, "failed") if "bad" in url else (url + "/final", "resolved")


def test_an_expired_entry_is_not_served(rocks, tmp_path):
    links = [(f"h{k % 5}", "bad" if k % 5 < 2 else "good", _at(k)) for k in range(40)]
    good, bad = 16 * 60, 6 * 60
    for k in (0, 20):
        rocks.createDataFrame(links[k : k + 20], state.LINK).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = rocks.readStream.schema(state.LINK).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    found = _run_until(rocks, state.resolved_stream(stream, _resolver, good, bad), tmp_path, len(links))
    twin = state.served_from_cache(rocks.createDataFrame(links, state.LINK), F.col("url") == "good", good, bad)
    rows = found.select("url_hash", "at", "served").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, twin.collect()))
    served = {(r.url_hash, r.at): r.served for r in rows}
    assert served["h0", _at(5)] and not served["h0", _at(10)] and served["h2", _at(17)] and not served["h2", _at(22)]
    assert {(r.status, r.final_url) for r in found.collect()} == {("failed", None), ("resolved", "good/final")}


def test_spark_forgets_an_entry_after_its_time_to_live(rocks, tmp_path):
    def answer(rows, minute):
        rocks.createDataFrame([("h", "good", _at(minute))], state.LINK).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = rocks.readStream.schema(state.LINK).json(str(tmp_path / "in"))
        out = _run_until(rocks, state.resolved_stream(stream, _resolver, 20, 20), tmp_path, rows)
        return [r.served for r in out.where(F.col("at") == F.lit(_at(minute))).collect()]

    assert answer(1, 0) == [False]
    time.sleep(21)
    assert answer(2, 0.1) == [False]  # by the rows' clock it would still hold
