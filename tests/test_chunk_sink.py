"""The sink of chunked deliveries against a scripted service."""

from __future__ import annotations

import json
import os

import pytest

from sparkdigest.sources import chunk_sink as sink


class Waits(list):
    def __call__(self, seconds):
        self.append(seconds)


def _row(delivery, *chunks, transport="webhook"):
    return (delivery, "d", transport, list(chunks))


def _write(spark, path, *rows):
    sink.register(spark)
    df = spark.createDataFrame(list(rows), sink.DELIVERY).repartition(2, "delivery_id")
    df.write.format("chunks").mode("append").option("path", str(path)).option("waitScale", "0").save()


def _log(spark, path):
    return sorted(tuple(r) for r in sink.log(spark, str(path)).select("delivery_id", "n_chunks", "n_sent", "error").collect())


def _notes(path, delivery):
    return sink.Notes(os.path.join(path, "notes")).taken("d", delivery)


def test_a_delivery_that_failed_on_the_second_of_three_goes_on_there(spark, tmp_path):
    _write(spark, tmp_path, _row("a", "one|200", "two|502", "three|200"))
    first = _notes(tmp_path, "a")
    assert _log(spark, tmp_path) == [("a", 3, 1, sink.FAILED)] and len(first) == 1
    _write(spark, tmp_path, _row("a", "one|lost", "two|200", "three|200"))  # the first chunk must not be asked for again
    assert _log(spark, tmp_path) == [("a", 3, 1, sink.FAILED), ("a", 3, 3, None)]
    assert _notes(tmp_path, "a")[:1] == first and len(_notes(tmp_path, "a")) == 3


@pytest.mark.parametrize(
    ("answers", "transport", "error"),
    [
        ("429 429 429 200", "webhook", None),
        ("429", "webhook", sink.LIMITED),
        ("502 503 500 200", "bot", None),
        ("500", "bot", sink.FAILED),
        ("401", "bot", "DISCORD_BOT_UNAUTHORIZED"),
        ("403", "bot", "DISCORD_BOT_FORBIDDEN"),
        ("404", "bot", "DISCORD_BOT_CHANNEL_NOT_FOUND"),
        ("404", "webhook", sink.FAILED),
        ("none", "webhook", sink.FAILED),
        ("lost 200", "webhook", sink.FAILED),
    ],
)
def test_answers(tmp_path, answers, transport, error):
    row = {"delivery_id": "a", "destination": "d", "transport": transport, "chunks": [f"x|{answers}"]}
    assert sink.delivered(row, sink.ScriptedService(), sink.Notes(str(tmp_path)), Waits()) == (int(error is None), error)


def test_waits_are_clamped_and_doubled():
    waits = Waits()
    sink.sent(sink.ScriptedService(), "d", "bot", "x|429:120 429:-5 429:soon 200", waits)
    sink.sent(sink.ScriptedService(), "d", "bot", "x|500 429 502 200", waits)
    sink.sent(sink.ScriptedService(), "d", "bot", "x|429:2.5 200", waits)
    assert waits == [30.0, 0.0, 1.0, 1.0, 1.0, 4.0, 2.5]


def test_odd_rows_and_notes(spark, tmp_path):
    notes = sink.Notes(str(tmp_path / "notes"))
    for delivery, text in (("corrupt", "{]\n"), ("number", "7\n"), ("torn", '"one"\n"tw'), ("more", '"1"\n"2"\n')):
        notes.add("d", delivery, "x")
        with open(notes._path("d", delivery), "w", encoding="utf-8") as f:
            f.write(text)
    rows = [_row("corrupt", "a"), _row("number", "a"), _row("torn", "a", "b"), _row("more", "a"), (None, None, None, None), _row("empty"), ("null", "d", "bot", [None])]
    _write(spark, tmp_path, *rows)
    found = {r[0]: r[1:] for r in map(tuple, sink.log(spark, str(tmp_path)).select("delivery_id", "n_chunks", "n_sent", "error").collect())}
    assert found == {"corrupt": (1, 0, sink.CORRUPT), "number": (1, 0, sink.CORRUPT), "torn": (2, 2, None), "more": (1, 2, sink.FAILED), None: (0, 0, None), "empty": (0, 0, None), "null": (1, 1, None)}


def test_nothing_counts_without_a_commit(spark, tmp_path):
    _write(spark, tmp_path, _row("a", "x"))
    with open(tmp_path / "log" / "stray.json", "w") as f:
        f.write(json.dumps({"delivery_id": "b"}))
    assert _log(spark, tmp_path) == [("a", 1, 1, None)]
    with pytest.raises(Exception, match="taken back"):
        spark.createDataFrame([_row("a")], sink.DELIVERY).write.format("chunks").mode("overwrite").option("path", str(tmp_path)).save()


def test_stream_gives_the_log_of_the_batch(spark, tmp_path):
    rows = [_row(f"d{k}", *[f"{k}.{c}|{'502' if (k, c) in ((2, 1), (3, 0)) else '429 200'}" for c in range(k % 4)]) for k in range(8)]
    _write(spark, tmp_path / "batch", *rows)
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, sink.DELIVERY).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(sink.DELIVERY).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    writer = stream.writeStream.format("chunks").option("path", str(tmp_path / "stream")).option("waitScale", "0")
    for _ in range(2):  # the second start finds nothing new
        query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
    assert _log(spark, tmp_path / "stream") == _log(spark, tmp_path / "batch") != []
    assert len(os.listdir(tmp_path / "stream" / "commits")) == 2


def test_notes_of_many_deliveries_share_files(tmp_path, monkeypatch):
    monkeypatch.setattr(sink, "BUCKETS", 4)
    monkeypatch.setattr(sink, "OPEN", 2)
    forced = []
    monkeypatch.setattr(sink.os, "fsync", forced.append)
    rows = [{"delivery_id": f"é{k}", "destination": "d", "transport": "bot", "chunks": ["a", "b|200" if k % 2 else "b|502"]} for k in range(90)]
    rows.sort(key=lambda r: sink.Notes("")._bucket("d", r["delivery_id"]))
    notes = sink.TaskNotes(str(tmp_path))
    assert [sink.delivered(r, sink.ScriptedService(), notes, Waits())[0] for r in rows] == [1 + int(r["delivery_id"][1:]) % 2 for r in rows]
    notes.close()
    assert sum(len(files) for _, _, files in os.walk(tmp_path)) == 4
    assert len(forced) < 90  # 135 chunks were taken
    again, lost = sink.TaskNotes(str(tmp_path)), [r | {"chunks": ["a|lost", "b|200"]} for r in rows]
    assert [sink.delivered(r, sink.ScriptedService(), again, Waits()) for r in lost] == [(2, None)] * 90
    again.close()
    assert all(len(sink.Notes(str(tmp_path)).taken("d", r["delivery_id"])) == 2 for r in rows)


def test_an_unreadable_line_stops_its_bucket_and_a_torn_one_does_not(tmp_path):
    notes = sink.TaskNotes(str(tmp_path))
    notes.add("d", "a", "1")
    notes.close()
    bucket = notes._bucket("d", "a")
    with open(os.path.join(bucket, notes.name), "a") as f:
        f.write('["d", "a", 1, "tw')
    assert sink.TaskNotes(str(tmp_path)).taken("d", "a") == ["1"]
    with open(os.path.join(bucket, "other"), "w") as f:
        f.write("{]\n")
    with pytest.raises(sink.DeliveryError, match=sink.CORRUPT):
        sink.TaskNotes(str(tmp_path)).taken("d", "a")


def test_dealt_deliveries_of_one_file_go_to_all_tasks(spark, tmp_path):
    sink.register(spark)
    df = spark.createDataFrame([_row(f"d{k}", "x") for k in range(200)], sink.DELIVERY).coalesce(1)
    for _ in range(2):
        sink.dealt(df).write.format("chunks").mode("append").option("path", str(tmp_path)).save()
    assert len(os.listdir(tmp_path / "log")) == 8
    assert _log(spark, tmp_path) == sorted([(f"d{k}", 1, 1, None) for k in range(200)] * 2)
    one = {(r.file, sink.Notes("")._bucket("d", r.delivery_id)) for r in sink.log(spark, str(tmp_path)).selectExpr("delivery_id", "input_file_name() file").collect()}
    assert len(one) == 2 * len({b for _, b in one})  # a bucket is one task's in each run
