"""Paged scans: which pages are opened, and what comes of them."""

from __future__ import annotations

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from sparkdigest.sources import paged, schemas

EVENT = "id int, calendar string, start timestamp, end timestamp"


class Counting(paged.FolderClient):
    """Leaves a file for each page that is opened."""

    def page(self, token, wanted):
        os.makedirs(f"{self.folder}/opened", exist_ok=True)
        open(f"{self.folder}/opened/{token.replace('/', '+')}~{uuid.uuid4().hex}", "w").close()
        return super().page(token, wanted)


class CountingSource(paged.PagedSource):
    @classmethod
    def name(cls):
        return "counted"

    def client(self):
        return Counting(self.options["path"])


def _opened(folder):
    path = f"{folder}/opened"
    return sorted(x.partition("~")[0].replace("+", "/") for x in os.listdir(path)) if os.path.isdir(path) else []


def _pages(folder, chains=3, pages=4, rows=5, index=False):
    """Chains of pages with a row an hour; chain c begins on day 1 + 10 c."""
    os.makedirs(f"{folder}/next", exist_ok=True)
    listed, k = {}, 0
    for c in range(chains):
        names = [f"c{c}.json", *(f"next/c{c}-{p}.json" for p in range(1, pages))]
        for p, name in enumerate(names):
            after = names[p + 1] if p + 1 < pages else None
            items = []
            for r in range(rows):
                day, hour = 1 + 10 * c, p * rows + r
                items.append({"id": k, "calendar": f"c{c}", "start": f"2024-01-{day:02d}T{hour:02d}:00:00Z", "end": f"2024-01-{day:02d}T{hour:02d}:30:00+00:00"})
                k += 1
            with open(f"{folder}/{name}", "w") as f:
                json.dump({"items": items, "next": after}, f)
            listed[name] = {"least": {"start": items[0]["start"], "end": items[0]["end"], "calendar": f"c{c}"}, "most": {"start": items[-1]["start"], "end": items[-1]["end"], "calendar": f"c{c}"}, "next": after}
    if index:
        with open(f"{folder}/index.json", "w") as f:
            json.dump(listed, f)


def _read(spark, folder, schema=EVENT, **options):
    paged.register(spark, CountingSource)
    return spark.read.format("counted").schema(schema).options(**options).option("path", str(folder)).load()


def test_chains_are_followed_each_in_its_partition(spark, tmp_path):
    _pages(tmp_path)
    df = _read(spark, tmp_path)
    assert df.rdd.getNumPartitions() == 3 and _opened(tmp_path) == []
    assert sorted(r.id for r in df.collect()) == list(range(60))


@pytest.mark.parametrize(("limit", "pages"), [(-1, 0), (0, 0), (1, 1), (5, 1), (6, 2), (20, 4), (21, 5), (1000, 12)])
def test_a_limit_stops_the_paging(spark, tmp_path, limit, pages):
    _pages(tmp_path)
    df = _read(spark, tmp_path, limit=limit)
    assert [r.id for r in df.collect()] == list(range(max(0, min(limit, 60))))
    assert len(_opened(tmp_path)) == pages
    assert df.rdd.getNumPartitions() <= 1


def test_pages_outside_a_window_are_never_opened(spark, tmp_path):
    _pages(tmp_path, index=True)
    df = schemas.in_window(_read(spark, tmp_path), "2024-01-11T05:30:00Z", "2024-01-11T10:00:00Z").select("id")
    assert sorted(r.id for r in df.collect()) == [26, 27, 28, 29]  # the first ends as the window begins, 10:00 is outside
    assert _opened(tmp_path) == ["next/c1-1.json"]
    assert df.rdd.getNumPartitions() == 1


def test_without_an_index_the_filters_still_hold(spark, tmp_path):
    _pages(tmp_path)
    df = schemas.in_window(_read(spark, tmp_path), "2024-01-11T05:30:00Z", "2024-01-11T10:00:00Z")
    assert sorted(r.id for r in df.collect()) == [26, 27, 28, 29] and len(_opened(tmp_path)) == 12


def test_equality_sets_and_residual_filters(spark, tmp_path):
    _pages(tmp_path, index=True)
    df = _read(spark, tmp_path).where(F.col("calendar").isin("c0", "c2") & (F.col("id") % 7 == 0))
    assert sorted(r.id for r in df.collect()) == [k for k in range(60) if k % 7 == 0 and k // 20 != 1]
    assert not [x for x in _opened(tmp_path) if "c1" in x]
    assert _read(spark, tmp_path).where("calendar = 'none'").count() == 0


def test_columns_that_items_lack_and_odd_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"items": [{"id": 1}, {"id": null, "calendar": "x"}, {}], "next": "next/b.json"}')
    os.makedirs(tmp_path / "next")
    (tmp_path / "next/b.json").write_text('{"items": null}')
    assert sorted(map(tuple, _read(spark, tmp_path, "id int, calendar string").collect()), key=str) == [(1, None), (None, "x"), (None, None)]
    assert [tuple(r) for r in _read(spark, tmp_path, "id int").where("id >= 0").collect()] == [(1,)]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert _read(spark, empty, "id int").count() == 0


def test_a_stream_takes_each_page_once(spark, tmp_path):
    folder = tmp_path / "pages"
    _pages(folder, chains=2, pages=2)
    paged.register(spark)

    def run():
        stream = spark.readStream.format("paged").schema("id int, calendar string").option("path", str(folder)).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(20))
    _pages(folder, chains=3, pages=3)  # a longer first and second chain, and a third one, with other ids
    again = run()
    assert len(again) == 20 + 5 + 5 + 15
    assert run() == again


def test_mails_by_label_time_and_force(spark):
    rows = [("new", "1704067200000", ["INBOX"]), ("done", "1704067200000", ["Processed"]), ("bad", "1704067200000", ["Failed", "INBOX"]), ("old", "1600000000000", None), ("seen", "1704067200000", None), ("odd", "x", None), ("null", None, None)]
    raw = spark.createDataFrame([(i, "t", at, labels, [], None) for i, at, labels in rows], schemas.MAIL)
    done = spark.createDataFrame([("seen",)], "id string")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(schemas.mails(raw, 7, "2024-01-03 00:00:00", done)) == ["new"]
    assert ids(schemas.mails(raw, 7, "2024-01-03 00:00:00", done, force=True)) == ["bad", "done", "new", "seen"]
    assert ids(schemas.mails(raw, done=done)) == ["new", "null", "odd", "old"]
    assert schemas.mail_search("from:a", 7) == '(from:a) newer_than:7d -label:"Processed" -label:"Failed"'
    assert schemas.mail_search("from:a", 7, force=True) == "(from:a) newer_than:7d"
