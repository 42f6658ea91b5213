"""Change logs under writers that cross each other, and as of an earlier commit."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from sparkdigest.sources import tables

SCHEMA = "k int, v string"


def _log(spark, path, **more):
    return tables.ChangeLog(spark, str(path), SCHEMA, ["k"], **more)


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def _now(log, *at):
    return sorted(map(tuple, log.rows(*at).collect()))


def _once(log, name, then):
    """Run then() right after the first call of a method of log."""
    whole, left = getattr(log, name), [then]

    def wrapped(*args):
        out = whole(*args)
        if left:
            left.pop()()
        return out

    setattr(log, name, wrapped)


def test_a_commit_inside_a_compaction_counts(spark, tmp_path):
    log, other = _log(spark, tmp_path / "t"), _log(spark, tmp_path / "t")
    log.append(_rows(spark, (1, "a"), (2, "b")))
    _once(log, "_write", lambda: other.append(_rows(spark, (2, "meanwhile"), (3, "c"))))
    log.compact()
    assert _now(log) == [(1, "a"), (2, "meanwhile"), (3, "c")]
    log.append(_rows(spark, (3, "later")))
    assert _now(other) == [(1, "a"), (2, "meanwhile"), (3, "later")]


def test_a_compaction_inside_a_commit_keeps_the_run(spark, tmp_path):
    log, other = _log(spark, tmp_path / "t"), _log(spark, tmp_path / "t")
    log.append(_rows(spark, (1, "a")))
    run = log.stage(_rows(spark, (1, "b")))
    _once(log, "carried", other.compact)  # after the run was found in place, before the number is taken
    log.commit(run)
    assert _now(log) == [(1, "b")] and log.version() == 1


def test_commits_at_once_all_count(spark, tmp_path):
    logs = [_log(spark, tmp_path / "t") for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: logs[k].append(_rows(spark, (k, f"of {k}"))), range(4)))
    assert sorted(numbers) == [1, 2, 3, 4]
    assert _now(logs[0]) == [(k, f"of {k}") for k in range(4)]


def test_a_crash_before_publishing_leaves_nothing(spark, tmp_path, monkeypatch):
    log = _log(spark, tmp_path / "t")
    log.append(_rows(spark, (1, "a")))
    with monkeypatch.context() as m:
        m.setattr(log.commits, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        for act in (lambda: log.append(_rows(spark, (1, "b"))), log.compact, log.reset):
            with pytest.raises(OSError, match="lost"):
                act()
    assert _now(log) == [(1, "a")] and log.version() == 0
    log.compact()  # the folder of version 1 holds what the crashed ones wrote
    assert _now(log) == [(1, "a")] and log.version() == 1


def test_a_second_compaction_gives_up(spark, tmp_path):
    log, other = _log(spark, tmp_path / "t"), _log(spark, tmp_path / "t")
    log.append(_rows(spark, (1, "a")))
    _once(log, "_write", other.reset)
    with pytest.raises(tables.Conflict):
        log.compact()
    assert _now(log) == []


def test_writers_that_always_lose_say_so(spark, tmp_path, monkeypatch):
    log = _log(spark, tmp_path / "t")
    monkeypatch.setattr(tables, "TRIES", 3)
    monkeypatch.setattr(log.commits, "publish", lambda *_: False)
    with pytest.raises(tables.Conflict):
        log.append(_rows(spark, (1, "a")))


def test_snapshots_restore_and_reset(spark, tmp_path):
    log = _log(spark, tmp_path / "t")
    log.append(_rows(spark, (1, "a"), (2, "b")))
    backup = log.snapshot()
    log.append(_rows(spark, (1, "x")))
    log.compact()
    log.append(_rows(spark, (3, "c")))
    assert _now(log, backup) == [(1, "a"), (2, "b")] and _now(log) == [(1, "x"), (2, "b"), (3, "c")]
    log.reset()
    assert _now(log) == [] and _now(log, backup) == [(1, "a"), (2, "b")]
    log.restore(backup)
    log.append(_rows(spark, (4, "d")))
    assert _now(log) == [(1, "a"), (2, "b"), (4, "d")]


def test_tables_with_one_folder_of_commits_don_t_disturb_each_other(spark, tmp_path):
    a, b = (_log(spark, tmp_path / n, manifest=str(tmp_path / "m")) for n in ("a", "b"))
    _once(a, "_write", lambda: b.append(_rows(spark, (9, "b"))))
    a.append(_rows(spark, (1, "a")))
    _once(b, "_write", lambda: a.append(_rows(spark, (2, "a"))))
    b.compact()
    assert _now(a) == [(1, "a"), (2, "a")] and _now(b) == [(9, "b")]
    assert a.version() == 0 and b.version() == 1
