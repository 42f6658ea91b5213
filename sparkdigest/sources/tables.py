"""State tables in folders: a change log whose commits are numbered files that are created only if they aren't there yet.

A writer stages rows, reads the newest commit, and publishes the next number. If another writer has taken that number meanwhile,
it reads what that one did, brings its own run up to it, and tries the number after. So no commit is ever listed under a version
that a compaction has replaced, and a crash before publishing leaves rows that don't count.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkdigest.operators.state import current

_ENTRY = "name string, run_id string, version long, op_seq long, place int"
#: Times that a writer tries for a number before it gives up, and the longest it waits between two of them, in seconds.
TRIES, WAIT = 50, 0.2


class Run(NamedTuple):
    """Rows that are written but don't count yet, and the version whose folder they lie in."""

    run_id: str
    version: int


class Conflict(RuntimeError):
    """Other writers took every number that a commit tried for."""


class Commits:
    """Numbered commits of a folder: each a file of JSON lines (name, run_id, version), as a whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _where(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The newest number, 0 if there is none."""
        where, fs = self._where(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return max((int(n.partition(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)

    def entries(self, until: int) -> DataFrame:
        """What the commits up to a number list."""
        if not until:
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).json(f"{self.path}/*.json").where(F.col("op_seq") <= until)

    def publish(self, number: int, rows: list[tuple[str, str, int]]) -> bool:
        """Make a commit count under a number; False if the number is taken. The file is written beside and then gets its name,
        which no store that Hadoop counts as consistent gives twice."""
        lines = "".join(json.dumps({"name": n, "run_id": r, "version": v, "op_seq": number, "place": k}) + "\n" for k, (n, r, v) in enumerate(rows))
        jvm = self.spark._jvm
        aside, fs = self._where(f"{self.path}/_{uuid.uuid4().hex}")
        target, _ = self._where(f"{self.path}/{number:012d}.json")
        out = fs.create(aside, True)
        out.write(lines.encode())
        out.close()
        aside, target = fs.makeQualified(aside), fs.makeQualified(target)
        try:
            if aside.toUri().getScheme() == "file":
                files, paths = jvm.java.nio.file.Files, jvm.java.nio.file.Paths
                files.createLink(paths.get(target.toUri()), paths.get(aside.toUri()))
            else:
                none = jvm.org.apache.hadoop.fs.Options.Rename.values()[0]
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, options)
            return True
        except Exception as error:
            if fs.exists(target):
                return False
            raise error
        finally:
            fs.delete(aside, False)

    def commit(self, rows_at: Callable[[int], list[tuple[str, str, int]]]) -> int:
        """Publish what rows_at(newest number) lists under the next number; after a conflict ask it again. Returns the number."""
        for attempt in range(TRIES):
            last = self.last()
            if self.publish(last + 1, rows_at(last)):
                return last + 1
            time.sleep(random.uniform(0, min(WAIT, 0.01 * 2**attempt)))
        raise Conflict(f"no number was free in {self.path}")


class ChangeLog:
    """A table as a log of its changes. Writers append; a reader takes each key's latest row; compaction rewrites.

    Files of a version lie in a folder of its own, those of a run in a folder in it. Commits list the runs that count, with their version; the newest version
    holds, and a reader who names an earlier commit gets the rows as of then, for older versions stay. Tables that are to
    change together share a folder of commits, so that one file of it lists all their runs (commit_all).
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], manifest: str | None = None, name: str | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = f"{schema}, run_id string"
        self.commits = Commits(spark, manifest or f"{self.path}/manifest")
        self.name = name or self.path.rpartition("/")[2]

    def _read(self, version: int) -> DataFrame:
        where, fs = self.commits._where(path := f"{self.path}/v{version}")
        return self.spark.read.schema(self.schema).parquet(path) if fs.exists(where) else self.spark.createDataFrame([], self.schema)

    def _listed(self, until: int) -> DataFrame:
        return self.commits.entries(until).where(F.col("name") == self.name)

    def version(self, until: int | None = None) -> int:
        """The version that holds as of a commit, by default the newest."""
        until = self.commits.last() if until is None else until
        return self._listed(until).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _write(self, rows: DataFrame, run_id: str, version: int) -> None:
        # a folder for each run: writers that share one would clear each other's unfinished files
        rows.write.mode("append").parquet(f"{self.path}/v{version}/run_id={run_id}")

    def stage(self, rows: DataFrame, run_id: str | None = None) -> Run:
        """Write rows; they don't count until commit()."""
        run = Run(run_id or uuid.uuid4().hex, self.version())
        self._write(rows, *run)
        return run

    def carried(self, run: Run, until: int) -> Run:
        """The run in the folder of the version that holds as of a commit; if the table was compacted since it was staged, its
        rows are written there, under a new name, as what an attempt before has written there doesn't count."""
        version = self.version(until)
        if run.version == version:
            return run
        moved = Run(uuid.uuid4().hex, version)
        self._write(self._read(run.version).where(F.col("run_id") == run.run_id).drop("run_id"), *moved)
        return moved

    def commit(self, run: Run) -> int:
        return commit_all([(self, run)])

    def append(self, rows: DataFrame) -> int:
        return self.commit(self.stage(rows))

    def log(self, until: int | None = None) -> DataFrame:
        """All rows that count as of a commit, with the order of their runs as op_seq."""
        until = self.commits.last() if until is None else until
        version = self.version(until)
        # commits have a row for each run; those of the version are few
        order = Window.orderBy("op_seq", "place")
        runs = self._listed(until).where(F.col("version") == version).withColumn("op_seq", F.row_number().over(order).cast("long"))
        return self._read(version).join(runs.select("run_id", "op_seq"), "run_id")

    def rows(self, until: int | None = None) -> DataFrame:
        """The current row of each key, or that as of a commit (a number that snapshot() or a commit gave)."""
        return current(self.log(until), self.keys).drop("op_seq", "run_id")

    def snapshot(self) -> int:
        """A number that names the table as it is now: rows(number) stays the same whatever is written later."""
        return self.commits.last()

    def _replace(self, rows: DataFrame, seen: int, carry: bool) -> int:
        """Make rows, which were read as of commit seen, a new version; runs that were committed since come after them if they
        are to be carried over."""
        base, written, held = uuid.uuid4().hex, set(), self.version(seen)

        def rows_at(last: int) -> list[tuple[str, str, int]]:
            version = self.version(last) + 1
            if version not in written:
                self._write(rows, base, version)
                written.add(version)
            if carry and version - 1 != held:
                raise Conflict(f"{self.path} was replaced meanwhile")
            since = self._listed(last).where(F.col("op_seq") > seen).orderBy("op_seq", "place").collect() if carry and last > seen else []
            runs = [(self.name, base, version)]
            for r in since:
                run = Run(uuid.uuid4().hex, version)
                self._write(self._read(r["version"]).where(F.col("run_id") == r["run_id"]).drop("run_id"), *run)
                runs.append((self.name, *run))
            return runs

        return self.commits.commit(rows_at)

    def compact(self) -> int:
        """Write the current rows as a new version; the old one stays for readers that have it open and for snapshots.
        What others commit meanwhile is carried over; a second compaction at the same time gives up with Conflict."""
        seen = self.snapshot()
        return self._replace(self.rows(seen), seen, carry=True)

    def restore(self, number: int) -> int:
        """Make the rows as of a snapshot the current ones; what was committed after it doesn't count any more."""
        return self._replace(self.rows(number), self.snapshot(), carry=False)

    def reset(self) -> int:
        """Forget all rows; snapshots keep them."""
        return self._replace(self.rows(0), self.snapshot(), carry=False)


def commit_all(staged: Iterable[tuple[ChangeLog, Run]]) -> int:
    """Make the runs of several tables count at once: all their rows are written before, and one file lists them."""
    staged = list(staged)
    if len({log.commits.path for log, _ in staged}) > 1:
        raise ValueError("tables that are committed together must share a manifest")
    if not staged:
        return 0
    first = staged[0][0]
    return first.commits.commit(lambda last: [(log.name, *log.carried(run, last)) for log, run in staged])
