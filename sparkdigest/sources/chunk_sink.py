"""Deliveries of chunked messages as a data sink, for batches and for streams.

A row is a delivery: its id, its destination, and its chunks in order. Each chunk is tried up to TRIES times; after each one that is
taken its message id is put down, so that whatever comes back later (a task that is tried again, a run after a crash, the next
micro-batch) goes on with the chunk after it. Tasks put down what became of their deliveries in files of their own, which count
once the driver's commit lists them.

    spark.dataSource.register(MySink)     # a ChunkSink whose service() talks to the real one
    dealt(deliveries).write.format("chunks").mode("append").option("path", folder).save()
    deliveries.writeStream.format("chunks").option("path", folder).option("checkpointLocation", ...).start()

Notes lie in BUCKETS folders by a hash of the delivery, a file for each task and bucket, so that any task finds those of any run.
dealt() gives each bucket to one task, which reads it once; without it the result is the same, but each task reads the buckets that
it meets. A note is written before the next chunk is sent, and forced to the disk unless that was done within the last SYNC seconds.

A live service may take a chunk twice only if a task dies between its answer and the note of it, if a machine loses its power within
SYNC seconds of the note, or if speculative tasks run: leave spark.speculation off. The folder must be one that driver and executors see.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

DELIVERY = "delivery_id string, destination string, transport string, chunks array<string>"
LOG = "delivery_id string, destination string, n_chunks int, n_sent int, error string"

# Tries of a chunk, the wait that is asked for at most, and error codes.
TRIES, LONGEST_WAIT = 4, 30.0
FAILED, LIMITED, CORRUPT = "DISCORD_DELIVERY_FAILED", "DISCORD_RATE_LIMITED", "DISCORD_MESSAGE_IDS_CORRUPT"
#: Folders of notes; seconds between two times that notes are forced to the disk; buckets that a task keeps open.
BUCKETS, SYNC, OPEN = 4096, 0.02, 64
REFUSED = {401: "DISCORD_BOT_UNAUTHORIZED", 403: "DISCORD_BOT_FORBIDDEN", 404: "DISCORD_BOT_CHANNEL_NOT_FOUND"}


class DeliveryError(RuntimeError):
    """What ends a delivery; its text is the error code."""


@dataclass(frozen=True)
class Reply:
    """A service's answer: its status, the id of the message it made, and the wait it asks for, as its header says it."""

    status: int
    message_id: str | None = None
    retry_after: str | None = None


class Service(Protocol):
    """What the sink needs of a service. An OSError means that nobody knows whether the chunk was taken: it isn't tried again."""

    def post(self, destination: str, transport: str, chunk: str) -> Reply: ...


class ScriptedService:
    """Stand-in without a network: a chunk's words after the first | are the answers to its tries, in turn, the last one for all
    further tries: 200, 429:2.5 (asks for a wait), 502, none (an answer without an id), lost (no answer)."""

    def __init__(self) -> None:
        self.asked: dict[tuple[str, str], int] = {}

    def post(self, destination: str, transport: str, chunk: str) -> Reply:
        answers = chunk.partition("|")[2].split() or ["200"]
        k = self.asked[destination, chunk] = self.asked.get((destination, chunk), -1) + 1
        status, _, wait = answers[min(k, len(answers) - 1)].partition(":")
        if status == "lost":
            raise OSError("no answer")
        if status == "none":
            return Reply(200)
        return Reply(int(status), hashlib.md5(f"{destination} {chunk}".encode()).hexdigest()[:12] if status == "200" else None, wait or None)


class Notes:
    """Message ids of the chunks that were taken, in order.

    They are in the files of the delivery's bucket, as lines of destination, delivery, place and id, after those of a file of the
    delivery's own, as add() and earlier versions write it; a line without its end doesn't count.
    """

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, destination: str, delivery: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(json.dumps([destination, delivery]).encode()).hexdigest())

    def _bucket(self, destination: str, delivery: str) -> str:
        return os.path.join(self.folder, f"b{zlib.crc32(f'{destination}:{delivery}'.encode('utf-8', 'replace')) % BUCKETS:03x}")

    def _listed(self, bucket: str) -> dict[tuple[str, str], dict[int, str]] | None:
        """Ids by place of all deliveries of a bucket, None if some line of it can't be read: nobody knows whose it is."""
        found: dict[tuple[str, str], dict[int, str]] = {}
        for name in sorted(os.listdir(bucket)) if os.path.isdir(bucket) else []:
            try:
                for line in _whole_lines(os.path.join(bucket, name)):
                    destination, delivery, place, message_id = json.loads(line)
                    found.setdefault((destination, delivery), {})[place] = message_id
            except (TypeError, ValueError):
                return None
        return found

    def taken(self, destination: str, delivery: str) -> list[str]:
        listed = self._listed(self._bucket(destination, delivery))
        try:
            ids = [json.loads(x) for x in _whole_lines(self._path(destination, delivery))]
        except FileNotFoundError:
            ids = []
        except ValueError:
            raise DeliveryError(CORRUPT) from None
        if listed is None:
            raise DeliveryError(CORRUPT)
        ids += [x for _, x in sorted(listed.get((destination, delivery), {}).items())]
        if not all(isinstance(x, str) for x in ids):
            raise DeliveryError(CORRUPT)
        return ids

    def add(self, destination: str, delivery: str, message_id: str) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(self._path(destination, delivery), "a", encoding="utf-8") as f:
            f.write(json.dumps(message_id) + "\n")
            f.flush()
            os.fsync(f.fileno())


def _whole_lines(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x for x in f if x.endswith("\n")]


class TaskNotes(Notes):
    """The notes of a task: a bucket is read when its first delivery comes, and the task adds to a file of its own in it. The last
    OPEN buckets are kept."""

    def __init__(self, folder: str):
        super().__init__(folder)
        self.name, self.synced = uuid.uuid4().hex, time.monotonic()
        self.known: dict[str, dict | None] = {}
        self.files: dict[str, int] = {}
        self.fresh: set[int] = set()

    def _listed(self, bucket: str) -> dict[tuple[str, str], dict[int, str]] | None:
        if bucket not in self.known:
            if len(self.known) >= OPEN:
                self._leave(next(iter(self.known)))
            self.known[bucket] = super()._listed(bucket)
        return self.known[bucket]

    def _leave(self, bucket: str) -> None:
        del self.known[bucket]
        if (file := self.files.pop(bucket, None)) is not None:
            if file in self.fresh:
                os.fsync(file)
            self.fresh.discard(file)
            os.close(file)

    def add(self, destination: str, delivery: str, message_id: str) -> None:
        bucket = self._bucket(destination, delivery)
        own = self._listed(bucket).setdefault((destination, delivery), {})
        place = max(own, default=-1) + 1
        if (file := self.files.get(bucket)) is None:
            os.makedirs(bucket, exist_ok=True)
            file = self.files[bucket] = os.open(os.path.join(bucket, self.name), os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o666)
        line = (json.dumps([destination, delivery, place, message_id]) + "\n").encode()
        if os.write(file, line) < len(line):
            raise OSError("a note was not written whole")
        own[place] = message_id
        self.fresh.add(file)
        if time.monotonic() - self.synced >= SYNC:
            self.sync()

    def sync(self) -> None:
        """Force what was noted to the disk."""
        for file in self.fresh:
            os.fsync(file)
        self.fresh.clear()
        self.synced = time.monotonic()

    def close(self) -> None:
        for bucket in [*self.known]:
            self._leave(bucket)


def wait_of(reply: Reply, attempt: int) -> float:
    """Seconds before the next try: what a busy service asks for, from 0 to LONGEST_WAIT, one if it names none or no number;
    twice as long each time for a broken one."""
    if reply.status != 429:
        return 2.0**attempt
    try:
        asked = float(1 if reply.retry_after is None else reply.retry_after)
    except ValueError:
        return 1.0
    return max(0.0, min(asked, LONGEST_WAIT))


def error_of(reply: Reply, transport: str) -> str:
    """The code of an answer that ends a delivery."""
    if reply.status == 429:
        return LIMITED
    return REFUSED.get(reply.status, FAILED) if transport == "bot" else FAILED


def sent(service: Service, destination: str, transport: str, chunk: str, sleep: Callable[[float], None]) -> str:
    """The id of the message made of a chunk."""
    for attempt in range(TRIES):
        try:
            reply = service.post(destination, transport, chunk)
        except OSError:
            raise DeliveryError(FAILED) from None
        if reply.status < 400:
            if reply.message_id is None:
                raise DeliveryError(FAILED)
            return reply.message_id
        if attempt == TRIES - 1 or not (reply.status == 429 or reply.status >= 500):
            raise DeliveryError(error_of(reply, transport))
        sleep(wait_of(reply, attempt))
    raise AssertionError("unreachable")


def delivered(row: Row, service: Service, notes: Notes, sleep: Callable[[float], None]) -> tuple[int, str | None]:
    """(chunks taken so far, error) after a delivery has gone on where it stood. Null chunks are empty ones."""
    destination, delivery = row["destination"] or "", row["delivery_id"] or ""
    chunks = [x or "" for x in row["chunks"] or []]
    try:
        done = len(notes.taken(destination, delivery))
    except DeliveryError as e:
        return 0, str(e)
    if done > len(chunks):
        return done, FAILED
    for chunk in chunks[done:]:
        try:
            notes.add(destination, delivery, sent(service, destination, row["transport"] or "", chunk, sleep))
        except DeliveryError as e:
            return done, str(e)
        done += 1
    return done, None


@dataclass
class Told(WriterCommitMessage):
    """What a task has put down: the name of its file and its numbers of deliveries."""

    file: str
    ended: int
    failed: int


class _Writer:
    """What the writers for batches and for streams share."""

    def __init__(self, sink: ChunkSink, overwrite: bool = False):
        self.sink, self.path = sink, sink.options["path"]
        if overwrite:
            raise ValueError("deliveries can't be taken back; use mode append")

    def write(self, iterator: Iterator[Row]) -> Told:
        service, notes = self.sink.service(), TaskNotes(os.path.join(self.path, "notes"))

        def sleep(seconds: float) -> None:
            notes.sync()
            self.sink.sleep(seconds)

        told = Told(f"{uuid.uuid4().hex}.json", 0, 0)
        os.makedirs(folder := os.path.join(self.path, "log"), exist_ok=True)
        try:
            with open(os.path.join(folder, told.file), "w", encoding="utf-8") as f:
                for row in iterator:
                    n, error = delivered(row, service, notes, sleep)
                    f.write(json.dumps({"delivery_id": row["delivery_id"], "destination": row["destination"], "n_chunks": len(row["chunks"] or []), "n_sent": n, "error": error}) + "\n")
                    told.ended, told.failed = told.ended + (error is None), told.failed + (error is not None)
        finally:
            notes.close()
        return told

    def _count(self, messages: list[WriterCommitMessage | None], name: str) -> None:
        """List the files of a commit: written beside, then named, so that it is there as a whole or not at all."""
        os.makedirs(folder := os.path.join(self.path, "commits"), exist_ok=True)
        aside = os.path.join(folder, f".{uuid.uuid4().hex}")
        with open(aside, "w", encoding="utf-8") as f:
            json.dump([m.file for m in messages if m], f)
        os.replace(aside, os.path.join(folder, name))

    def _drop(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files that no commit lists; what was sent stays noted."""
        for m in messages:
            if m:
                os.remove(os.path.join(self.path, "log", m.file))


class ChunkWriter(_Writer, DataSourceWriter):
    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._count(messages, f"{time.time_ns():020d}-{uuid.uuid4().hex}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop(messages)


class ChunkStreamWriter(_Writer, DataSourceStreamWriter):
    """A micro-batch that comes again after a crash has the number it had, and replaces what it had listed."""

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self._count(messages, f"stream-{batchId:012d}.json")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self._drop(messages)


class ChunkSink(DataSource):
    """Rows of DELIVERY. Subclass it with the service of a live destination."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def service(self) -> Service:
        return ScriptedService()

    def sleep(self, seconds: float) -> None:
        time.sleep(seconds * float(self.options.get("waitscale", "1")))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ChunkWriter(self, overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return ChunkStreamWriter(self)


def register(spark: SparkSession, sink: type[ChunkSink] = ChunkSink) -> None:
    spark.dataSource.register(sink)


def dealt(deliveries: DataFrame) -> DataFrame:
    """deliveries, each bucket of notes in one task and in one stretch of it; all tasks have some, however few the files they came in."""
    key: Column = F.concat_ws(":", F.coalesce("destination", F.lit("")), F.coalesce("delivery_id", F.lit("")))
    bucket = F.crc32(key.cast("binary")) % BUCKETS
    tasks = int(deliveries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return deliveries.repartition(tasks, bucket).sortWithinPartitions(bucket)


def log(spark: SparkSession, path: str) -> DataFrame:
    """LOG of the commits in a sink's folder, with the file of each row; a delivery has a row for each run that had it."""
    folder = os.path.join(path, "commits")
    names = sorted(x for x in os.listdir(folder) if x.endswith(".json")) if os.path.isdir(folder) else []
    files = []
    for name in names:
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            files += [os.path.join(path, "log", x) for x in json.load(f)]
    return spark.read.schema(LOG).json(files) if files else spark.createDataFrame([], LOG)
