"""What the training-data operators share: tables, shared scratch tables, Arrow batches, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: glibc's function that gives freed memory back to the system; none elsewhere.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Rows of whole texts that a Python worker works on at once; Spark bounds the bytes of the batches that they come in.
TEXT_BATCH = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark (the folder may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(batches: Iterable[pa.RecordBatch], rows: int = TEXT_BATCH) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, which share their memory."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Returns memory that is free to the system: Arrow's and malloc's."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run() for mapInArrow, after which the worker, which Spark keeps for later tasks, gives its free memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table. createDataFrame([]) would read it through an RDD of Python objects, for which each executor starts another
    Python daemon and its workers, and keeps them."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(schema)])


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, which the cluster sizes to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset on a local master (tests) a temporary one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sparkdigest-"))
        where = sc.getCheckpointDir()
    return where


def _scratch(spark: SparkSession) -> str:
    """A folder of this application in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Scratch tables that released() will remove, the innermost call last.
_HELD: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again. It survives lost executors, and is
    removed by released() or at the end of the application."""
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if _HELD:
        _HELD[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """written(make(), name); then the scratch tables that make() wrote on its way are removed."""
    held: list[str] = []
    _HELD.append(held)
    try:
        out = written(make(), name)
    finally:
        _HELD.pop()
    spark = out.sparkSession
    for path in held[:-1]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if _HELD:
        _HELD[-1].append(held[-1])
    return out


def raw(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def row_id(id_col: str, text_col: str) -> Column:
    """128 bits that name an id and a text; rows that repeat both share it."""
    return F.unhex(F.md5(F.concat_ws("\u0000", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\u0001")), F.when(F.col(f"`{text_col}`").isNull(), "0").otherwise("1"), F.col(f"`{text_col}`"))))


_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed by XXH3: a polynomial modulo a power of two fails on some words of 512 letters or more.
_LONG_WORD = 64
#: Bytes hashed in one go; longer texts are cut at white space.
_PIECE = 1 << 21


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of words and of windows of words, by whole arrays.

    The hash of a run is a difference of prefix sums times a power of the inverse of the base, so that every word and
    every window costs the same few array operations however long it is.
    """

    def __init__(self, seed: int):
        self.seed = seed
        rng = np.random.Generator(np.random.PCG64(seed))
        self.of_byte = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(rng.integers(1, 2**62)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            one = np.full(n, self.base, np.uint64)
            one[0] = 1
            self.up = np.cumprod(one, dtype=np.uint64)
            one[1:] = self.inverse
            self.down = np.cumprod(one, dtype=np.uint64)

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.frombuffer(data, np.uint8)
        ws = _WS[a]
        edge = np.diff(np.concatenate(([True], ws, [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self._powers(len(a) + 1)
        sums = np.empty(len(a) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.of_byte[a] * self.up[: len(a)], out=sums[1:])
        h = mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _GOLD)
        for k in np.flatnonzero(end - start > _LONG_WORD):
            h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]], self.seed)
        return h, start, end

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end (bytes) of each word of data."""
        if len(data) <= _PIECE:
            return self._words(data)
        out, at = [], 0
        while at < len(data):
            to = min(len(data), at + _PIECE)
            while to < len(data) and not _WS[data[to]]:
                to += 1
            h, s, e = self._words(data[at:to])
            out.append((h, s + at, e + at))
            at = to
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """Hash of each run of so many words, by its first word; empty if there are fewer."""
        n = len(words) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        self._powers(len(words) + 1)
        sums = np.empty(len(words) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(words * self.up[: len(words)], out=sums[1:])
        return mixed((sums[size:] - sums[:n]) * self.down[:n])
