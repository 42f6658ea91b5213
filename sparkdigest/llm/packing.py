"""Best-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkdigest.llm.common import partitions, pick, small, tidy, written
from sparkdigest.llm.tokens import encoding, ids_of


def pieces(docs: DataFrame, path: str, size: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids and then end_id.

    Only longer documents are cut, into pieces of `size` ids of which the first takes the remainder.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in small(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.append(ids_of(text, enc), np.array([end_id], "<u4"))
                data, n = memoryview(ids.tobytes()), len(ids)
                at = k = 0
                while at < n:
                    to = at + (((n - at - 1) % size) + 1)
                    row.append(i), piece.append(k), start.append(at), length.append(to - at), crc.append(zlib.crc32(data[4 * at : 4 * to]))
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def match_runs(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, from_rank, to_rank, sequence, offset) that place counts[length] pieces of each length.

    Pieces of one length are interchangeable and so are gaps of one size, so both are held as runs of equal members:
    what is held depends on `size` alone, not on the corpus. Supersteps go down the lengths. In each, the run of
    pieces sweeps the gaps upwards from its length: the successor is the smallest gap that fits; pieces that meet the
    same gaps are settled by rank, the k-th piece of the run taking the k-th gap; used gaps shrink and are met again
    by the next sweep; what finds no gap opens sequences. A piece of rank r in the run lies in sequence
    `sequence + r - from_rank` at `offset`.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    some = np.zeros(size + 1, bool)
    out, fresh = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fit = int(np.argmax(some[length:])) + length
            if not some[fit]:
                fit = size
                opened = -(-left // (size // length))
                gaps[size].append((fresh, opened))
                fresh += opened
            sequence, n = gaps[fit].pop()
            take = min(n, left)
            if take < n:
                gaps[fit].append((sequence + take, n - take))
            out.append((length, rank, rank + take, sequence, size - fit))
            if fit > length:
                gaps[fit - length].append((sequence, take))
                some[fit - length] = True
            some[fit] = bool(gaps[fit])
            rank, left = rank + take, left - take
    return out


def pack(parts: DataFrame, size: int) -> DataFrame:
    """The rows of pieces() with sequence_id and offset: as few sequences of at most `size` ids as best fit finds.

    Bulk-synchronous best fit (see match_runs). Ranks within a length are made without gathering a length in one
    task: rows are counted by length and salt, the counts give each salt its first rank, and a window numbers the rows
    of one salt. Gathered on the driver are the counts of the at most `size` lengths; broadcast are the runs, whose
    number depends on `size` and not on the rows.
    """
    spark = parts.sparkSession
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * partitions(spark))))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # as an Arrow table: a list would go through Python workers on the executors
    columns = np.array(match_runs(totals, size), np.int64).reshape(-1, 5).T
    runs = spark.createDataFrame(pa.table(list(map(pa.array, columns)), ["run_length", "from_rank", "to_rank", "sequence", "offset"]))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("k", F.row_number().over(order) - 1).join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("k"))
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("from_rank")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pack(pieces()) of all rows, with the pieces written once to the shared folder.

    Null text counts as empty and has the one id end_id. Null or repeated ids and repeated rows are packed as rows of
    their own; an empty table gives no rows; further columns are ignored.
    """
    return pack(written(pieces(docs, path, size, end_id, id_col, text_col), "pieces"), size)
