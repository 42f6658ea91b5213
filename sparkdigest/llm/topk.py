"""Exact inner-product search by sorted lists without random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdigest.llm.common import partitions, pick, written

#: Candidates of a block and queries of a block: what a task holds at once.
CANDIDATES, QUERIES = 4096, 256
#: Blocks of which a task keeps the sorted lists.
LISTS = 8
#: Shares of the lists that have been read when the bounds are compared; the last one reads them to their ends.
DEPTHS = (0.25, 0.5, 0.7, 0.8, 0.88, 0.94, 1.0)


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v) with v = floor(scale * x) of each component; vectors null or with null or non-finite components are left out."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    d = pick(vectors, id_col, vec_col).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
    return d.where("id is not null and v is not null").where(fine).select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))


def blocks(vectors: DataFrame, size: int, parts: int) -> DataFrame:
    """(width, share, ids, data): up to `size` vectors of one width, ids and components as little-endian longs."""
    # dealt in turn, so that shares are even whatever ids and values repeat
    dealt = vectors.select("id", "v", F.size("v").alias("width")).repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(width: int) -> pa.RecordBatch:
            rows = held.pop(width)
            ids = np.array([r[0] for r in rows], "<i8")
            data = np.array([r[1] for r in rows], "<i8").reshape(len(rows), width)
            return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], ["width", "ids", "data"])

        for b in batches:
            for i, v, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(w, []).append((i, v))
                if len(held[w]) == size:
                    yield flush(w)
        for w in list(held):
            yield flush(w)

    return dealt.mapInArrow(run, "width int, ids binary, data binary").withColumn("share", F.spark_partition_id())


class Lists:
    """A block of candidates as sorted lists: for each component the candidates by its value."""

    def __init__(self, ids: np.ndarray, c: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.c = ids[order], c[order].astype(np.float64)
        by = np.argsort(self.c, axis=0, kind="stable")
        self.rank = np.empty_like(by)
        np.put_along_axis(self.rank, by, np.arange(len(by))[:, None], axis=0)
        self.values = np.take_along_axis(self.c, by, axis=0)


def block_topk(q_ids: np.ndarray, q: np.ndarray, lists: Lists, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(query, candidate, score) of the candidates that may be among a query's k best, and the share of entries read.

    For a query, a component's list is read from the top if the query's component is positive and from the bottom if it is
    negative, so that what a list adds falls as it is read; no score is looked up out of turn. After each of DEPTHS, a
    candidate's lower bound is what was read of it, and the worst of every list where it wasn't met; its upper bound has
    the list's last value there. Outsiders, met or not, whose upper bound is under the k-th lower bound or under
    floor (what k candidates of blocks read before have reached) are dropped. A query stops reading when at most k are
    left or the lists have ended; the entries of those left are then read to the end, which resolves their scores. The
    query itself is no candidate. Bounds of a block are products of exact whole numbers.
    """
    c, values, rank = lists.c, lists.values, lists.rank
    n, width = c.shape
    q = q.astype(np.float64)
    alive = np.ones((len(q), n), bool)
    for row, (lo, hi) in enumerate(zip(np.searchsorted(lists.ids, q_ids, "left"), np.searchsorted(lists.ids, q_ids, "right"), strict=True)):
        alive[row, lo:hi] = False
    read = np.ones(len(q))
    open_ = np.arange(len(q)) if n > k and width else np.empty(0, np.int64)
    for share in DEPTHS[:-1]:
        depth = int(share * n)
        if not len(open_) or not depth:
            continue
        up, down = np.maximum(q[open_], 0), np.minimum(q[open_], 0)
        top, bottom = rank >= n - depth, rank < depth
        seen = up @ np.where(top, c, 0).T + down @ np.where(bottom, c, 0).T
        upper = seen + up @ np.where(top, 0, values[n - depth]).T + down @ np.where(bottom, 0, values[depth - 1]).T
        lower = seen + up @ np.where(top, 0, values[0]).T + down @ np.where(bottom, 0, values[-1]).T
        live = alive[open_]
        lower[~live] = -np.inf
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        live &= upper >= np.maximum(kth, floor[open_])[:, None]
        alive[open_] = live
        left = live.sum(axis=1)
        stop = left <= 2 * k
        read[open_[stop]] = share + (1 - share) * left[stop] / n
        open_ = open_[~stop]
    # the rest of the lists, for those that may still qualify
    rows: list[np.ndarray] = []
    cols: list[np.ndarray] = []
    score: list[np.ndarray] = []
    for row in range(len(q)):
        some = np.flatnonzero(alive[row])
        s = c[some] @ q[row]
        best = np.lexsort((some, -s))[:k]
        rows.append(np.full(len(best), row)), cols.append(some[best]), score.append(s[best])
    for row in open_:
        read[row] = DEPTHS[-2] + (1 - DEPTHS[-2]) * alive[row].mean()
    r, x = np.concatenate(rows), np.concatenate(cols)
    return r, lists.ids[x], np.concatenate(score).astype(np.int64), float(read.mean())


def merged(best: list[tuple[np.ndarray, np.ndarray, np.ndarray]], queries: int, k: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The k best of each query among the finds of several blocks, and the k-th score (minus infinity if there are fewer)."""
    r, ids, s = (np.concatenate(x) for x in zip(*best, strict=True))
    order = np.lexsort((ids, -s, r))
    r, ids, s = r[order], ids[order], s[order]
    place = np.arange(len(r)) - np.searchsorted(r, r, "left")
    floor = np.full(queries, -np.inf)
    floor[r[place == k - 1]] = s[place == k - 1]
    keep = place < k
    return (r[keep], ids[keep], s[keep]), floor


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k highest inner products, ties to the smaller id.

    is_query is a condition on the column id. Candidates are all rows but those of the query's own id; queries and candidates
    of different widths don't meet. Blocks of queries meet the blocks of each share of the candidates by width; what a
    share's blocks have reached bounds its next ones, and of its at most k rows a query the best are ranked. Vectors
    null or with null or non-finite components, and null ids, take no part. Repeated rows count once. Fewer than k candidates are all returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col, scale).distinct()
    rows = written(rows, "vectors")
    counts = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_query).alias("asked")).first()
    most = max(64, partitions(spark))
    shares = min(most, -(-counts["all"] // CANDIDATES) or 1)
    left = written(blocks(rows.where(is_query), QUERIES, min(most, -(-counts["asked"] // QUERIES) or 1)), "queries")
    right = written(blocks(rows, CANDIDATES, shares), "candidates")
    # each block of queries is sent to every share of the candidates, which reads its blocks one after the other
    left = left.select("width", F.col("ids").alias("q_ids"), F.col("data").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    right = right.select("width", "share", F.col("ids").alias("c_ids"), F.col("data").alias("c"))
    # no broadcast: files of queries are small next to what their copies for all shares take, and a sort keeps a block's pairs together
    pairs = left.join(right.hint("merge"), ["width", "share"]).select("width", "q_ids", "q", "c_ids", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Lists] = {}
        of, q_ids, best, floor = b"", np.empty(0, np.int64), None, np.empty(0)

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q_ids[best[0]], best[1], best[2])], ["query_id", "vec_id", "score"])

        for b in batches:
            for row in range(b.num_rows):
                w, qi, qv, ci, cv = (x[row].as_py() for x in b.columns)
                if qi != of:  # the join gives a block of queries with all blocks of the share
                    if best is not None:
                        yield found()
                    of, q_ids = qi, np.frombuffer(qi, "<i8")
                    best, floor = (np.empty(0, np.int64),) * 3, np.full(len(q_ids), -np.inf)
                if ci not in held:
                    if len(held) == LISTS:
                        held.pop(next(iter(held)))
                    ids = np.frombuffer(ci, "<i8")
                    held[ci] = Lists(ids, np.frombuffer(cv, "<i8").reshape(len(ids), w))
                got = block_topk(q_ids, np.frombuffer(qv, "<i8").reshape(len(q_ids), w), held[ci], k, floor)
                best, floor = merged([best, got[:3]], len(q_ids), k)
        if best is not None:
            yield found()

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
