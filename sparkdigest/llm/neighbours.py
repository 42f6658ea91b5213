"""Near copies among embeddings: a pivot-permutation index.

Every vector is described by the PREFIX reference points nearest to it, in order. Two vectors are compared if they share SHARED
of those at least. They are found in inverted lists (label, reference point -> vectors): in the common order of reference
points, rarest first, two sets of PREFIX that share SHARED have their first common point among the first PREFIX - SHARED + 1
of either, so only those are listed, and the list of that first common point alone answers for the pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdigest.llm.common import partitions, pick, released, tidy, written
from sparkdigest.llm.components import components

#: Links are cosines of so much at least.
COSINE = 0.93
#: Vectors from which the reference points are chosen, by the smallest hashes; the only bounded sample here.
SAMPLE = 4096
#: Reference points at most; how many of them describe a vector; how many two vectors must share.
POINTS, PREFIX, SHARED = 256, 12, 5
#: Vectors of a block: lists that are longer are compared block by block, each two blocks in a group of their own.
BLOCK = 1024


def usable(vector: str | Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of one width, in double precision; scaled first, so that squares neither overflow nor vanish."""
    x = np.asarray(vectors.flatten(), np.float64).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _fitted(x: np.ndarray, width: int) -> np.ndarray:
    """Cut or filled up with zeros to a width: the reference points have one width, the vectors may have several."""
    return np.pad(x[:, :width], ((0, 0), (0, max(0, width - x.shape[1]))))


def reference_points(vectors: DataFrame, seed: int = 42) -> np.ndarray:
    """Unit vectors that lie far from each other, each the farthest of the sample from those before it; none is within COSINE
    of another, so that a crowd of near copies has one. vectors(vector); no rows give none."""
    rows = vectors.orderBy(F.xxhash64("vector", F.lit(seed)), "vector").limit(SAMPLE).collect()
    width = max((len(r["vector"]) for r in rows), default=1)
    if not rows:
        return np.empty((0, width))
    x = np.concatenate([_fitted(_matrix(pa.array([r["vector"]]), len(r["vector"])), width) for r in rows])
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < POINTS and nearest.min() < COSINE:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def _described(points: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (node, label, copies, vector): adds near, the nearest reference points in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = np.asarray(b["vector"].value_lengths())
            for width in np.unique(widths):
                part = b.filter(pa.array(widths == width))
                near = -(_fitted(_matrix(part["vector"], int(width)), points.shape[1]) @ points.T)
                near = near.argsort(axis=1, kind="stable")[:, :PREFIX].astype(np.int32)
                flat = pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1], near.ravel())
                yield pa.RecordBatch.from_arrays([*part.columns, flat], [*part.schema.names, "near"])

    return tidy(run)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of n can reach by the links a-b, which are listed both ways and sorted by a."""
    root, starts = np.arange(n), np.flatnonzero(np.diff(a, prepend=-1))
    while len(a):
        least = root.copy()
        least[a[starts]] = np.minimum(root[a[starts]], np.minimum.reduceat(root[b], starts))
        least = least[least]
        if (least == root).all():
            break
        root = least
    return root


#: What names a group: two blocks of one list, or a block with itself.
_GROUP = ["label", "width", "point", "first", "second"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for name in _GROUP:
            new[1:] |= pc.not_equal(b[name].slice(1), b[name].slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        new[0] = bool(held) and any(held[-1][name][0] != b[name][0] for name in _GROUP)
        starts = np.union1d(np.flatnonzero(new), [0])
        for at, to in zip(starts, [*starts[1:], b.num_rows], strict=True):
            if held and new[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held)


def _all_compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        yield from _compared(group).to_batches()


def _compared(table: pa.Table) -> pa.Table:
    """What a group says of each vector: how many others it links to, copies counted, and the smallest node of its group that
    it is linked to by a path. Pairs stay inside."""
    width, point, first, second = (table[name][0].as_py() for name in _GROUP[1:])
    table = table.sort_by("node")
    node, copies = np.asarray(table["node"]), np.asarray(table["copies"])
    x = _matrix(table["vector"].combine_chunks(), width)
    ranks = np.asarray(table["ranks"].combine_chunks().flatten()).reshape(len(node), -1)
    has = np.zeros((len(node), int(ranks.max()) + 1), np.float32)
    np.put_along_axis(has, ranks, 1, 1)
    earlier = has[:, :point]
    block = np.asarray(table["block"])
    found_a, found_b = [], []
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    for at in range(0, len(left), BLOCK):
        rows = left[at : at + BLOCK]
        hit = (x[rows] @ x[right].T >= COSINE) & (has[rows] @ has[right].T >= min(SHARED, ranks.shape[1])) & (earlier[rows] @ earlier[right].T == 0)
        i, j = np.nonzero(hit)
        found_a.append(rows[i])
        found_b.append(right[j])
    a, b = np.concatenate([*found_a, np.empty(0, np.int64)]), np.concatenate([*found_b, np.empty(0, np.int64)])
    if first == second:
        a, b = a[a != b], b[a != b]
    else:
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        order = a.argsort(kind="stable")
        a, b = a[order], b[order]
    links = np.bincount(a, copies[b], len(node)).astype(np.int64)
    own = np.flatnonzero(links)
    return pa.table({"node": node[own], "links": links[own], "towards": node[_roots(len(node), a, b)[own]]})


def _classes(rows: DataFrame) -> DataFrame:
    """One row for each distinct vector of a label: node (a number), id (the smallest), copies, vector."""
    own = rows.where("usable and label is not null").groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    return written(own.withColumn("node", F.monotonically_increasing_id()), "vectors")


def _listed(index: DataFrame) -> DataFrame:
    """Postings (label, width, point, node, copies, vector, ranks): ranks are the places of near in the common order of
    reference points, rarest first; point is one of the first of them."""
    often = index.select(F.explode("near").alias("p")).groupBy("p").count().orderBy("count", "p").collect()
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(often) for x in (r["p"], k)]) if often else F.create_map(F.lit(0), F.lit(0))
    ranked = index.withColumn("ranks", F.array_sort(F.transform("near", lambda p: rank[p]))).withColumn("width", F.size("vector"))
    first = F.greatest(F.lit(1), F.size("ranks") - SHARED + 1)
    return ranked.withColumn("point", F.explode(F.slice("ranks", F.lit(1), first))).drop("near", "id")


def _in_blocks(listed: DataFrame) -> DataFrame:
    """Each posting with its block, once for each pair of blocks that it takes part in."""
    key = ["label", "width", "point"]
    sizes = listed.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = listed.join(sizes.where("blocks > 1"), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return dealt.withColumn("other", other).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})


def linked(classes: DataFrame) -> DataFrame:
    """(node, links, towards) of the vectors in classes that have links in the index, once for each place where they were found."""
    spark = classes.sparkSession
    points = reference_points(classes.select("vector"))
    schema = T.StructType([*classes.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))])
    if not len(points):
        return spark.createDataFrame([], "node long, links long, towards long")
    index = written(classes.mapInArrow(_described(points), schema), "described")
    blocks = _in_blocks(_listed(index)).select(*_GROUP, "block", "node", "copies", "vector", "ranks")
    dealt = blocks.repartition(partitions(spark), *_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(tidy(_all_compared), "node long, links long, towards long")


def _told(rows: DataFrame) -> DataFrame:
    """What the rows of each class get: its_label, its_vector, n, component."""
    classes = _classes(rows)
    links = written(linked(classes), "links")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("a"), F.col("towards").alias("b")))
    named = classes.join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    n = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    return named.join(least, "root").select(F.col("label").alias("its_label"), F.col("vector").alias("its_vector"), n.alias("n"), "component")


def near_copies(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id_col, n_links long, component_id, kept) of every row.

    Rows with equal, non-null labels and a cosine of COSINE or more are linked if the index finds them. Equal vectors of a label
    are one class and always linked; classes are compared with each other, and their links counted with all copies. n_links is
    the number of other rows linked directly, component_id the smallest id reachable, kept whether it is the row's own.
    A vector that is null, empty or zero, or holds a null or a non-finite component, and a row without a label link with nothing.
    Vectors of different width don't link. Repeated rows are copies of each other. A null id stays null and counts as no id: its
    component is named by the others, or null, and it isn't kept. An empty table gives no rows; further columns are left out.
    """
    rows = pick(df, id_col, vector_col, label_col).toDF("id", "vector", "label").withColumn("usable", usable("vector"))
    rows = rows.withColumn("vector", F.when(F.col("usable"), F.col("vector")))
    told = released(lambda: _told(rows), "told")
    out = rows.join(told, (F.col("label") == F.col("its_label")) & (F.col("vector") == F.col("its_vector")), "left")
    component = F.when(F.col("its_label").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
