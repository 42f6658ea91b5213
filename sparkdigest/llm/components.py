"""Connected components of a links table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdigest.llm.common import released, written

#: Links of a task in a round, and the tasks that even few links are dealt to.
TASK_ROWS, LEAST_TASKS = 50_000, 8


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, which has at most so many rows, in tasks of TASK_ROWS each, LEAST_TASKS at least, and never more than it has."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """contracted(), of whose rounds nothing is left behind."""
    return released(lambda: contracted(links, most), "components")


def contracted(links: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) of each node in links(a, b); root is the smallest node that it can reach.

    Each round first hangs every larger neighbour of a node on the node's smallest neighbour, then every smaller one
    (large star, small star). Rounds grow with the logarithm of the longest chain, links never multiply, and nothing
    is gathered on the driver but a count and a checksum; the count says how many tasks a round is worth. Self links and
    repeated links do no harm; no links give no rows. After `most` rounds, if given, root is a node of the same
    component, but nodes of one component may still have different ones.
    """
    links = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    now, rounds = _state(links), 0
    while True:
        n = 2 * now[0]
        both = links.union(links.select("b", "a")).toDF("u", "v")
        least = _tasks(both.groupBy("u").agg(F.min("v").alias("m")), n).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        hung = both.join(least, F.col("u") == F.col("w")).where("v > u and v <> m").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"))
        least = _tasks(hung.groupBy("a").agg(F.min("b").alias("m")), n).select(F.col("a").alias("w"), "m")
        small = _tasks(hung.join(least, F.col("a") == F.col("w")), n)
        links = small.select("a", "m").union(small.where("b <> m").select("b", "m")).toDF("a", "b").distinct()
        links = written(_tasks(links, n), "links")
        before, now, rounds = now, _state(links), rounds + 1
        if now == before or rounds == most:
            named = links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b"))
            return _tasks(named.groupBy("node").agg(F.min("root").alias("root")), n)
