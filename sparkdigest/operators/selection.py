"""Choosing ranked rows: quotas, token budgets, running budgets, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quota_top_k(rows: DataFrame, reserved: Column, limit: int, slots: int, keys: list[str], rank: str = "rank") -> DataFrame:
    """The first `limit` rows of each key by rank, `slots` of them kept for reserved rows; unused slots pass to the others.

    Closed form over windows: with n rows of each kind, the reserved ones first get min(slots, limit, n), the others what
    is left of the limit, and the reserved ones then what the others leave.
    """
    marked = rows.withColumn("_reserved", F.coalesce(reserved, F.lit(False)))
    mine = Window.partitionBy(*keys, "_reserved")
    every = Window.partitionBy(*keys)
    counted = marked.withColumn("_place", F.row_number().over(mine.orderBy(rank))).withColumn("_n1", F.count_if("_reserved").over(every)).withColumn("_n0", F.count_if(~F.col("_reserved")).over(every))
    first = F.least(F.lit(slots), F.lit(limit), F.col("_n1"))
    others = F.least(F.lit(limit) - first, F.col("_n0"))
    kept = F.when(F.col("_reserved"), F.least(F.col("_n1"), F.lit(limit) - others)).otherwise(others)
    return counted.where(F.col("_place") <= kept).select(rows.columns)


def budget_fit(rows: DataFrame, cost: Column, budget: Column, keys: list[str], rank: str = "rank", reserved: Column | None = None, protect: int = 0) -> DataFrame:
    """Rows that fit a budget after the last ones by rank are dropped; the first `protect` reserved rows go last of all.

    A row goes if, with all rows dropped before it gone, the total is still above the budget: a running sum over the order
    of dropping.
    """
    kind = F.coalesce(reserved, F.lit(False)) if reserved is not None else F.lit(False)
    marked = rows.withColumn("_cost", cost).withColumn("_budget", budget).withColumn("_kind", kind)
    place = F.row_number().over(Window.partitionBy(*keys, "_kind").orderBy(rank))
    marked = marked.withColumn("_safe", F.col("_kind") & (place <= protect))
    every = Window.partitionBy(*keys)
    dropped = every.orderBy("_safe", F.desc(rank)).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_cost").over(every) - F.coalesce(F.sum("_cost").over(dropped), F.lit(0))
    return marked.withColumn("_total", total).where(F.col("_total") <= F.col("_budget")).select(rows.columns)


def running_budget(rows: DataFrame, amount: str, budget: int, keys: list[str], *order: Column) -> DataFrame:
    """taken: what each row gets of a budget that rows use up in order."""
    so_far = F.coalesce(F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("taken", F.greatest(F.lit(0), F.least(F.col(amount), F.lit(budget) - so_far)).cast("long"))


def sections(rows: DataFrame, top: int, keys: list[str], *order: Column) -> DataFrame:
    """section: the first `top` reviewed rows are headlines, the rest mentions; where nothing is reviewed, the first of all."""
    every = Window.partitionBy(*keys)
    some = F.max(F.col("review_score").isNotNull()).over(every)
    place = F.row_number().over(every.orderBy(F.col("review_score").isNull() & some, *order))
    return rows.withColumn("section", F.when((place <= top) & (~some | F.col("review_score").isNotNull()), "headline").otherwise("mention"))


def mention_limit(rows: DataFrame, limit: int, keys: list[str], *order: Column) -> DataFrame:
    """Headlines and the first `limit` mentions: applied after merging, so that an absorbed mention frees its place."""
    place = F.row_number().over(Window.partitionBy(*keys, "section").orderBy(*order))
    return rows.withColumn("_place", place).where((F.col("section") == "headline") | (F.col("_place") <= limit)).drop("_place")


def spread_budget(pairs: DataFrame, calls: int, keys: list[str], *order: Column) -> DataFrame:
    """The first `calls` pairs of each key: what a judge may be asked."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return pairs.withColumn("_place", place).where(F.col("_place") <= calls).drop("_place")
