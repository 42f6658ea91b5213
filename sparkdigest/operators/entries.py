"""Duplicates of items and entries: keep the best, keep the last, fold with absorption."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdigest.functions.url import canonical_url, entry_key

#: The seven parts of an entry's rank, with what a missing one counts as; published is microseconds.
RANK = {"review_score": -1.0, "reranker_score": -1.0, "importance": -1.0, "confidence": -1.0, "hn_score": -1.0, "hn_comments": -1.0, "published": float("-inf")}


def rank_of(row: Column) -> Column:
    """A struct that compares as the entry's rank; row is a struct or a way to name columns."""
    return F.struct(*[F.coalesce(row(k).cast("double"), F.lit(v)).alias(k) for k, v in RANK.items()])


def best_per_key(rows: DataFrame, key: Column, *best: Column, seq: str = "seq") -> DataFrame:
    """The row of each key with the greatest `best`; the first by seq of equals.

    One pass of partial aggregation: what is shuffled is one row for each key and task, however many rows share a key.
    """
    cols = [c for c in rows.columns]
    order = F.struct(*best, (-F.col(seq)).alias("_seq"))
    return rows.groupBy(key.alias("_key")).agg(F.max_by(F.struct(*cols), order).alias("_row")).select("_row.*")


def last_per_key(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last row of each key by seq."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_row")).select(*keys, "_row.*")


def first_per_key(rows: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The first row of each key by seq."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(seq)).alias("_row")).select(*keys, "_row.*")


#: What a winner borrows with a discussion, and takes with an article link.
_TALK, _LINK = ("discussion_url", "hn_score", "hn_comments", "hn_item_id", "_talk"), ("article_url", "_link")
#: Winners that a fold lists before it puts the list away, as adding to a list copies it.
_RUN = 256


def _met(winner: Column, other: Column, parts: list[str]) -> list[Column]:
    """Parts of the winner's state once it has met the other: its discussion or the other's, its article link or the other's."""
    borrow = (F.coalesce(winner["discussion_url"], F.lit("")) == "") & (F.coalesce(other["discussion_url"], F.lit("")) != "")
    own = lambda row: F.coalesce((row["article_url"] != "") & ~row["_link"].eqNullSafe(row["_talk"]), F.lit(False))
    taken = dict.fromkeys(_TALK, borrow) | dict.fromkeys(_LINK, ~own(winner) & own(other))
    return [(F.when(taken[n], other[n]).otherwise(winner[n]) if n in taken else winner[n]).alias(n) for n in parts]


def _folded(rows: Column, parts: list[str], rank: Callable[[Column], Column]) -> Column:
    """The last winner's state, its place `at` in rows, and the places of all winners in order, in `runs` and `run`.

    Nothing that grows is carried but places, so a step costs the same however many rows have been met.
    """
    state = lambda of, at, n, run, runs: F.struct(*of, at.alias("at"), n.alias("n"), run.alias("run"), runs.alias("runs"))
    first, zero = F.get(rows, F.lit(0)), F.lit(0)
    start = state([first[n].alias(n) for n in parts], zero, zero, F.array(zero), F.array().cast("array<array<int>>"))

    def step(a: Column, row: Column) -> Column:
        n, full = a["n"] + 1, F.size(a["run"]) >= _RUN
        run = F.when(full, F.array(n)).otherwise(F.concat(a["run"], F.array(n)))
        runs = F.when(full, F.concat(a["runs"], F.array(a["run"]))).otherwise(a["runs"])
        return F.when(rank(row) > rank(a), state(_met(row, a, parts), n, n, run, runs)).otherwise(state(_met(a, row, parts), a["at"], n, a["run"], a["runs"]))

    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, zero)), start, step)


def fold_entries(entries: DataFrame, within: list[str] | None = None, lent_counts: bool = True) -> DataFrame:
    """One entry for each key (link, feed id or title), the strongest, having absorbed the others in their order.

    entries has seq, title, summary, source_name, article_url, discussion_url, hn_item_id, the parts of RANK, and
    also_from and merged_summaries (arrays). The fold is replayed as it arrives: a newcomer of higher rank takes over and
    absorbs the winner so far, any other is absorbed by it; equal ranks leave the earlier one. The result has pos, the
    seq at which the key appeared first. An entry's key group is folded in one task: the entries of one story. `within`
    names columns (a digest) that entries must share to meet. A winner that borrows a discussion has its score in its rank from
    then on; with lent_counts False entries keep the rank that they arrived with.
    """
    within = within or []
    names = [*dict.fromkeys(["seq", *entries.columns])]
    key = entry_key(F.col("article_url"), F.col("hn_item_id"), F.col("title"))
    keyed = entries.withColumns({"_key": key, "_link": canonical_url(F.col("article_url")), "_talk": canonical_url(F.col("discussion_url"))})
    if not lent_counts:
        keyed = keyed.withColumn("_rank", rank_of(F.col))
    parts = [*dict.fromkeys([*_TALK, *_LINK, *(RANK if lent_counts else ["_rank"])])]
    # seq comes first in the struct, so that sorting is in order of arrival
    listed = F.struct(*dict.fromkeys([*names, *parts]))
    grouped = keyed.groupBy(*within, "_key").agg(F.array_sort(F.collect_list(listed)).alias("rows"))
    rank = lambda row: rank_of(lambda k: row[k]) if lent_counts else row["_rank"]
    found = grouped.select("rows", _folded(F.col("rows"), parts, rank).alias("end"))
    winners = F.concat(F.flatten("end.runs"), "end.run")
    earlier = F.reverse(F.slice(winners, 1, F.size(winners) - 1))
    places = F.concat(earlier, F.array_except(F.sequence(F.lit(0), F.size("rows") - 1), winners))
    found = found.select("rows", "end", F.get("rows", F.col("end.at")).alias("top"), places.alias("places"))
    # each winner put its own before what it took over, so the last winner's come first, then those of the winners before it
    added = lambda one, more: F.flatten(F.transform("places", lambda k: F.concat(F.array(F.get("rows", k)[one]), F.get("rows", k)[more])))
    own, alone = F.col("top"), F.size("rows") == 1
    fresh = F.filter(added("source_name", "also_from"), lambda n: n.isNotNull() & (n != "") & ~n.eqNullSafe(own["source_name"]))
    told = F.when(F.size(own["merged_summaries"]) > 0, own["merged_summaries"]).otherwise(F.array(own["summary"]))
    new = {n: F.col(f"end.{n}") for n in parts if n in names}
    new["also_from"] = F.when(alone, own["also_from"]).otherwise(F.array_distinct(F.concat(own["also_from"], fresh)))
    new["merged_summaries"] = F.when(alone, own["merged_summaries"]).otherwise(F.array_distinct(F.concat(told, added("summary", "merged_summaries"))))
    return found.select(F.get("rows", F.lit(0))["seq"].alias("pos"), *[(new[n] if n in new else own[n]).alias(n) for n in names])


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, seq: str = "seq", name: str = "values") -> DataFrame:
    """Distinct values of each key in order of first appearance."""
    first = rows.groupBy(*keys, value).agg(F.min(seq).alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct("_first", value)))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x[value]).alias(name))


def in_rank_order(entries: DataFrame) -> DataFrame:
    """Entries by rank, the strongest first, ties by seq."""
    rank = rank_of(F.col)
    return entries.orderBy(rank.desc(), "seq")


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def numbered(rows: DataFrame, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 within each key."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
