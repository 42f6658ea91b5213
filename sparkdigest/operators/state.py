"""State tables as change logs: insert if absent, latest wins, reconcile, roll up, expire."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdigest.functions.time import lifetime_seconds

TERMINAL = ("delivered", "expired", "cancelled")


def current(log: DataFrame, keys: list[str], seq: str = "op_seq") -> DataFrame:
    """The latest row of each key of a change log. Partial aggregation leaves one row for each key and task to shuffle."""
    others = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_row")).select(*keys, "_row.*")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def insert_if_absent(stored: DataFrame, new: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Rows of new to append: keys not stored, or, stored as discovered, or, forced, all; repeated keys once."""
    fresh = new.dropDuplicates(keys)
    if force:
        return fresh
    return fresh.join(stored.where("state <> 'discovered'").select(*keys), keys, "left_anti")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], seq: str = "op_seq") -> DataFrame:
    """Stored rows with those of new in place of the same keys."""
    return current(stored.unionByName(new), keys, seq)


def replace_children(stored: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All rows of the parents in new replaced by new's."""
    return stored.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def append_scores(scores: DataFrame, live: DataFrame, key: str = "item_id", value: str = "score") -> DataFrame:
    """Finite scores of items that still exist."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != F.lit(float("inf")))
    return scores.where(ok).join(live.select(key).distinct(), key, "left_semi")


def reset_on_change(stored: DataFrame, new: DataFrame, key: str, watched: str, resets: dict[str, Column]) -> DataFrame:
    """Stored and new rows by key, the new ones' columns taken; where `watched` changes (null-safe), resets hold instead."""
    old = stored.select(F.col(key).alias("_k"), F.col(watched).alias("_w"), *[F.col(c).alias(f"_{c}") for c in resets], F.lit(True).alias("_old"))
    both = new.join(old, new[key] == F.col("_k"), "left")
    kept = F.col("_old") & F.col("_w").eqNullSafe(F.col(watched))
    cols = [F.when(F.coalesce(kept, F.lit(False)), F.col(f"_{c}")).otherwise(resets[c]).alias(c) for c in resets]
    changed = both.select(*[c for c in new.columns if c not in resets], *cols)
    return stored.join(new.select(key), key, "left_anti").unionByName(changed)


def reconcile_attempts(stored: DataFrame, wanted: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """Attempts after a sync: new ones pending; pending or failed ones whose content differs pending anew; others as stored.

    Terminal states are never revived.
    """
    new = wanted.select(*keys, *[F.col(c).alias(f"_{c}") for c in content], F.lit(True).alias("_new"))
    both = stored.withColumn("_old", F.lit(True)).join(new, keys, "full_outer")
    differs = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in content])
    fresh = F.col("_old").isNull()
    again = F.coalesce(F.col("_new"), F.lit(False)) & ~fresh & differs & F.col("state").isin("pending", "failed")
    take = fresh | again
    cols = [F.when(take, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in content]
    return both.select(*keys, *cols, F.when(take, "pending").otherwise(F.col("state")).alias("state"), F.when(fresh, "created").when(again, "reset").otherwise("kept").alias("change"))


def cancelled(stored: DataFrame, wanted: DataFrame, keys: list[str], event_keys: list[str], window: Column, synced: DataFrame) -> DataFrame:
    """Open attempts to cancel: not wanted any more, and within the window or of an event that was synced."""
    open_ = stored.where(F.col("state").isin("pending", "failed")).join(wanted.select(*keys), keys, "left_anti")
    inside = open_.where(window)
    outside = open_.where(~window).join(synced.select(*event_keys).distinct(), event_keys, "left_semi")
    return inside.unionByName(outside).withColumn("state", F.lit("cancelled")).withColumn("code", F.lit("CALENDAR_EVENT_CHANGED"))


def reconcile_destinations(deliveries: DataFrame, destinations: DataFrame, now: Column, key: str = "destination_key") -> DataFrame:
    """Open deliveries of destinations that are no longer configured retire; those of configured ones come back."""
    known = destinations.select(key).distinct().withColumn("_known", F.lit(True))
    found = deliveries.join(known, key, "left")
    open_ = F.col("state").isin("pending", "failed")
    retired = F.when(open_ & F.col("_known").isNull(), F.coalesce("retired_at", now)).when(F.col("_known"), F.lit(None)).otherwise(F.col("retired_at"))
    return found.withColumn("retired_at", retired).drop("_known")


def roll_up(parents: DataFrame, deliveries: DataFrame, key: str) -> DataFrame:
    """Parents' states from their live deliveries: all delivered, any failed, else pending; none live leaves the state."""
    live = deliveries.where("retired_at is null").groupBy(key).agg(F.bool_and(F.col("state") == "delivered").alias("_all"), F.bool_or(F.col("state") == "failed").alias("_any"))
    state = F.when(F.col("_all"), "delivered").when(F.col("_any"), "failed").when(F.col("_all").isNotNull(), "pending").otherwise(F.col("state"))
    return parents.join(live, key, "left").withColumn("state", state).drop("_all", "_any")


def mark(rows: DataFrame, ids: DataFrame, key: str, **new: Column) -> DataFrame:
    """Rows whose key is in ids with new values."""
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    found = rows.join(hit, key, "left")
    for name, value in new.items():
        found = found.withColumn(name, F.when(F.col("_hit"), value).otherwise(F.col(name)))
    return found.drop("_hit")


def live_cache(cache: DataFrame, now: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > now)


def cache_entry(status: Column, checked_at: Column) -> Column:
    """When an entry of the resolution cache runs out."""
    return F.timestamp_micros(F.unix_micros(checked_at) + lifetime_seconds(status) * 1_000_000)


def to_resolve(urls: DataFrame, cache: DataFrame, now: Column, key: str = "url_hash") -> DataFrame:
    """Links that no live cache entry covers."""
    return urls.dropDuplicates([key]).join(live_cache(cache, now).select(key), key, "left_anti")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) of each table."""
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def run_summary(rows: DataFrame, key: str) -> DataFrame:
    """Counters and status of each run from rows with a state."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("discovered"), F.count_if(F.col("state") == "processed").alias("processed"), F.count_if(F.col("state") == "failed").alias("failed"))
    return n.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("processed") > 0, "partial").otherwise("failed"))


def error_counts(rows: DataFrame, code: Column, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys, code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def desired_diff(desired: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """What to add to or remove from a service so that it has what is desired: full outer join of the two."""
    a, b = desired.select(*keys).distinct().withColumn("_d", F.lit(True)), actual.select(*keys).distinct().withColumn("_a", F.lit(True))
    change = F.when(F.col("_a").isNull(), "add").when(F.col("_d").isNull(), "remove").otherwise("keep")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))
