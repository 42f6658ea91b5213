"""Events, rules and reminders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdigest.functions.text import fold
from sparkdigest.functions.time import before, offset_seconds
from sparkdigest.session import bounded

#: Rules at most.
RULES_MOST = 10_000
#: Columns of a rule: a clause that is null holds, an empty list of words holds.
RULES = "rule_seq int, rule_id string, calendar_id string, has_location boolean, all_day boolean, title_contains array<string>, location_contains array<string>, reminders array<struct<id:string,before:string>>"


def _contains_any(text: Column, words: Column) -> Column:
    return words.isNull() | (F.size(words) == 0) | F.exists(words, lambda w: F.contains(fold(text), fold(w)))


def rule_holds(event: DataFrame, rule: DataFrame) -> Column:
    """Whether every clause of a rule that is given holds for an event."""
    same = lambda have, want: want.isNull() | have.eqNullSafe(want)
    return (
        same(event["calendar_id"], rule["calendar_id"])
        & same(F.trim(event["location"]) != "", rule["has_location"])
        & same(event["all_day"], rule["all_day"])
        & _contains_any(event["title"], rule["title_contains"])
        & _contains_any(event["location"], rule["location_contains"])
    )


def schedule(events: DataFrame, rules: DataFrame) -> DataFrame:
    """(calendar_id, event_id, instance_id, start, rule_id, before, reminder_at): each event's reminders.

    rules has RULES; the row with rule_id 'default' holds for all events and comes first. An unnamed reminder is named
    rule:before. Of reminders of an event at the same instant the last by rule and place stays. Rules are configuration, rows
    that a person has written, so they are broadcast and tested against every event; more than RULES_MOST are refused.
    """
    found = events.join(bounded(rules, RULES_MOST, "rules"), rule_holds(events, rules)).select(
        events["calendar_id"], "event_id", "instance_id", "start", "rule_seq", "rule_id", F.posexplode("reminders").alias("place", "r")
    )
    named = found.withColumn("rule_id", F.coalesce("r.id", F.concat_ws(":", "rule_id", "r.before"))).withColumn("reminder_at", before(F.col("start"), offset_seconds(F.col("r.before"))))
    named = named.where("reminder_at is not null")
    last = named.groupBy("calendar_id", "instance_id", "reminder_at").agg(F.max_by(F.struct("event_id", "start", "rule_id", F.col("r.before").alias("before")), F.struct("rule_seq", "place")).alias("x"))
    return last.select("calendar_id", "x.event_id", "instance_id", "x.start", "x.rule_id", "x.before", "reminder_at")


def in_time_order(reminders: DataFrame) -> DataFrame:
    return reminders.orderBy("reminder_at", "start", "rule_id")


def horizon_seconds(rules: DataFrame, lookahead: int) -> DataFrame:
    """One row: how far ahead events are read, the lookahead or the longest offset."""
    offsets = rules.select(F.explode("reminders").alias("r")).select(offset_seconds(F.col("r.before")).alias("s"))
    return offsets.agg(F.greatest(F.lit(lookahead).cast("long"), F.max("s")).alias("seconds"))


def due(attempts: DataFrame, now: Column) -> DataFrame:
    """Pending or failed attempts whose instant has come, with what becomes of them: an event that has begun expires."""
    found = attempts.where(F.col("state").isin("pending", "failed") & (F.col("reminder_at") <= now))
    return found.withColumn("action", F.when(F.col("start") <= now, "expire").otherwise("send"))


def agenda_links(events: DataFrame, links: Column, key: str = "day", per_event: int = 3, per_message: int = 20) -> DataFrame:
    """Distinct links of each day in event order: so many of an event and of a message at most."""
    own = events.withColumn("_l", F.slice(F.array_distinct(links), 1, per_event)).select(key, "start", "calendar_id", "instance_id", F.posexplode("_l").alias("place", "link"))
    first = own.groupBy(key, "link").agg(F.min(F.struct("start", "calendar_id", "instance_id", "place")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("rank") <= per_message).select(key, "rank", "link")
