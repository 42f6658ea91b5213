"""The reminder pipelines: sync a calendar, show an agenda, dispatch what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdigest.functions.text import agenda_cell
from sparkdigest.functions.time import agenda_when, day_overlaps
from sparkdigest.operators import schedule as s
from sparkdigest.operators import state
from sparkdigest.operators.entries import last_per_key

KEYS = ["calendar_id", "event_id", "instance_id", "rule_id", "reminder_at"]


def sync(stored: DataFrame, events: DataFrame, rules: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Stored attempts after reading the events of [now, now + seconds): created, reset, kept or cancelled."""
    if "seq" not in events.columns:  # without an order of arrival any of equal events will do
        events = events.withColumn("seq", F.lit(0))
    wanted = s.schedule(last_per_key(events, ["calendar_id", "instance_id"]), rules).withColumn("content", F.concat_ws("|", "start", "before"))
    kept = state.reconcile_attempts(stored.select(*KEYS, "content", "state"), wanted.select(*KEYS, "content"), KEYS, ["content"])
    until = F.timestamp_micros(F.unix_micros(now) + seconds * 1_000_000)
    window = (F.col("reminder_at") >= now) & (F.col("reminder_at") < until)
    gone = state.cancelled(stored, wanted, KEYS, ["calendar_id", "event_id", "instance_id"], window, events)
    gone = gone.select(*KEYS, F.lit(True).alias("_gone"))
    out = kept.join(gone, KEYS, "left")
    return out.withColumn("state", F.when(F.col("_gone"), "cancelled").otherwise(F.col("state"))).withColumn("change", F.when(F.col("_gone"), "cancelled").otherwise(F.col("change"))).drop("_gone")


def dispatch(attempts: DataFrame, deliveries: DataFrame, now: Column, outcome: DataFrame) -> DataFrame:
    """Attempts after one run: events that have begun expire, the others take the outcome of their deliveries.

    outcome(attempt_id, destination_key, state) is what a sender reports for deliveries(attempt_id, destination_key, state,
    retired_at).
    """
    due = s.due(attempts, now).select("attempt_id", "action")
    told = deliveries.drop("state").join(outcome, ["attempt_id", "destination_key"])
    rolled = state.roll_up(attempts, told.unionByName(deliveries.join(outcome.select("attempt_id", "destination_key"), ["attempt_id", "destination_key"], "left_anti")), "attempt_id")
    found = attempts.select("attempt_id", F.col("state").alias("_was")).join(rolled, "attempt_id").join(due, "attempt_id", "left")
    new = F.when(F.col("action") == "expire", "expired").when(F.col("action") == "send", F.col("state")).otherwise(F.col("_was"))
    return found.withColumn("state", new).withColumn("code", F.when(F.col("action") == "expire", "REMINDER_EVENT_STARTED")).drop("_was", "action")


def agenda(events: DataFrame, day: str) -> DataFrame:
    """(row_no, line) of a day's events in order, with their times, names and places."""
    begin = F.lit(day).cast("timestamp")
    held = events.where(day_overlaps(F.col("start"), F.col("end"), begin, begin + F.expr("INTERVAL 1 DAY")))
    label = agenda_when(F.lit(day).cast("date"), F.col("start"), F.col("end"), F.col("all_day"))
    when = F.when(F.length(label) < 11, F.rpad(label, 11, " ")).otherwise(label)
    name = F.concat(agenda_cell(F.col("title")), F.when(F.coalesce("calendar_name", F.lit("")) != "", F.concat(F.lit(" ("), agenda_cell(F.col("calendar_name")), F.lit(")"))).otherwise(""))
    place = agenda_cell(F.col("location"))
    lines = F.array(F.concat(when, F.lit(" | "), name), F.when(place != "", F.concat(F.lit(" " * 11 + " | "), place)))
    ordered = held.select("start", "calendar_id", "instance_id", F.posexplode(F.filter(lines, lambda x: x.isNotNull())).alias("k", "line"))
    return ordered.orderBy("start", "calendar_id", "instance_id", "k").select("start", "calendar_id", "instance_id", "k", "line")


def gate(scheduled: bool, now: Column, agenda_time: str) -> Column:
    """False for a scheduled run before the day's agenda time."""
    return F.lit(not scheduled) | (F.date_format(now, "HH:mm") >= agenda_time)
