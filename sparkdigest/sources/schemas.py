"""Schemas of what the services give, and readers that turn it into the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdigest.functions.text import links_of
from sparkdigest.functions.time import parsed_instant
from sparkdigest.operators.subscriptions import header_map

HEADERS = "array<struct<name:string,value:string>>"
MAIL = f"id string, threadId string, internalDate string, labelIds array<string>, headers {HEADERS}, payload string"
STORY = "id long, type string, time long, title string, by string, url string, text string, score int, descendants int, dead boolean, deleted boolean"
POINT = "struct<dateTime:string,date:string>"
EVENT = f"calendar_id string, calendar_name string, id string, recurringEventId string, summary string, location string, start {POINT}, end {POINT}, htmlLink string, hangoutLink string, description string, entryPoints array<string>"


#: Labels that a mail gets when its run has ended.
ENDED = ("Processed", "Failed")


def mail_search(query: str, days: int, force: bool = False, labels: tuple[str, ...] = ENDED) -> str:
    """The search that a service is asked: mails of the last days, unless forced without those that a run has ended."""
    return " ".join([f"({query}) newer_than:{int(days)}d", *([] if force else [f'-label:"{x}"' for x in labels])])


def mails(raw: DataFrame, newer_than_days: int | None = None, now: str | None = None, done: DataFrame | None = None, force: bool = False, labels: tuple[str, ...] = ENDED) -> DataFrame:
    """Mails of MAIL with their instant and header map: those of the last days, and unless forced only those that neither bear
    one of the labels nor are in done(id). Null labels are none; a null or malformed instant is too old for any number of days."""
    found = raw
    if newer_than_days is not None:
        since = F.unix_millis(F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(newer_than_days)} DAY"))
        found = found.where(F.expr("try_cast(internalDate AS bigint)") >= since)
    if not force:
        found = found.where(~F.coalesce(F.arrays_overlap("labelIds", F.array(*map(F.lit, labels))), F.lit(False)))
        found = found.join(done.select("id"), "id", "left_anti") if done is not None else found
    return found.withColumn("published_at", F.timestamp_millis(F.expr("try_cast(internalDate AS bigint)"))).withColumn("headers", header_map(F.col("headers")))


def in_window(rows: DataFrame, time_min: str, time_max: str, start: str = "start", end: str = "end") -> DataFrame:
    """Rows that lie in [time_min, time_max) in part at least, as plain comparisons, which go to a paged source."""
    return rows.where((F.col(end) > F.lit(time_min).cast("timestamp")) & (F.col(start) < F.lit(time_max).cast("timestamp")))


def events(raw: DataFrame, zone: str) -> DataFrame:
    """Events of EVENT: rows without start or end left out, names filled in, links gathered once each in order.

    An instance is named by its own id, its series by event_id; all-day events span days of the zone.
    """
    at = lambda c: parsed_instant(F.coalesce(F.col(f"{c}.dateTime"), F.col(f"{c}.date")), zone)
    linked = F.array_distinct(F.filter(F.concat(F.array("htmlLink", "hangoutLink"), F.coalesce("entryPoints", F.array().cast("array<string>")), links_of(F.coalesce("description", F.lit("")))), lambda x: F.coalesce(x, F.lit("")) != ""))
    found = raw.select(
        "calendar_id",
        "calendar_name",
        F.coalesce("recurringEventId", "id").alias("event_id"),
        F.col("id").alias("instance_id"),
        F.coalesce(F.nullif("summary", F.lit("")), F.lit("(untitled)")).alias("title"),
        F.coalesce("location", F.lit("")).alias("location"),
        at("start").alias("start"),
        at("end").alias("end"),
        F.col("start.dateTime").isNull().alias("all_day"),
        linked.alias("links"),
    )
    return found.where("start is not null and end is not null")
