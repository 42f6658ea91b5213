"""Offsets, instants in zones, labels of times, lifetimes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offsets may reach so far.
MAX_DAYS = 366
UNITS = {"m": 60, "h": 3_600, "d": 86_400}


def offset_seconds(offset: Column) -> Column:
    """Seconds of an offset such as 5m, 2h or 1d; null if it is none or longer than MAX_DAYS."""
    pattern = r"^([1-9]\d{0,8})([mhd])$"
    unit = F.regexp_extract(offset, pattern, 2)
    size = F.try_element_at(F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair]), unit)
    seconds = F.nullif(F.regexp_extract(offset, pattern, 1), F.lit("")).cast("long") * size
    return F.when(offset.rlike(pattern) & (seconds <= MAX_DAYS * 86_400), seconds)


def before(start: Column, seconds: Column) -> Column:
    """The instant so many seconds earlier, also across changes of the clock."""
    return F.timestamp_micros(F.unix_micros(start) - seconds * 1_000_000)


def wall_before(local: Column, seconds: Column, zone: str) -> Column:
    """For times without an offset of their own: wall-clock arithmetic in the zone, then the instant in UTC."""
    wall = F.timestamp_add("SECOND", -seconds, local.cast("timestamp_ntz"))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def parsed_instant(text: Column, zone: str) -> Column:
    """An RFC 3339 instant, or a date or time without offset in the zone."""
    own = F.try_to_timestamp(text)
    local = F.to_utc_timestamp(own, zone)
    return F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$") & F.contains(text, F.lit("T")), own).otherwise(local)


def day_overlaps(start: Column, end: Column, day_start: Column, day_end: Column) -> Column:
    """Half-open overlap of an event with a day."""
    return (end > day_start) & (start < day_end)


def agenda_when(day: Column, start: Column, end: Column, all_day: Column) -> Column:
    """How an agenda of one day names an event's time."""
    first, last = F.to_date(start), F.to_date(end)
    clock = lambda t: F.date_format(t, "HH:mm")
    begin = F.when(first < F.date_sub(day, 1), first.cast("string")).when(first == F.date_sub(day, 1), "Yesterday").otherwise(clock(start))
    finish = F.when(last > F.date_add(day, 1), last.cast("string")).when((last == F.date_add(day, 1)) & (clock(end) != "00:00"), "Tomorrow").otherwise(clock(end))
    return F.when(all_day, "All day").otherwise(F.concat(begin, F.lit("-"), finish))


def digest_key(day: Column, zone: Column, source: Column) -> Column:
    return F.concat_ws(":", F.lit("daily"), F.date_format(day, "yyyy-MM-dd"), zone, F.coalesce(source, F.lit("all")))


def lifetime_seconds(status: Column) -> Column:
    """How long a resolution is kept: 30 days if it is settled, else an hour."""
    return F.when(status.isin("resolved", "blocked"), 30 * 86_400).otherwise(3_600).cast("long")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
