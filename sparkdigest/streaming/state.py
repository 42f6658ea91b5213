"""State that lives in the stream: attempts with event-time timers, and a cache of resolved links whose entries run out.

Both have a batch twin that gives the same rows for a table. They need Spark's RocksDB state store:
spark.sql.streaming.stateStore.providerClass = ROCKS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Events of an attempt: planned (with its reminder and its event's start), sent, failed, cancelled.
EVENT = "attempt string, at timestamp, seq long, kind string, reminder_at timestamp, start timestamp"
TRANSITION = "attempt string, at timestamp, seq long, state string, tries int"
# What an event makes of an open attempt.
BECOMES = {"sent": "delivered", "failed": "failed", "cancelled": "cancelled"}
OPEN = ("pending", "failed")


def _us(x: object) -> int | None:
    return None if x is None or pd.isna(x) else pd.Timestamp(x).value // 1000


class Attempts(StatefulProcessor):
    """One attempt: open (pending or failed) until it is delivered, cancelled, or its event begins, when it expires. What has
    come to an end is never revived; a new plan with another time starts an open one anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("attempt", "state string, tries int, reminder long, start long")

    def _step(self, now: tuple | None, at: int, seq: int, kind: str, reminder: int | None, start: int | None) -> Iterator[tuple]:
        """Transitions (at, seq, state, tries, reminder, start) that an event brings about."""
        if now and now[0] in OPEN and at >= now[3]:
            now = ("expired", *now[1:])
            yield (now[3], -1, *now)
        if kind == "planned":
            if reminder is not None and start is not None and (now is None or now[0] in OPEN and now[2:] != (reminder, start)):
                yield (at, seq, "pending", 0, reminder, start)
        elif now and now[0] in OPEN and kind in BECOMES:
            yield (at, seq, BECOMES[kind], now[1] + (kind == "failed"), *now[2:])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "seq"])
        now = tuple(self.now.get()) if self.now.exists() else None
        out, before = [], now
        for r in events.itertuples(index=False):
            for t in self._step(now, _us(r.at), int(r.seq), r.kind, _us(r.reminder_at), _us(r.start)):
                now = t[2:]
                out.append((key[0], pd.Timestamp(t[0], unit="us"), *t[1:4]))
        if now and now != before:
            self.now.update(now)
            if now[0] in OPEN:
                # a timer fires once the watermark is beyond it: one earlier, so that the start itself counts
                self.handle.registerTimer(now[3] // 1000 - 1)
        if out:
            yield pd.DataFrame(out, columns=["attempt", "at", "seq", "state", "tries"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = tuple(self.now.get()) if self.now.exists() else None
        # a timer of an older plan says nothing
        if now and now[0] in OPEN and now[3] // 1000 - 1 <= expiredTimerInfo.getExpiryTimeInMs():
            self.now.update(("expired", *now[1:]))
            yield pd.DataFrame({"attempt": [key[0]], "at": [pd.Timestamp(now[3], unit="us")], "seq": [-1], "state": ["expired"], "tries": [now[1]]})

    def close(self) -> None:
        """Nothing is open."""


def attempt_stream(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """TRANSITION of a stream of EVENT, whose events of an attempt come in order of (at, seq). Events without an attempt or a time
    are left out. The watermark on `at` stands for the clock."""
    known = events.where("attempt is not null and at is not null").withWatermark("at", delay)
    return known.groupBy("attempt").transformWithStateInPandas(Attempts(), TRANSITION, "append", "eventTime")


def attempt_transitions(events: DataFrame, now: Column) -> DataFrame:
    """The same for a table as of an instant, as one fold over each attempt's events in order."""
    known = events.where(F.col("attempt").isNotNull() & (F.col("at") <= now))
    ordered = F.sort_array(F.collect_list(F.struct("at", "seq", "kind", "reminder_at", "start")))
    kind = "struct<at:timestamp,seq:bigint,state:string,tries:int,reminder:timestamp,start:timestamp>"
    expired = lambda s: F.struct(s["start"].alias("at"), F.lit(-1).cast("long").alias("seq"), F.lit("expired").alias("state"), s["tries"].alias("tries"), s["reminder"].alias("reminder"), s["start"].alias("start"))
    is_open = lambda s: F.coalesce(s["state"].isin(*OPEN), F.lit(False))

    def added(told: Column, new: Column, when: Column) -> Column:
        return F.when(when, F.concat(told, F.array(new))).otherwise(told)

    def ended(told: Column, at: Column) -> Column:
        last = F.try_element_at(told, F.lit(-1))
        return added(told, expired(last), is_open(last) & (at >= last["start"]))

    def step(told: Column, e: Column) -> Column:
        told = ended(told, e["at"])
        last = F.try_element_at(told, F.lit(-1))
        whole = (e["kind"] == "planned") & e["reminder_at"].isNotNull() & e["start"].isNotNull()
        other = ~(last["reminder"].eqNullSafe(e["reminder_at"]) & last["start"].eqNullSafe(e["start"]))
        plan = F.struct(e["at"].alias("at"), e["seq"].alias("seq"), F.lit("pending").alias("state"), F.lit(0).alias("tries"), e["reminder_at"].alias("reminder"), e["start"].alias("start"))
        became = F.try_element_at(F.create_map(*[F.lit(x) for pair in BECOMES.items() for x in pair]), e["kind"])
        after = F.struct(e["at"].alias("at"), e["seq"].alias("seq"), became.alias("state"), (last["tries"] + (e["kind"] == "failed").cast("int")).alias("tries"), last["reminder"].alias("reminder"), last["start"].alias("start"))
        planned = whole & (last.isNull() | (is_open(last) & other))
        return F.when(planned, F.concat(told, F.array(plan))).otherwise(added(told, after, is_open(last) & became.isNotNull()))

    told = F.aggregate("events", F.array().cast(f"array<{kind}>"), step, lambda t: ended(t, now))
    found = known.groupBy("attempt").agg(ordered.alias("events")).select("attempt", F.explode(told).alias("t"))
    return found.select("attempt", "t.at", "t.seq", "t.state", "t.tries")


#: Links to resolve, and what is known of them: outcome, and whether it was served from the cache.
LINK = "url_hash string, url string, at timestamp"
ANSWER = "url_hash string, at timestamp, final_url string, status string, served boolean"


class Resolved(StatefulProcessor):
    """What became of a link, as long as it is good for: two values, for links that were resolved and for those that were not, each
    with a time to live after which Spark forgets it. The entry's own end, by the clock of the rows, decides what is served."""

    def __init__(self, resolve: Callable[[str], tuple[str | None, str]], good_seconds: int, bad_seconds: int):
        self.resolve, self.lives = resolve, {"good": good_seconds, "bad": bad_seconds}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = {k: handle.getValueState(k, "final_url string, status string, ends long", ttlDurationMs=1000 * s) for k, s in self.lives.items()}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        entry = next((tuple(s.get()) for s in self.kept.values() if s.exists()), None)
        out = []
        for r in pd.concat(list(rows)).sort_values("at").itertuples(index=False):
            at = _us(r.at)
            served = entry is not None and entry[2] > at
            if not served:
                final, status = self.resolve(r.url)
                kind = "good" if status == "resolved" else "bad"
                entry = (final, status, at + self.lives[kind] * 1_000_000)
                for k, s in self.kept.items():
                    s.update(entry) if k == kind else s.clear()
            out.append((key[0], r.at, entry[0], entry[1], served))
        yield pd.DataFrame(out, columns=["url_hash", "at", "final_url", "status", "served"])

    def close(self) -> None:
        """Nothing is open."""


def resolved_stream(links: DataFrame, resolve: Callable[[str], tuple[str | None, str]], good_seconds: int, bad_seconds: int) -> DataFrame:
    """ANSWER for a stream of LINK: resolve(url) gives (final_url, status) and is called only for links without a live entry."""
    known = links.where("url_hash is not null and at is not null")
    return known.groupBy("url_hash").transformWithStateInPandas(Resolved(resolve, good_seconds, bad_seconds), ANSWER, "append", "processingTime")


def served_from_cache(links: DataFrame, good: Column, good_seconds: int, bad_seconds: int) -> DataFrame:
    """(url_hash, at, served) of a table of LINK: the batch twin of what the cache serves, where `good` says of a row whether its
    link can be resolved at all. An ordered fold over the times of a link: the entry's end moves on when it has run out."""
    times = F.sort_array(F.collect_list(F.struct("at", good.alias("good"))))
    kind = "struct<ends:timestamp,told:array<struct<at:timestamp,served:boolean>>>"
    zero = F.struct(F.lit(None).cast("timestamp").alias("ends"), F.array().cast("array<struct<at:timestamp,served:boolean>>").alias("told")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        served = F.coalesce(s["ends"] > x["at"], F.lit(False))
        life = F.when(x["good"], good_seconds).otherwise(bad_seconds).cast("long")
        ends = F.when(served, s["ends"]).otherwise(F.timestamp_micros(F.unix_micros(x["at"]) + life * 1_000_000))
        return F.struct(ends.alias("ends"), F.concat(s["told"], F.array(F.struct(x["at"].alias("at"), served.alias("served")))).alias("told"))

    known = links.where("url_hash is not null and at is not null")
    told = known.groupBy("url_hash").agg(times.alias("t")).select("url_hash", F.explode(F.aggregate("t", zero, step, lambda s: s["told"])).alias("x"))
    return told.select("url_hash", "x.at", "x.served")
