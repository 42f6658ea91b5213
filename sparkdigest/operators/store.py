"""Reads and writes over the stored tables: joins with state, failures, resolutions, forced resets, retries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdigest.operators.state import roll_up
from sparkdigest.sources.chunk_sink import FAILED, LIMITED, LONGEST_WAIT, REFUSED, TRIES

#: Ids that a message about an unknown one names.
SHOWN = 20
# States.
RETRIED, ENDED, OPEN = ("pending", "failed"), ("processed", "failed"), ("pending", "failed")


# ---- joins with state -------------------------------------------------------------------------------------------


def _beside(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Both joined on key; of a column that both have, the left one's."""
    return left.join(right.select(key, *[c for c in right.columns if c not in left.columns]), key, how)


def with_document(items: DataFrame, documents: DataFrame, feed_state: DataFrame, wanted: DataFrame, limit: int) -> DataFrame:
    """Items of the wanted documents (document_id) with their document and, where there is one, its feed state; newest document
    first. Of a column that several have, the item's holds, then the document's.

    The set of ids is a semi join, so it may be of any size; the limit is a top-k, which leaves `limit` rows a task.
    """
    chosen = items.join(wanted.select("document_id"), "document_id", "left_semi")
    both = _beside(_beside(chosen, documents.withColumn("published_at__", F.col("published_at")), "document_id"), feed_state, "document_id", "left")
    return both.orderBy(F.desc("published_at__"), "document_id", "item_id").limit(limit).drop("published_at__")


def by_external(documents: DataFrame, state: DataFrame, external: DataFrame, key: str) -> DataFrame:
    """Documents with their state, of the messages or stories named in external(key)."""
    return documents.join(state, "document_id").join(external.select(key).distinct(), key, "left_semi")


def failed_first(documents: DataFrame, state: DataFrame, limit: int, source: Column) -> DataFrame:
    """Failed documents of a source with their state, the documents that were longest untouched first; of a column that both
    have, the document's."""
    failed = documents.where(source & (F.col("state") == "failed"))
    return _beside(failed, state, "document_id").orderBy("updated_at", "document_id").limit(limit)


def to_label(documents: DataFrame, mail_state: DataFrame) -> DataFrame:
    """Mails whose documents have come to an end, for their labels to follow."""
    return documents.where(F.col("state").isin(*ENDED)).select("document_id", "state").join(mail_state, "document_id")


def open_deliveries(deliveries: DataFrame, digests: DataFrame, destinations: DataFrame) -> DataFrame:
    """Deliveries to the given destinations that wait or have failed and aren't retired, with the digest's text."""
    live = deliveries.where(F.col("state").isin(*OPEN) & F.col("retired_at").isNull())
    return live.join(destinations.select("destination_key"), "destination_key", "left_semi").join(digests, "digest_id")


# ---- writes -----------------------------------------------------------------------------------------------------


def fail(documents: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Documents with those in failures(document_id, error) failed: one more attempt, the error and the time."""
    bad = failures.groupBy("document_id").agg(F.max("error").alias("error_"))
    hit = F.col("error_").isNotNull()
    both = documents.join(bad, "document_id", "left")
    new = {"state": F.lit("failed"), "attempt_count": F.col("attempt_count") + 1, "last_error_code": F.col("error_"), "updated_at": now}
    return both.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in documents.columns])


def _last(rows: DataFrame, keys: list[str], values: list[str], order: str | None, name: str) -> DataFrame:
    """(keys, name): the values of each key as a struct, those of the row that comes last by order; of several last ones, or
    without an order, the greatest, so that every run chooses the same."""
    chosen = F.struct(*values)
    return rows.groupBy(*keys).agg(F.max_by(chosen, F.struct(*([order] if order else []), chosen)).alias(name))


def _with(rows: DataFrame, hit: Column, new: dict[str, Column]) -> list[Column]:
    """The columns of rows, where hit holds with new's values, in the types that they have."""
    return [F.when(hit, new[c].cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns]


def resolve(documents: DataFrame, state: DataFrame, outcomes: DataFrame, now: Column, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both tables after outcomes(document_id, text, basis, final_url, error), to be committed together.

    A text resets its document to discovered with the text's hash and length; an error fails it. The state gets the link,
    what became of the fetch, and the time. Of several outcomes of a document the last by `order` (a column of outcomes)
    counts, without one a text before an error; neither table ever gets more rows. An outcome without text or error has an empty text.
    """
    told = outcomes.withColumn("good", F.col("error").isNull()).withColumn("text", F.coalesce("text", F.lit("")))
    last = _last(told, ["document_id"], ["good", "text", "basis", "final_url", "error"], order, "new__")
    good, new_ = F.col("new__.good"), F.col("new__")
    found = {"content_basis": new_["basis"], "content_sha256": F.sha2(new_["text"], 256), "content_characters": F.length(new_["text"]), "state": F.lit("discovered"), "last_error_code": F.lit(None), "updated_at": now}
    reset = documents.join(last, "document_id", "left").select(*_with(documents, good, found))
    status = {"final_url": F.when(good, new_["final_url"]).otherwise(F.col("final_url")), "fetch_status": F.coalesce(new_["error"], F.lit("fetched")), "fetched_at": now, "updated_at": now}
    fetched = state.join(last, "document_id", "left").select(*_with(state, new_.isNotNull(), status))
    return fail(reset, last.where(~good).select("document_id", new_["error"].alias("error")), now), fetched


def agenda_after(stored: DataFrame, new: DataFrame, keys: list[str], now: Column, force: bool = False, order: str | None = None) -> DataFrame:
    """Agenda deliveries after new(keys, content, ...): what is not there is added as pending.

    What is there stays as it is, or, forced, starts anew with the new content: pending, no messages sent, no error. Of
    several new rows of a key the last by `order` counts.
    """
    start = {"state": F.lit("pending"), "message_ids": F.lit(None), "delivered_at": F.lit(None), "last_error_code": F.lit(None), "created_at": now, "updated_at": now}
    wish = _last(new, keys, [c for c in new.columns if c not in keys], order, "new__")
    given = [c for c in stored.columns if c in new.columns and c not in keys]
    row = [start[c].cast(stored.schema[c].dataType).alias(c) if c in start else F.col(f"new__.{c}").alias(c) if c in given else F.col(c) for c in stored.columns]
    added = wish.join(stored.select(*keys), keys, "left_anti").select(*row)
    if not force:
        return stored.unionByName(added)
    again = {**start, "content": F.col("new__.content"), "created_at": F.col("created_at")}
    return stored.join(wish, keys, "left").select(*_with(stored, F.col("new__").isNotNull(), again)).unionByName(added)


class Synced(NamedTuple):
    """Tables after a sync; attempts also tell whether each was reset or created."""

    attempts: DataFrame
    deliveries: DataFrame
    n_created: Column


def attempts_after(
    stored: DataFrame, wanted: DataFrame, deliveries: DataFrame, keys: list[str], content: list[str], destinations: list[str] | None = None, order: str | None = None, flags: tuple[str, str] = ("reset", "created")
) -> Synced:
    """Attempts after a sync, the deliveries that stay or are new, and an aggregate that counts the attempts that are new.

    An attempt that waits or has failed and whose content differs starts anew: pending, no progress, no error, its deliveries
    gone. Those that have come to an end are never revived, and an equal one stays as it is. Of several wishes for a key the
    last by `order` counts. Every wanted attempt gets a pending delivery to each destination that it has none to yet.
    `flags` names the two columns that attempts gets; stored mustn't have them.
    """
    reset, created = flags
    if {reset, created} & set(stored.columns):
        raise ValueError(f"stored attempts have a column {reset} or {created}; name other flags")
    wish = _last(wanted, keys, content, order, "new__")
    differs = F.lit(False)
    for c in content:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"new__.{c}"))
    again = F.col("new__").isNotNull() & F.col("state").isin(*RETRIED) & differs
    start = {"state": F.lit("pending"), "progress": F.lit(0), "last_error_code": F.lit(None)}
    fresh = {**{c: F.col(f"new__.{c}") for c in content}, **start}
    kept = stored.join(wish, keys, "left").select(*_with(stored, again, fresh), again.alias(reset), F.lit(False).alias(created))
    row = [F.col(c) if c in keys else fresh.get(c, F.lit(None)).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]
    added = wish.join(stored.select(*keys), keys, "left_anti").select(*row, F.lit(False).alias(reset), F.lit(True).alias(created))
    left = deliveries.join(kept.where(reset).select(*keys), keys, "left_anti")
    if destinations:
        each = wish.select(*keys, F.explode(F.array(*map(F.lit, dict.fromkeys(destinations)))).alias("destination"), F.lit("pending").alias("state"))
        new = each.join(left.select(*keys, "destination"), [*keys, "destination"], "left_anti")
        left = left.unionByName(new.select(*[c for c in each.columns if c in left.columns]), allowMissingColumns=True)
    return Synced(kept.unionByName(added), left, F.count_if(F.col(created)))


def adopted(parents: DataFrame, deliveries: DataFrame, destinations: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(parents, deliveries) after parents of an older schema, which hold their own checkpoint, have got deliveries.

    parents(key, state, message_ids, destination_key, last_error_code) without any row in deliveries(key, destination_key, state,
    message_ids, last_error_code, retired_at) get one to each destination: to just the one that their checkpoint names with its state,
    messages and error, to the others a pending one. A checkpoint of a destination that isn't there any more is not
    taken over. Then parents' states roll up from their deliveries; those that have none keep theirs."""
    old = parents.join(deliveries.select(key).distinct(), key, "left_anti")
    each = old.withColumn("to__", F.explode(F.array(*map(F.lit, dict.fromkeys(destinations)))) if destinations else F.lit(None).cast("string")).where("to__ is not null")
    own = F.coalesce(F.col("to__") == F.col("destination_key"), F.lit(False))
    told = {"destination_key": F.col("to__"), "state": F.when(own, F.col("state")).otherwise("pending"), **{c: F.when(own, F.col(c)) for c in ("message_ids", "last_error_code")}}
    new = each.select(*[told.get(c, F.col(c) if c == key else F.lit(None)).cast(deliveries.schema[c].dataType).alias(c) for c in deliveries.columns])
    both = deliveries.unionByName(new)
    return roll_up(parents, both, key), both


# ---- sending ----------------------------------------------------------------------------------------------------


def next_try(status: Column, attempt: Column, retry_after: Column, transport: Column | None = None) -> Column:
    """What follows a try (0, 1, ...) with an HTTP status: struct(action, wait in seconds, error).

    A busy service names the wait, which is kept within LONGEST_WAIT, one second if it names none; a broken one is waited for
    twice as long each time; other errors and a last try end it. A bot's errors tell what is wrong with its configuration.
    """
    last = attempt >= TRIES - 1
    busy, broken = status == 429, status >= 500
    action = F.when(status < 400, "done").when((busy | broken) & ~last, "retry").otherwise("fail")
    asked = F.greatest(F.lit(0.0), F.least(F.lit(LONGEST_WAIT), F.coalesce(retry_after, F.lit(1.0))))
    wait = F.when(action != "retry", 0.0).when(busy, asked).otherwise(F.pow(F.lit(2.0), attempt))
    refused = F.lit(None).cast("string")
    if transport is not None:
        codes = F.create_map(*[F.lit(x) for pair in REFUSED.items() for x in pair])
        refused = F.when(transport == "bot", F.try_element_at(codes, status.cast("int")))
    error = F.when(action == "fail", F.when(busy, LIMITED).otherwise(F.coalesce(refused, F.lit(FAILED))))
    return F.struct(action.alias("action"), wait.alias("wait"), error.alias("error"))


def sent_progress(tries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_sent, error) of each delivery, from its tries(keys, chunk_no, attempt, status): chunks 1, 2, ... count up to the
    first that wasn't taken or wasn't tried; the last try of a chunk that wasn't taken gives the error."""
    last = tries.groupBy(*keys, "chunk_no").agg(F.max_by(F.struct("status", "attempt"), F.struct("attempt", "status")).alias("t"))
    ended = next_try(F.col("t.status"), F.lit(TRIES - 1), F.lit(None).cast("double"))
    done = last.select(*keys, "chunk_no", (F.col("t.status") < 400).alias("ok"), ended["error"].alias("error"))
    taken = F.count_if("ok").over(Window.partitionBy(*keys).orderBy("chunk_no"))
    counted = done.withColumn("in_line", F.col("ok") & (F.col("chunk_no") == taken))
    stop = F.min(F.when(~F.col("ok"), F.struct("chunk_no", "error")))
    found = counted.groupBy(*keys).agg(F.count_if("in_line").alias("n_sent"), stop.alias("stop"))
    return found.select(*keys, "n_sent", F.when(F.col("stop.chunk_no") == F.col("n_sent") + 1, F.col("stop.error")).alias("error"))


# ---- choices and small things -----------------------------------------------------------------------------------


def mail_query(sources: DataFrame, subscriptions: DataFrame, query: str | None = None, source: str | None = None, subscription: str | None = None) -> str:
    """The mail search that one selector stands for: a search itself, or the id of a row of sources or of subscriptions
    (id, type, gmail_query), which Spark looks up; no selector stands for all mail. Of rows that repeat an id, the least search."""
    selected = {k: v for k, v in {"query": query, "source": source, "subscription": subscription}.items() if v is not None}
    if len(selected) > 1:
        raise ValueError(f"give one of {', '.join(selected)}, not several")
    kind, value = next(iter(selected.items()), ("query", ""))
    if kind == "query":
        return value
    table = {"source": sources, "subscription": subscriptions}[kind]
    hit = table.where(F.col("id") == value).orderBy("type", "gmail_query").first()
    if hit is None:
        some = [r["id"] for r in table.select("id").distinct().orderBy("id").limit(SHOWN + 1).collect()]
        raise ValueError(f"no {kind} {value!r}; there are: {', '.join(some[:SHOWN]) or 'none'}{' ...' if len(some) > SHOWN else ''}")
    if hit["type"] != "gmail":
        raise ValueError(f"{kind} {value!r} doesn't read mail")
    return hit["gmail_query"]


def one_day_before(now: Column) -> Column:
    """The start of the period that a digest looks back on."""
    return now - F.expr("INTERVAL 1 DAY")


def concatenated(*tables: DataFrame) -> DataFrame:
    """The rows of several sources or calendars, columns by name; a column that one lacks is null there."""
    first, *others = tables
    for t in others:
        first = first.unionByName(t, allowMissingColumns=True)
    return first


def first_matching(rows: DataFrame, condition: Column, most: int, *order: Column) -> DataFrame:
    """The first `most` rows that meet a condition: the limit comes after the filter."""
    return rows.where(condition).orderBy(*order).limit(most)


def bounded_list(values: Column, most: int) -> Column:
    """A list cut to its first `most` members."""
    return F.slice(values, 1, most)


def message_sets(rows: DataFrame, keys: list[str], message: str = "message_id") -> DataFrame:
    """(keys, message) once each, whatever sources name it."""
    return rows.select(*keys, message).distinct()


def without_max_length(schema):
    """A JSON schema without its maxLength constraints, at any depth."""
    if isinstance(schema, list):
        return list(map(without_max_length, schema))
    if not isinstance(schema, dict):
        return schema
    return {k: without_max_length(schema[k]) for k in schema.keys() - {"maxLength"}}


def robots_allow(agent: str):
    """UDF (status, robots text, url): whether a site's robots file lets an agent read a page.

    A file that isn't there, isn't text with both a user agent and a rule, or can't be read forbids nothing.
    """

    @F.pandas_udf("boolean")
    def allowed(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, RobotFileParser | None] = {}

        def rules(text: str) -> RobotFileParser | None:
            if text not in known:
                fields = {line.partition(":")[0].strip().lower() for line in text.splitlines() if ":" in line}
                known.clear() if len(known) > 256 else None
                known[text] = RobotFileParser() if {"user-agent", "disallow"} <= fields else None
                if known[text]:
                    known[text].parse(text.splitlines())
            return known[text]

        for status, robots, urls in batches:
            yield pd.Series([s != 200 or (r := rules(t or "")) is None or r.can_fetch(agent, u or "") for s, t, u in zip(status, robots, urls, strict=True)], dtype=bool)

    return allowed
