"""Newsletter subscriptions from mail headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdigest.functions.text import short_hash, slug

ADDRESS = r"<\s*([^<>\s]+)\s*>\s*$"
# Categories by label.
CATEGORIES = {"ai-newspaper": "AI", "cloud-data-newspaper": "CLOUD_DATA", "cyber-newspaper": "CYBERSECURITY", "dev-newspaper": "SOFTWARE_ENGINEERING", "product-business-newspaper": "PRODUCT_BUSINESS"}


def header_map(headers: Column) -> Column:
    """array<struct<name, value>> to a map with names in lower case; of repeated names the last stays."""
    low = F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("k"), h["value"].alias("v")))
    names = F.array_distinct(F.transform(low, lambda h: h["k"]))
    last = lambda k: F.element_at(F.filter(low, lambda h: h["k"] == k), -1)["v"]
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k, last(k))))


def sender_of(from_header: Column) -> tuple[Column, Column]:
    """Name and address (lower case) of a From header."""
    bracketed = from_header.rlike(ADDRESS)
    address = F.when(bracketed, F.regexp_extract(from_header, ADDRESS, 1)).when(F.contains(from_header, F.lit("@")), F.trim(from_header)).otherwise("")
    name = F.when(bracketed, F.trim(F.regexp_replace(F.regexp_replace(from_header, ADDRESS, ""), r'^\s*"|"\s*$', ""))).otherwise("")
    return F.trim(F.regexp_replace(name, r'"\s*$', "")), F.lower(address)


def identity(headers: Column) -> Column:
    """struct(key, list_id, basis): the list's id, else a hash of the provider's, else the From header."""
    get = lambda k: F.trim(F.coalesce(F.try_element_at(headers, F.lit(k)), F.lit("")))
    raw = get("list-id")
    inner = F.nullif(F.regexp_extract(raw, r"<([^<>]+)>", 1), F.lit(""))
    list_id = F.nullif(F.trim(F.coalesce(inner, raw)), F.lit(""))
    provider = F.nullif(get("x-emailoctopus-list-id"), F.lit(""))
    name, address = sender_of(get("from"))
    shown = F.coalesce(F.nullif(name, F.lit("")), address)
    key = F.coalesce(F.lower(list_id), F.concat(F.lit("emailoctopus:"), short_hash(provider, 16)), F.concat(F.lit("from:"), F.lower(get("from"))))
    return F.struct(key.alias("key"), list_id.alias("list_id"), F.coalesce(list_id, shown).alias("basis"))


def newsletters(messages: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Messages (seq, headers map) that come from a list, with key, list_id, basis, name and sender; the first of each key."""
    get = lambda k: F.coalesce(F.try_element_at("headers", F.lit(k)), F.lit(""))
    name, sender = sender_of(get("from"))
    found = messages.withColumn("i", identity(F.col("headers"))).withColumn("name", name).withColumn("sender", sender)
    found = found.select("*", "i.*").drop("i").where((F.col("list_id").isNotNull() | (get("list-unsubscribe") != "") | (get("x-emailoctopus-list-id") != "")) & (F.col("sender") != ""))
    if excluded is not None:
        found = found.join(excluded.select("key").distinct(), "key", "left_anti")
    shown = F.coalesce(F.nullif("name", F.lit("")), F.split_part(F.col("list_id"), F.lit("."), F.lit(1)), F.col("sender"))
    found = found.withColumn("name", shown)
    cols = [c for c in found.columns if c != "key"]
    return found.groupBy("key").agg(F.min_by(F.struct(*cols), "seq").alias("r")).select("key", "r.*")


def with_counts(found: DataFrame) -> DataFrame:
    """How many subscriptions share a sender, and a sender and name."""
    return found.withColumn("sender_count", F.count(F.lit(1)).over(Window.partitionBy("sender"))).withColumn("identity_count", F.count(F.lit(1)).over(Window.partitionBy(F.lower("name"), "sender")))


def with_source(found: DataFrame, sources: DataFrame) -> DataFrame:
    """The configured source of each: same sender and name, else the only source of an only subscription of a sender.

    sources(source_id, source_name, source_sender, source_seq).
    """
    named = sources.groupBy(F.col("source_sender").alias("sender"), slug(F.col("source_name")).alias("slug")).agg(F.min_by("source_id", "source_seq").alias("by_name"))
    only = sources.groupBy(F.col("source_sender").alias("sender")).agg(F.min("source_id").alias("by_sender"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    both = found.withColumn("slug", slug(F.col("name"))).join(named, ["sender", "slug"], "left").join(only, "sender", "left")
    return both.withColumn("source_id", F.coalesce("by_name", F.when(F.col("sender_count") == 1, F.col("by_sender")))).drop("by_name", "by_sender", "slug")


def suffixed_ids(found: DataFrame, used: list[str]) -> DataFrame:
    """source_id for those without: the slug of their basis, with -2, -3, ... where it is taken, in the order of keys.

    Whether an id is free depends on the ids given before, so one task decides; only those of one base can meet, which is
    the group, except that a base may equal another's suffixed id: all new ids of a mailbox are one group. A mailbox has
    as many subscriptions as a person reads.
    """
    taken = set(used) | {"list"}

    def name(rows: pd.DataFrame) -> pd.DataFrame:
        rows, seen = rows.sort_values("key").copy(), set(taken)
        for at in rows.index:
            if pd.isna(rows.at[at, "source_id"]) or rows.at[at, "source_id"] is None:
                base = rows.at[at, "base_id"] or "newsletter"
                free, n = base, 1
                while free in seen:
                    n += 1
                    free = f"{base}-{n}"
                rows.at[at, "source_id"] = free
            seen.add(rows.at[at, "source_id"])
        return rows.drop(columns="base_id")

    based = found.withColumn("base_id", slug(F.col("basis")))
    return based.groupBy("mailbox").applyInPandas(name, found.schema)


def query_of(name: Column, sender: Column, shared: Column, label: Column) -> Column:
    """The search that finds a subscription's mail; a sender that several share needs the name, too."""
    quoted = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    base = F.when(shared, F.concat(F.lit("from:"), sender, F.lit(' from:"'), quoted, F.lit('"'))).otherwise(F.concat(F.lit("from:"), sender))
    return F.when(label.isNotNull(), F.concat(F.lit("label:"), label, F.lit(" "), base)).otherwise(base)


def source_sender(criteria_from: Column, query: Column) -> Column:
    """A configured source's sender: its filter's, or the first from: of its query."""
    quoted = F.regexp_extract(query, r'(?i)(?:^|\s)from:(?:"([^"]+)"|(\S+))', 1)
    bare = F.regexp_extract(query, r'(?i)(?:^|\s)from:(?:"([^"]+)"|(\S+))', 2)
    return F.lower(F.coalesce(criteria_from, F.nullif(quoted, F.lit("")), F.nullif(bare, F.lit(""))))


def category_of(labels: Column, names: Column) -> Column:
    """The category of the first label that has one; labels are ids, names a map from id to name."""
    known = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    return F.coalesce(F.get(F.filter(F.transform(labels, lambda k: F.try_element_at(known, F.try_element_at(names, k))), lambda x: x.isNotNull()), F.lit(0)), F.lit("OTHER"))
