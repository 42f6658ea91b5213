"""Records around the pipelines: configuration as tables, redirects, fetching, deliveries, audits, JSON."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdigest.functions.text import TOKENS_CJK, TOKENS_OTHER
from sparkdigest.operators.schedule import RULES

SOURCES = "source_seq int, source_id string, source_name string, type string, enabled boolean, category string, options map<string,string>"


def rules_table(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """A reminder configuration (default_rules, rules) as a table of RULES; the defaults are rule 0, named default."""
    spans = lambda items: [(r.get("id"), r["before"]) for r in items or []]
    rows = [(0, "default", None, None, None, None, None, spans(config.get("default_rules")))]
    for k, rule in enumerate(config.get("rules") or [], 1):
        m = rule.get("match") or {}
        rows.append((k, rule["id"], m.get("calendar_id"), m.get("has_location"), m.get("all_day"), m.get("title_contains"), m.get("location_contains"), spans(rule.get("reminders"))))
    return spark.createDataFrame(rows, RULES)


def sources_table(spark: SparkSession, config: dict[str, Any], only: str | None = None) -> DataFrame:
    """The enabled sources of a configuration, or the one asked for; none at all is an error."""
    known = ("id", "name", "type", "enabled", "category")
    rows = [(k, s["id"], s.get("name", s["id"]), s["type"], s.get("enabled", True), s.get("category", "OTHER"), {a: str(b) for a, b in s.items() if a not in known}) for k, s in enumerate(config["sources"])]
    kept = [r for r in rows if r[4] and only in (None, r[1])]
    if not kept:
        raise ValueError("no enabled source" if only is None else f"no enabled source {only!r}")
    return spark.createDataFrame(kept, SOURCES)


def named_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's name, or its id where it has none."""
    names = sources.select("source_id", F.col("source_name").alias("_name"))
    return rows.join(names, "source_id", "left").withColumn("source_name", F.coalesce("_name", "source_id")).drop("_name")


def follow_redirects(urls: DataFrame, hops: DataFrame, most: int = 5) -> DataFrame:
    """(raw_url, final_url, n_hops, error) of each link along hops(url, location); more than `most` is an error.

    One join a hop, each on the links that still move; a loop is a chain too long.
    """
    step = hops.groupBy("url").agg(F.min("location").alias("location"))
    at = urls.select("raw_url").distinct().withColumn("final_url", F.col("raw_url")).withColumn("n_hops", F.lit(0))
    for _ in range(most + 1):
        moved = at.join(step, at["final_url"] == step["url"], "left")
        at = moved.select("raw_url", F.coalesce("location", "final_url").alias("final_url"), (F.col("n_hops") + F.col("location").isNotNull().cast("int")).alias("n_hops"))
    return at.withColumn("error", F.when(F.col("n_hops") > most, "URL_TOO_MANY_REDIRECTS")).withColumn("final_url", F.when(F.col("error").isNull(), F.col("final_url")))


FETCHED = "url string, status int, content_type string, body binary, error string"


def fetched(urls: DataFrame, get: Callable[[str], tuple[int, str, bytes]], most: int = 2 << 20) -> DataFrame:
    """FETCHED of urls(url) by a function of the caller's, on the executors; failures and bodies that are too large are codes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    status, kind, body = get(url)
                    large = len(body) > most
                    rows.append((url, status, kind, None if large else body, "ARTICLE_TOO_LARGE" if large else None))
                except Exception as e:  # whatever a site does, its row says so
                    rows.append((url, None, None, None, f"FETCH_FAILED:{type(e).__name__}"))
            yield pd.DataFrame(rows, columns=["url", "status", "content_type", "body", "error"]).astype({"status": "Int32"})

    return urls.select("url").mapInPandas(run, FETCHED)


@F.pandas_udf(T.StringType())
def shrunk_to_budget(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Text cut in proportion until its estimated tokens fit the budget; none fits a budget of nothing."""
    wide = lambda t: sum("㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿" for c in t)

    def fit(t: str | None, budget: int) -> str | None:
        if t is None or budget <= 0:
            return None if t is None else ""
        while t:
            w = wide(t)
            used = math.ceil(w * TOKENS_CJK + (len(t) - w) * TOKENS_OTHER)
            if used <= budget:
                break
            t = t[: max(1, len(t) * budget // used)] if len(t) > 1 else ""
        return t

    for texts, budgets in parts:
        yield pd.Series([fit(t, int(b)) for t, b in zip(texts, budgets, strict=True)], dtype=object)


def new_deliveries(parents: DataFrame, destinations: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Pending deliveries of each parent to each destination that has none yet; destinations are a configured few, which come to
    each row as one list."""
    listed = destinations.agg(F.array_sort(F.collect_set("destination_key"))).scalar()
    pairs = parents.select(key, F.explode(listed).alias("destination_key"))
    return pairs.join(stored.select(key, "destination_key"), [key, "destination_key"], "left_anti").withColumn("state", F.lit("pending"))


def filter_audit(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """desired(source_id, label, criteria map) with found: whether a service's filter(label, criteria) is the same."""
    form = lambda c: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    have = existing.select("label", form(F.col("criteria")).alias("_c")).distinct().withColumn("found", F.lit(True))
    return desired.withColumn("_c", form(F.col("criteria"))).join(have, ["label", "_c"], "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("_c")


def json_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, result): each row as one JSON object."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("result"))


def exit_code(status: Column) -> Column:
    """What a command returns: 1 if something is left undone."""
    return F.when(status.isin("partial", "failed"), 1).otherwise(0)
