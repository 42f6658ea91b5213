"""Constraints as quarantine columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdigest.functions.text import injects_markup

# Categories of items and states of records.
CATEGORIES = ["AI", "CLOUD_DATA", "SECURITY", "CYBERSECURITY", "SOFTWARE_ENGINEERING", "PRODUCT_BUSINESS", "OTHER"]
STATES = {"document": ["discovered", "processing", "processed", "failed"], "attempt": ["pending", "delivered", "failed", "expired", "cancelled"]}
FILTER_KEYS = ["from", "to", "subject", "query", "negatedQuery", "hasAttachment", "excludeChats", "size", "sizeComparison"]


def item_error(title: Column, category: Column, summary: Column, why: Column, importance: Column, confidence: Column, tags: Column) -> Column:
    """The first rule that a model's item breaks, or null."""
    texts = [title, summary, why]
    return F.coalesce(
        F.when(~F.coalesce(F.length(title).between(1, 200), F.lit(False)), "TITLE_LENGTH"),
        F.when(~F.coalesce(F.length(summary).between(1, 800) & F.length(why).between(1, 800), F.lit(False)), "TEXT_LENGTH"),
        F.when(~F.coalesce(importance.between(1, 10), F.lit(False)), "IMPORTANCE_RANGE"),
        F.when(~F.coalesce(confidence.between(0, 1) & ~F.isnan(confidence), F.lit(False)), "CONFIDENCE_RANGE"),
        F.when(~F.coalesce(category.isin(CATEGORIES), F.lit(False)), "CATEGORY_UNKNOWN"),
        F.when(F.size(tags) > 8, "TAGS_COUNT"),
        F.when(F.exists(tags, lambda t: F.length(t) > 40), "TAG_LENGTH"),
        F.when(F.exists(F.array(*texts), injects_markup), "TEXT_LINKS"),
    )


def overview_error(overview: Column) -> Column:
    return F.when(F.length(overview) > 1500, "OVERVIEW_LENGTH").when(injects_markup(overview), "TEXT_LINKS")


def review_error(selected: Column, candidates: Column, most: int) -> Column:
    """A review may select so many ids, each once, and only candidates."""
    return (
        F.when(F.size(selected) > most, "TOO_MANY")
        .when(F.size(F.array_distinct(selected)) < F.size(selected), "REPEATED")
        .when(F.size(F.array_except(selected, candidates)) > 0, "UNKNOWN_ID")
    )


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that should be unique and aren't, with their number."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def id_error(value: Column) -> Column:
    return F.when(~value.rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$"), "ID_FORMAT").when(value == "list", "ID_RESERVED")


def unknown_keys(criteria: Column) -> Column:
    """Keys of a filter that no service knows."""
    return F.array_except(F.map_keys(criteria), F.array(*map(F.lit, FILTER_KEYS)))


def state_error(state: Column, kind: str) -> Column:
    return F.when(~F.coalesce(state.isin(STATES[kind]), F.lit(False)), "STATE_UNKNOWN")
