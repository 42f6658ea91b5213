"""Feed stories: rank, lookup, filter, retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranked_feed(feeds: DataFrame, most: int = 200) -> DataFrame:
    """(feed, feed_rank, id) of feeds(feed, ids), ids a JSON list of integers: ranks from 1, the first `most` of them.

    A list with anything but integers gives no rows.
    """
    ok = F.col("ids").rlike(r"^\s*\[\s*(?:-?\d+\s*(?:,\s*-?\d+\s*)*)?\]\s*$")
    found = feeds.where(ok).select("feed", F.posexplode(F.from_json("ids", "array<bigint>")).alias("pos", "id"))
    return found.where(F.col("pos") < max(1, min(most, 200))).select("feed", (F.col("pos") + 1).alias("feed_rank"), "id")


def with_items(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """Stories of a feed with their items; ids without one stay, with nulls."""
    return ranked.join(items, "id", "left")


def candidates(stories: DataFrame, now: Column, max_age_hours: int, min_score: int, min_comments: int, enforce: bool = True) -> DataFrame:
    """Live stories with a title and a link or a text of their own, with their kind; age, score and comments are tested
    unless enforce is False, as it is when a story is tried again."""
    score, comments = F.coalesce("score", F.lit(0)), F.coalesce("descendants", F.lit(0))
    kind = F.when(F.coalesce("url", F.lit("")) != "", "external").when(F.trim(F.coalesce("text", F.lit(""))) != "", "self_post")
    live = (F.col("type") == "story") & ~F.coalesce("dead", F.lit(False)) & ~F.coalesce("deleted", F.lit(False)) & (F.trim("title") != "")
    published = F.timestamp_seconds("time")
    found = stories.where(live & kind.isNotNull())
    if enforce:
        age = F.unix_micros(now) - F.unix_micros(published)
        found = found.where((age <= max_age_hours * 3_600_000_000) & (score >= min_score) & (comments >= min_comments))
    return found.withColumn("published_at", published).withColumn("score", score).withColumn("comments", comments).withColumn("content_kind", kind)


def capped_confidence(confidence: Column, basis: Column, cap: float = 0.6) -> Column:
    """Confidence in what was read from metadata alone is capped."""
    return F.when(basis == "metadata", F.least(confidence, F.lit(cap))).otherwise(confidence)
