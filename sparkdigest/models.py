"""Model-backed steps as callables, with stand-ins that need no model and always answer the same."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdigest.functions.text import identity_tokens, word_tokens

#: Text to items (array of structs) or an error code; a repair is tried once by whoever implements it.
Extractor = Callable[[Column], Column]
#: Title and text of an article to one item.
Analyser = Callable[[Column, Column], Column]
#: Subject, name and sender of a subscription to one of five classes.
Classifier = Callable[[Column, Column, Column], Column]
#: Title and summary to a relevance from 0 to 1.
Reranker = Callable[[Column, Column], Column]
#: Candidates (digest_id, seq, reranker_score) and a maximum to (digest_id, seq, review_score).
Reviewer = Callable[[DataFrame, int], DataFrame]
#: Whether two entries tell the same story.
Judge = Callable[[dict[str, Any], dict[str, Any]], bool]
#: Title, sources and text to struct(summary, why, covers).
Rewriter = Callable[[Column, Column, Column], Column]


def overlap_scores(title: Column, summary: Column) -> Column:
    """Share of the summary's words that the title has."""
    t, s = word_tokens(title), word_tokens(summary)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(t, s)).cast("double"), F.size(s).cast("double")), F.lit(0.0))


def top_scores(candidates: DataFrame, most: int) -> DataFrame:
    """The best candidates of each digest, scored from 100 downwards."""
    from sparkdigest.operators.entries import numbered

    placed = numbered(candidates, ["digest_id"], F.desc("reranker_score"), F.col("seq"))
    return placed.where(F.col("rank") <= most).select("digest_id", "seq", (101.0 - F.col("rank")).alias("review_score"))


def same_title(a: dict[str, Any], b: dict[str, Any]) -> bool:
    return " ".join(str(a["title"]).lower().split()) == " ".join(str(b["title"]).lower().split())


def lines_as_items(text: Column) -> Column:
    """Each line with an identity token as an item."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.size(identity_tokens(x)) > 0)
    return F.transform(lines, lambda x: F.struct(F.left(x, F.lit(200)).alias("title"), F.left(x, F.lit(800)).alias("summary")))


def first_sentences(title: Column, sources: Column, text: Column) -> Column:
    """The text's beginning as the rewrite; it covers the item if it shares an identity token with the title."""
    covers = F.arrays_overlap(identity_tokens(title), identity_tokens(text))
    return F.struct(F.left(text, F.lit(800)).alias("summary"), sources.alias("why"), covers.alias("covers"))
