"""A digest from entries: limit, fold, score, quota, review, merge, mention limit."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdigest.models import Judge, Reranker, Reviewer, overlap_scores, same_title, top_scores
from sparkdigest.operators import entries as e
from sparkdigest.operators import matching, selection
from sparkdigest.plans import calls
from sparkdigest.session import scratch


def assemble(rows: DataFrame, rerank: Reranker = overlap_scores, review: Reviewer = top_scores, judge: Judge = same_title, newest: int = 100, limit: int = 20, slots: int = 7, top: int = 5, mentions: int = 10, reserved: str = "SECURITY", columns: tuple[str, ...] = ()) -> DataFrame:
    """(digest_id, seq, title, section, also_from, rank) of each digest, with further columns of its entries if they are named.

    Only the newest entries are looked at, before duplicates are folded. Scores come from pluggable models: a reranker over
    columns, a reviewer over each digest's candidates, a judge of pairs.
    """
    key = "digest_id"
    recent = e.numbered(rows, [key], F.desc_nulls_last("published"), F.col("seq"), name="_age").where(F.col("_age") <= newest).drop("_age")
    # a digest's entries fold among themselves: the key is part of what folds
    folded = e.fold_entries(recent, [key])
    scored = folded.withColumn("reranker_score", rerank(F.col("title"), F.col("summary")))
    ranked = e.numbered(scored, [key], F.desc("reranker_score"), F.col("pos"), name="place")
    chosen = selection.quota_top_k(ranked, F.col("category") == reserved, limit, slots, [key], "place")
    scores = review(chosen.select(key, "seq", "reranker_score"), top)
    reviewed = chosen.drop("review_score").join(scores, [key, "seq"], "left")
    merged = matching.merge_related(reviewed.select(key, "seq", "review_score", "title", "summary"), judge)
    absorbed = merged.join(reviewed.select(key, "seq", "source_name"), [key, "seq"]).where("seq <> leader_seq").groupBy(key, F.col("leader_seq").alias("seq")).agg(F.array_sort(F.collect_set("source_name")).alias("more"))
    kept = merged.where("seq = leader_seq").select(key, "seq", F.when(F.col("phase") == "headline", "headline").otherwise("mention").alias("section")).join(reviewed, [key, "seq"]).join(absorbed, [key, "seq"], "left")
    names = F.array_except(F.array_distinct(F.concat("also_from", F.coalesce("more", F.array().cast("array<string>")))), F.array("source_name"))
    shown = selection.mention_limit(kept.withColumn("also_from", names), mentions, [key], F.col("place"))
    order = (F.col("section") != "headline", F.desc_nulls_last("review_score"), F.col("place"))
    return e.numbered(shown, [key], *order).select(key, "seq", "title", "section", "also_from", "rank", *columns)


class Published(NamedTuple):
    """What a run puts out: the digests as they are rendered, and the scores to append to their log."""

    entries: DataFrame
    scores: DataFrame


#: What an entry needs to be folded once more.
_FOLDED = ("summary", "source_name", "article_url", "discussion_url", "hn_item_id", "review_score", "reranker_score", "importance", "confidence", "hn_score", "hn_comments", "published", "merged_summaries")


def published(
    rows: DataFrame, articles: DataFrame, model: calls.Model, live: DataFrame, names: tuple[str, str], detected: Callable[[DataFrame], DataFrame] | None = None, language: str | None = None, **options: Any
) -> Published:
    """Digests of rows(why and what assemble() needs), whose headlines are written anew where that holds, and folded once more.

    entries is (digest_id, seq, title, section, also_from, summary, why, basis, rewrite_error, rank): a rewrite that fails, doesn't
    cover its item or is in another language leaves the entry as it was (calls.deepened); articles(digest_id, seq, text)
    are the headlines' sources. Entries that have become the same since they were assembled are folded, and ranks go on
    without gaps. scores is (item_id, score, model, prompt_version) of the entries that were assembled, live(item_id) ones
    with finite scores; names are the reranker's model and version. An entry's item is named digest_id:seq. options go to assemble().
    """
    key, item = "digest_id", F.concat_ws(":", "digest_id", "seq")
    folder = scratch(rows.sparkSession, "digest")
    chosen = assemble(rows, columns=(*_FOLDED, "why"), **options)
    # models are asked about what was assembled, so it is put down first
    chosen.write.parquet(folder)
    chosen = rows.sparkSession.read.schema(chosen.schema).parquet(folder).withColumn("entry_id", item)
    sources = articles.select(item.alias("entry_id"), "text")
    deep = calls.deepened(chosen, sources, model, detected, language)
    folded = calls.rendered(deep.drop("entry_id"), [key])
    shown = e.numbered(folded.withColumnRenamed("rank", "place"), [key], F.col("place"))
    scores = calls.score_audit(chosen.select(F.col("entry_id").alias("item_id"), F.col("reranker_score").alias("score")), live, *names)
    return Published(shown.select(key, "seq", "title", "section", "also_from", "summary", "why", "basis", "rewrite_error", "rank"), scores)
