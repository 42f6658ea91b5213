"""Model calls in two batched passes: rows whose answer breaks a rule go round once more, what fails again is quarantined.

A model is a function on the executors; answers are written before they are judged, so that no call is made twice. Judging is a
native expression over the answer, the rules of operators/checks among them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdigest.functions.text import injects_markup
from sparkdigest.operators import checks
from sparkdigest.operators.entries import fold_entries
from sparkdigest.operators.state import append_scores
from sparkdigest.session import scratch

#: Prompts, answers before (None on the first pass) and what was wrong with them, to answers; None if a call failed.
Model = Callable[[list[str], list[str | None], list[str | None]], list[str | None]]

# What a model is asked to return, codes, items of a message at most.
ITEM = "struct<title:string,category:string,summary:string,why:string,importance:double,confidence:double,tags:array<string>>"
EXTRACTION = f"struct<overview:string,items:array<{ITEM}>>"
REWRITE = "struct<summary:string,why:string,covers:boolean>"
INVALID, NO_ANSWER = "SCHEMA_INVALID", "MODEL_CALL_FAILED"
MOST_ITEMS = 10


def lines_model(prompts: list[str], before: list[str | None], wrong: list[str | None]) -> list[str | None]:
    """Stand-in without a model: a text's lines as items, with the whole text as overview; asked again it says less."""
    out = []
    for text, was in zip(prompts, before, strict=True):
        line, whole = (None, None) if was is None else (250, 1500)
        items = [{"title": x[:line], "category": "OTHER", "summary": x[:100], "why": "it is there", "importance": 5, "confidence": 0.5, "tags": []} for x in text.split("\n") if x.strip()]
        out.append(json.dumps({"overview": text[:whole], "items": items}))
    return out


def first_line_model(prompts: list[str], before: list[str | None], wrong: list[str | None]) -> list[str | None]:
    """Stand-in without a model: a rewrite is the first words of the source; it covers the item if they share one with the title."""
    out = []
    for prompt in prompts:
        title, _, source = prompt.partition("\nbasis=")
        words = re.findall(r"\w+", source.partition("\n")[2])[:40]
        out.append(json.dumps({"summary": " ".join(words), "why": "it is there", "covers": bool(set(words) & set(re.findall(r"\w+", title)))}))
    return out


def asked(rows: DataFrame, key: str, prompt: Column, model: Model, judge: Callable[[Column], Column], batch: int = 16) -> DataFrame:
    """(key, answer, error, calls) of every row: the answer that no rule is broken by, after one call or two, else null and the
    code of what was wrong with the last one. judge(answer) gives a code or null; a failed call is not repaired.

    A null prompt is not asked for: its error is NO_ANSWER after no call. The model gets `batch` rows at a time."""
    folder = scratch(rows.sparkSession, "calls")
    schema = f"{key} {dict(rows.dtypes)[key]}, prompt string, answer string"

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                told = [[None if x is None or x != x else x for x in part[c]] for c in ("prompt", "answer", "error")]
                yield part[[key, "prompt"]].assign(answer=model(*told))

    def passed(df: DataFrame, n: int) -> DataFrame:
        df.mapInPandas(call, schema).write.parquet(f"{folder}/{n}")
        found = rows.sparkSession.read.schema(schema).parquet(f"{folder}/{n}")
        return found.withColumn("error", F.when(F.col("answer").isNull(), NO_ANSWER).otherwise(judge(F.col("answer"))))

    none = F.lit(None).cast("string")
    prompts = rows.select(key, prompt.alias("prompt"))
    first = passed(prompts.where("prompt is not null").select(key, "prompt", none.alias("answer"), none.alias("error")), 1)
    second = passed(first.where(F.col("error") != NO_ANSWER), 2)
    told = lambda df, calls: df.select(key, F.when(F.col("error").isNull(), F.col("answer")).alias("answer"), "error", F.lit(calls).alias("calls"))
    ended = told(first.where(F.col("error").isNull() | (F.col("error") == NO_ANSWER)), 1).unionByName(told(second, 2))
    silent = prompts.where("prompt is null").select(key, none.alias("answer"), F.lit(NO_ANSWER).alias("error"), F.lit(0).alias("calls"))
    return ended.unionByName(silent)


def parsed(answer: Column, schema: str) -> Column:
    """A model's JSON as a struct; null if it is none or lacks what the schema names."""
    return F.from_json(answer, schema, {"mode": "PERMISSIVE"})


def extraction_error(answer: Column) -> Column:
    """The first rule that an extraction breaks, or null: its form, its overview, the first MOST_ITEMS items."""
    x = parsed(answer, EXTRACTION)
    item = lambda i: checks.item_error(i["title"], i["category"], i["summary"], i["why"], i["importance"], i["confidence"], F.coalesce(i["tags"], F.array().cast("array<string>")))
    broken = F.filter(F.transform(F.slice(x["items"], 1, MOST_ITEMS), item), lambda e: e.isNotNull())
    whole = x["items"].isNotNull() & x["overview"].isNotNull()
    return F.when(~F.coalesce(whole, F.lit(False)), INVALID).otherwise(F.coalesce(checks.overview_error(x["overview"]), F.get(broken, F.lit(0))))


def rewrite_error(answer: Column) -> Column:
    """The first rule that a rewrite breaks, or null."""
    x = parsed(answer, REWRITE)
    whole = x["summary"].isNotNull() & x["why"].isNotNull() & x["covers"].isNotNull()
    return F.when(~F.coalesce(whole, F.lit(False)), INVALID).when(injects_markup(x["summary"]) | injects_markup(x["why"]), "TEXT_LINKS")


def extracted(messages: DataFrame, key: str, prompt: Column, model: Model, judge: Callable[[Column], Column] = extraction_error) -> DataFrame:
    """(key, overview, items, error, calls) of every message: at most MOST_ITEMS items each, none where the model failed twice."""
    found = asked(messages, key, prompt, model, judge)
    x = parsed(F.col("answer"), EXTRACTION)
    return found.select(key, x["overview"].alias("overview"), F.slice(x["items"], 1, MOST_ITEMS).alias("items"), "error", "calls")


def deepened(entries: DataFrame, articles: DataFrame, model: Model, detected: Callable[[DataFrame], DataFrame] | None = None, language: str | None = None) -> DataFrame:
    """entries(entry_id, review_score, title, summary, why, merged_summaries, ...) whose headlines' texts are written anew from fuller
    ones, with basis and rewrite_error: why a headline kept its own text, null if it didn't.

    Headlines are those with a review score. They are rewritten from articles(entry_id, text), else from the merged summaries;
    one with neither isn't asked for (NO_SOURCE). A rewrite goes if the call failed twice, if it says that the source doesn't
    cover the item (NOT_COVERED), or if it isn't in the language (WRONG_LANGUAGE): detected(df(text)) adds that. Repeated
    articles of an entry: the greatest text."""
    told = articles.groupBy(F.col("entry_id").alias("article_id")).agg(F.max("text").alias("article_text"))
    both = entries.join(told, F.col("entry_id") == F.col("article_id"), "left").drop("article_id")
    merged = F.coalesce("merged_summaries", F.array().cast("array<string>"))
    basis = F.when(F.coalesce("article_text", F.lit("")) != "", "article").when(F.size(merged) > 0, "newsletters")
    source = F.when(basis == "article", F.col("article_text")).when(basis == "newsletters", F.concat(F.array_join(merged, "\n\n"), F.lit("\n\n"), F.coalesce("why", F.lit(""))))
    both = both.withColumn("basis", F.when(F.col("review_score").isNotNull(), basis)).withColumn("source_text", source)
    wanted = both.where(F.col("basis").isNotNull())
    answers = asked(wanted, "entry_id", F.concat_ws("\n", F.concat(F.lit("title="), "title"), F.concat(F.lit("basis="), "basis"), "source_text"), model, rewrite_error)
    x = parsed(F.col("answer"), REWRITE)
    new = answers.select(F.col("entry_id").alias("answer_id"), x.alias("new__"), F.col("error").alias("error__"))
    if detected is not None:
        new = detected(new.withColumn("text", F.concat_ws("\n", "new__.summary", "new__.why"))).drop("text", "margin").withColumnRenamed("detected", "language__")
    else:
        new = new.withColumn("language__", F.lit(language).cast("string"))
    found = both.join(new, F.col("entry_id") == F.col("answer_id"), "left")
    wrong = F.lit(language is not None) & ~F.col("language__").eqNullSafe(F.lit(language))
    error = F.when(F.col("review_score").isNull(), None).when(F.col("basis").isNull(), "NO_SOURCE").otherwise(F.coalesce("error__", F.when(~F.col("new__.covers"), "NOT_COVERED"), F.when(wrong, "WRONG_LANGUAGE")))
    found = found.withColumn("rewrite_error", error)
    good = F.col("new__").isNotNull() & F.col("rewrite_error").isNull()
    texts = {"summary": F.when(good, F.col("new__.summary")).otherwise(F.col("summary")), "why": F.when(good, F.col("new__.why")).otherwise(F.col("why"))}
    return found.withColumns(texts).select(*entries.columns, "basis", "rewrite_error")


def rendered(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Entries folded once more as they are rendered: rewrites and merges may have made links or titles equal."""
    return fold_entries(entries, keys)


def score_audit(scored: DataFrame, live: DataFrame, model: str, version: str) -> DataFrame:
    """(item_id, score, model, prompt_version) to append: finite scores of items that still exist, one for each item, the
    greatest of several."""
    one = scored.groupBy("item_id").agg(F.max(F.when(~F.isnan("score"), F.col("score"))).alias("score"))
    return append_scores(one, live).select("item_id", "score", F.lit(model).alias("model"), F.lit(version).alias("prompt_version"))
