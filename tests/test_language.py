"""Languages by letter n-grams, against plain Python and on texts that the profiles have not seen."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkdigest import queries
from sparkdigest.functions import language
from tests.conftest import SMALL


def _features(text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    number = lambda g: sum(ord(c) * 131 ** (2 - k) for k, c in enumerate(g)) % 4093
    return [number(("^" + w)[:3]) for w in words] + [number((w + "$")[-3:]) for w in words]


def _plain(train, texts):
    counts = {}
    for text, lang in train:
        if lang is not None:
            counts.setdefault(lang, Counter()).update(_features(text))
    counts = {k: c for k, c in counts.items() if c}
    out = []
    for text in texts:
        found = _features(text)
        sums = sorted(((-sum(math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * 4093)) for b in found), k) for k, c in counts.items()))
        out.append((sums[0][1] if found and sums else None, (sums[1][0] - sums[0][0]) / len(found) if found and len(sums) > 1 else None))
    return out


TRAIN = [("the cat and the dog are in the house", "en"), ("there is nothing that they have not seen", "en"), ("der hund und die katze sind im haus", "de"), ("es gibt nichts was sie nicht gesehen haben", "de"), ("le chien et le chat sont dans la maison", "fr"), (None, "fr"), ("???", "xx"), ("nobody said", None)]
TEXTS = ["the house that they have", "die haben nicht", "le chat", "", None, "12 !?", "ÉTÉ été", "x", "the", "日本語 テキスト", "a " * 5000]


def test_equals_plain_python(spark):
    train = spark.createDataFrame(TRAIN, "text string, lang string")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    rows = sorted(language.detected(docs, language.profiles(train)).collect())
    for r, (lang, margin) in zip(rows, _plain(TRAIN, TEXTS), strict=True):
        assert r.detected == lang and (r.margin is None) == (margin is None) and (margin is None or math.isclose(r.margin, margin, abs_tol=1e-9))


def test_a_small_margin_is_no_language(spark):
    train = spark.createDataFrame(TRAIN, "text string, lang string")
    docs = spark.createDataFrame([(0, "the house that they have"), (1, "zzz")], "id int, text string")
    assert [r.detected for r in sorted(language.detected(docs, language.profiles(train), least=0.2).collect())] == ["en", None]


def test_nothing_learnt_and_nothing_given(spark):
    docs = spark.createDataFrame([(0, "the house")], "id int, text string")
    none = spark.createDataFrame([], "text string, lang string")
    assert [(r.detected, r.margin) for r in language.detected(docs, language.profiles(none)).collect()] == [(None, None)]
    one = spark.createDataFrame(TRAIN[:1], "text string, lang string")
    assert [(r.detected, r.margin) for r in language.detected(docs, language.profiles(one)).collect()] == [("en", None)]
    assert language.detected(docs.limit(0), language.profiles(one)).count() == 0


def test_too_many_languages_are_refused(spark):
    many = spark.range(201).select(F.lit("word").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(Exception, match="more than 200"):
        language.profiles(many).collect()


def test_held_out_accuracy(spark):
    rows = queries.queries()["language_detected"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    told = [r for r in rows if r.detected is not None]
    right = sum(r.lang == r.detected for r in told)
    assert len(rows) == 200 and len(told) >= 190 and right >= 0.9 * len(told)
    assert queries.queries()["language_detected"](spark, SMALL).count() == 200


def test_words_are_numbered_in_batches_and_not_one_by_one(spark):
    texts = ["", "a", "été 日本 x", "\U00010428\U00010429 ab abc abcd", "one two " * 300]
    assert [language.buckets(t).tolist() for t in texts] == [_features(t) for t in texts]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([None, *texts] * 60)], "id int, text string").coalesce(1)
    found = docs.select("id", language.features(F.col("text")).alias("f"))
    assert [r.f for r in found.orderBy("id").collect()] == [_features(t) for t in [None, *texts] * 60]
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()
