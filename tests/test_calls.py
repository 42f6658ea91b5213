"""Model calls with one repair, rewrites and score audits, with scripted models."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import functions as F

from sparkdigest.plans import calls

GOOD = {"title": "T", "category": "AI", "summary": "S", "why": "W", "importance": 5, "confidence": 0.9, "tags": ["x"]}


def _answer(**new):
    return json.dumps({"overview": "All is well.", "items": [GOOD | new]})


class Script:
    """The prompt is a JSON list of answers, one for each pass; a file is left for each call."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, prompts, before, wrong):
        out = []
        for p, b, w in zip(prompts, before, wrong, strict=True):
            assert (b is None) == (w is None)
            n = 1 if b is None else 2
            open(f"{self.folder}/{n}~{uuid.uuid4().hex}", "w").close()
            out.append(json.loads(p.rpartition("\n")[2])[n - 1])
        return out


def _calls(folder):
    names = os.listdir(folder)
    return sum(n.startswith("1") for n in names), sum(n.startswith("2") for n in names)


def test_only_answers_that_break_a_rule_go_round_again(spark, tmp_path):
    bad = [_answer(confidence=9), _answer(category="X"), "not json", "[]", json.dumps({"overview": "o"}), _answer(summary="see https://x.example/"), _answer(title="")]
    rows = [(k, json.dumps([b, _answer()])) for k, b in enumerate(bad)] + [(10, json.dumps([_answer()])), (11, json.dumps(["{", "{"])), (12, json.dumps([_answer(confidence=9), _answer(importance=11)])), (13, json.dumps([None])), (14, json.dumps(["{", None])), (15, None), (16, json.dumps([json.dumps({"overview": "", "items": []})])), (17, json.dumps([json.dumps({"overview": "", "items": [GOOD] * 10 + [{}]})]))]
    df = spark.createDataFrame(rows, "id int, prompt string").repartition(2)
    found = {r.id: (r.error, r.calls, None if r["items"] is None else len(r["items"])) for r in calls.extracted(df, "id", F.col("prompt"), Script(tmp_path)).collect()}
    assert found == {k: (None, 2, 1) for k in range(len(bad))} | {10: (None, 1, 1), 11: ("SCHEMA_INVALID", 2, None), 12: ("IMPORTANCE_RANGE", 2, None), 13: ("MODEL_CALL_FAILED", 1, None), 14: ("MODEL_CALL_FAILED", 2, None), 15: ("MODEL_CALL_FAILED", 0, None), 16: (None, 1, 0), 17: (None, 1, 10)}
    assert _calls(tmp_path) == (14, len(bad) + 3)


ENTRY = "entry_id int, review_score double, title string, summary string, why string, merged_summaries array<string>, other int"


def test_rewrites_are_kept_only_where_they_hold(spark, tmp_path):
    new = lambda covers=True, summary="new s": json.dumps({"summary": summary, "why": "new w", "covers": covers})
    script = lambda *answers: json.dumps(list(answers))
    texts = {1: script(new()), 2: script(new(False)), 3: script("{", "{"), 4: script("{", new()), 5: script(new(summary="fremd")), 6: "", 7: script(new()), 9: script(new(summary="[a](http://b.c)"), new())}
    entries = spark.createDataFrame([(k, None if k == 7 else 90.0, f"t{k}", "old s", "" if k == 8 else "old w", [script(new())] if k == 8 else [], k) for k in range(1, 11)], ENTRY)
    articles = spark.createDataFrame([*texts.items(), (1, ""), (99, "x")], "entry_id int, text string")
    detected = lambda df: df.withColumn("detected", F.when(F.contains("text", F.lit("fremd")), "de").otherwise("en")).withColumn("margin", F.lit(1.0))

    class Last(Script):
        def __call__(self, prompts, *rest):
            return super().__call__([p.strip() for p in prompts], *rest)

    df = calls.deepened(entries, articles, Last(tmp_path), detected, "en")
    assert df.columns == [*entries.columns, "basis", "rewrite_error"]
    found = {r.entry_id: (r.summary, r.why, r.basis, r.rewrite_error) for r in df.collect()}
    fresh, old = ("new s", "new w"), ("old s", "old w")
    assert found == {
        1: (*fresh, "article", None),
        2: (*old, "article", "NOT_COVERED"),
        3: (*old, "article", "SCHEMA_INVALID"),
        4: (*fresh, "article", None),
        5: (*old, "article", "WRONG_LANGUAGE"),
        6: (*old, None, "NO_SOURCE"),
        7: (*old, None, None),
        8: (*fresh, "newsletters", None),
        9: (*fresh, "article", None),
        10: (*old, None, "NO_SOURCE"),
    }
    assert _calls(tmp_path) == (7, 3)


def test_scores_are_audited_once_and_only_finite_ones(spark):
    scored = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, float("nan")), (3, float("inf")), (4, None), (5, 0.1), (1, float("nan"))], "item_id int, score double")
    live = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "item_id int")
    assert [tuple(r) for r in calls.score_audit(scored, live, "m", "v1").collect()] == [(1, 0.7, "m", "v1")]


def test_published_digests(spark, tmp_path):
    """Two digests: rewrites hold or are left, an entry whose rewrite gives it another's title is folded, scores are kept."""
    from sparkdigest.plans import digest
    from tests.test_operators import NAMES

    base = {"source_name": "p", "discussion_url": None, "hn_item_id": None, "review_score": None, "reranker_score": None, "importance": 1.0, "confidence": 1.0, "hn_score": None, "hn_comments": None, "published": 1.0, "also_from": [], "merged_summaries": []}
    entry = lambda d, seq, title, url=None: base | {"digest_id": d, "seq": seq, "title": title, "summary": f"old {title}", "article_url": url, "category": "AI", "why": "old why"}
    rows = [entry(d, seq, title, url) for d in (1, 2) for seq, title, url in ((1, "Ada one", None), (2, "Bert two", "https://a.example/2"), (3, "Carl three", None), (4, "Ada one", None))]
    df = spark.createDataFrame(rows, f"digest_id long, {NAMES}, category string, why string")
    articles = spark.createDataFrame([(1, 1, "Ada said much"), (1, 2, "nothing of him"), (2, 3, "Carl was there"), (2, 9, "x")], "digest_id long, seq long, text string")
    live = spark.createDataFrame([("1:1",), ("1:2",), ("2:3",), ("7:7",)], "item_id string")
    out = digest.published(df, articles, calls.first_line_model, live, ("m", "v"), rerank=lambda t, s: F.length(t).cast("double"), top=3)
    found = {(r.digest_id, r.seq): (r.summary, r.why, r.basis, r.rewrite_error) for r in out.entries.collect()}
    assert found == {
        (1, 1): ("Ada said much", "it is there", "article", None),
        (1, 2): ("old Bert two", "old why", "article", "NOT_COVERED"),
        (1, 3): ("old Carl three", "old why", None, "NO_SOURCE"),
        (2, 1): ("old Ada one old why", "it is there", "newsletters", None),
        (2, 2): ("old Bert two", "old why", None, "NO_SOURCE"),
        (2, 3): ("Carl was there", "it is there", "article", None),
    }
    assert sorted((r.digest_id, r["rank"]) for r in out.entries.collect()) == [(d, k) for d in (1, 2) for k in (1, 2, 3)]
    assert sorted(map(tuple, out.scores.collect())) == [("1:1", 7.0, "m", "v"), ("1:2", 8.0, "m", "v"), ("2:3", 10.0, "m", "v")]
