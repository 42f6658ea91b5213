from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkdigest.operators import checks, entries, matching, records, schedule, selection, state, store, subscriptions
from sparkdigest.plans import reminders
from sparkdigest.sources import paged, schemas, tables
from sparkdigest.streaming import reminders as stream

RULES = [(0, "default", None, None, None, None, None, [(None, "30m"), (None, "5m")]), (1, "r", None, None, None, ["Flight"], None, [(None, "2h"), (None, "30m")])]
AT = dt.datetime(2024, 5, 1, 12, 0)


def event(title="flight", start=AT, **more):
    return {"calendar_id": "c", "event_id": 1, "instance_id": 1, "title": title, "location": "", "start": start, "all_day": False} | more


EVENT = "calendar_id string, event_id long, instance_id long, title string, location string, start timestamp, all_day boolean"


def test_schedule_overrides_defaults(spark):
    found = schedule.in_time_order(schedule.schedule(spark.createDataFrame([event()], EVENT), spark.createDataFrame(RULES, schedule.RULES)))
    assert [r.rule_id for r in found.collect()] == ["r:2h", "r:30m", "default:5m"]
    assert schedule.schedule(spark.createDataFrame([event(location=None, title=None)], EVENT), spark.createDataFrame(RULES, schedule.RULES)).count() == 2


@pytest.mark.parametrize(("reserved", "general", "want"), [(9, 30, (7, 13)), (2, 30, (2, 18)), (30, 5, (15, 5)), (0, 3, (0, 3))])
def test_quota(spark, reserved, general, want):
    rows = [(1, k, False) for k in range(general)] + [(1, general + k, True) for k in range(reserved)]
    kept = selection.quota_top_k(spark.createDataFrame(rows, "g int, rank int, res boolean"), F.col("res"), 20, 7, ["g"]).collect()
    assert (sum(r.res for r in kept), sum(not r.res for r in kept)) == want


def test_budget_drops_from_the_tail_and_reserved_last(spark):
    rows = [(1, k, 10, k >= 4) for k in range(6)]
    df = spark.createDataFrame(rows, "g int, rank int, cost int, res boolean")
    fit = lambda budget: sorted(r.rank for r in selection.budget_fit(df, F.col("cost"), F.lit(budget), ["g"], reserved=F.col("res"), protect=1).collect())
    assert fit(60) == [0, 1, 2, 3, 4, 5] and fit(35) == [0, 1, 4] and fit(10) == [4] and fit(9) == []


NAMES = "seq long, title string, summary string, source_name string, article_url string, discussion_url string, hn_item_id string, review_score double, reranker_score double, importance double, confidence double, hn_score double, hn_comments double, published double, also_from array<string>, merged_summaries array<string>"


def _fold(rows):
    """The fold in plain Python: what arrives later takes over only with a higher rank; the winner absorbs the other."""
    link = lambda r: r["article_url"] if r["article_url"] and r["article_url"] != r["discussion_url"] else None
    rank = lambda r: tuple(-1.0 if r[k] is None else r[k] for k in list(entries.RANK)[:-1])

    def absorb(w, o):
        out = dict(w)
        for n in [o["source_name"], *o["also_from"]]:
            if n and n != w["source_name"] and n not in out["also_from"]:
                out["also_from"] = [*out["also_from"], n]
        told = list(w["merged_summaries"]) or [w["summary"]]
        out["merged_summaries"] = told + [s for k, s in enumerate([o["summary"], *o["merged_summaries"]]) if s not in told and s not in [o["summary"], *o["merged_summaries"]][:k]]
        if not w["discussion_url"] and o["discussion_url"]:
            out |= {k: o[k] for k in ("discussion_url", "hn_score", "hn_comments", "hn_item_id")}
        out["article_url"] = link(w) or link(o) or w["article_url"]
        return out

    best = {}
    for r in rows:
        key = r["article_url"] or r["title"].lower()
        b = best.get(key)
        best[key] = r if b is None else absorb(r, b) if rank(r) > rank(b) else absorb(b, r)
    return list(best.values())


def test_fold_equals_plain_python(spark):
    rng, rows = random.Random(7), []
    for k in range(120):
        url = rng.choice([None, "https://a.example/1", "https://a.example/2"])
        talk = rng.choice([None, None, "https://a.example/1", "https://t.example/9"])
        rows.append({"seq": k, "title": rng.choice("abc"), "summary": rng.choice("stuvw"), "source_name": rng.choice(["p", "q", "r", None, ""]), "article_url": url, "discussion_url": talk, "hn_item_id": None, "review_score": None, "reranker_score": None, "importance": float(rng.randint(1, 3)), "confidence": float(rng.randint(0, 2)), "hn_score": rng.choice([None, 1.0]) if talk else None, "hn_comments": None, "published": None, "also_from": [], "merged_summaries": []})
    got = entries.fold_entries(spark.createDataFrame(rows, NAMES)).orderBy("pos").collect()
    want = _fold(rows)
    cols = ["seq", "also_from", "merged_summaries", "article_url", "discussion_url", "hn_score"]
    assert [[r[c] for c in cols] for r in got] == [[w[c] for c in cols] for w in want]


def test_a_borrowed_score_counts_only_if_asked(spark):
    row = lambda seq, talk, score: {"seq": seq, "title": "a", "summary": "s", "source_name": "p", "article_url": None, "discussion_url": talk, "hn_item_id": None, "review_score": None, "reranker_score": None, "importance": 0.0 if seq == 1 else 1.0, "confidence": 0.0, "hn_score": score, "hn_comments": None, "published": None, "also_from": [], "merged_summaries": []}
    df = spark.createDataFrame([row(0, None, None), row(1, "https://t.example/1", 4.0), row(2, "https://t.example/2", 3.0)], NAMES)
    assert [(r.seq, r.hn_score) for r in entries.fold_entries(df).collect()] == [(0, 4.0)]
    assert [(r.seq, r.hn_score) for r in entries.fold_entries(df, lent_counts=False).collect()] == [(2, 3.0)]
    assert "rank__" not in entries.fold_entries(df, lent_counts=False).columns


LINKS = "document_id int, candidate_id string, raw_url string, anchor_text string, nearby_text string, position int, kind string"


def test_links_are_used_once_and_ties_not_at_all(spark):
    items = spark.createDataFrame([(1, 0, "Big news"), (1, 1, "Other thing here"), (2, 0, "Same"), (3, 0, "None")], "document_id int, item_seq int, source_title string")
    links = spark.createDataFrame(
        [(1, "link-0001", "https://a.example/", "Big news", "", 0, "article"), (1, "link-0002", "https://a.example/other-thing-here", "x", "", 1, "article"), (2, "link-0001", "https://a.example/1", "Same", "", 0, "article"), (2, "link-0002", "https://a.example/2", "same", "", 1, "article"), (3, "link-0001", "https://a.example/none", "None", "", 0, "non_article")],
        LINKS,
    )
    got = {(r.document_id, r.item_seq): (r.method, r.candidate_id) for r in matching.assign_links(items, links).collect()}
    assert got == {(1, 0): ("exact_anchor", "link-0001"), (1, 1): ("url_slug", "link-0002"), (2, 0): ("ambiguous", None), (3, 0): ("unmatched", None)}


def test_merge_goes_to_the_first_headline_then_leaders(spark):
    rows = [(1, 0, 90.0, "Alpha Red", ""), (1, 1, 80.0, "Alpha Blue", ""), (1, 2, None, "Alpha Green", ""), (1, 3, None, "Beta Pink", ""), (1, 4, None, "Beta Grey", ""), (1, 5, None, "lower case", "")]
    df = spark.createDataFrame(rows, "digest_id int, seq int, review_score double, title string, summary string")
    got = {r.seq: (r.leader_seq, r.phase) for r in matching.merge_related(df, lambda a, b: True).collect()}
    assert got == {0: (0, "headline"), 1: (1, "headline"), 2: (0, "absorbed"), 3: (3, "mention"), 4: (3, "absorbed"), 5: (5, "mention")}

    def broken(a, b):
        raise ValueError

    assert all(r.seq == r.leader_seq for r in matching.merge_related(df, broken).collect())


def test_reconcile_moves_an_event(spark):
    rules = spark.createDataFrame(RULES[:1], schedule.RULES)
    stored = schedule.schedule(spark.createDataFrame([event("x")], EVENT), rules).withColumn("content", F.concat_ws("|", "start", "before")).withColumn("state", F.lit("pending"))
    moved = spark.createDataFrame([event("x", start=AT + dt.timedelta(minutes=15))], EVENT)
    out = reminders.sync(stored, moved, rules, F.lit("2024-05-01 00:00:00").cast("timestamp"), 86400)
    assert sorted(r["change"] for r in out.collect()) == ["cancelled", "cancelled", "created", "created"]
    same = reminders.sync(stored, spark.createDataFrame([event("x")], EVENT), rules, F.lit("2024-05-01 00:00:00").cast("timestamp"), 86400)
    assert {r["change"] for r in same.collect()} == {"kept"}


def test_dispatch_expires_begun_events(spark):
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    attempts = spark.createDataFrame([(1, "pending", AT - dt.timedelta(minutes=5), AT + dt.timedelta(minutes=5)), (2, "pending", AT - dt.timedelta(hours=1), AT - dt.timedelta(minutes=1)), (3, "delivered", AT, AT)], "attempt_id int, state string, reminder_at timestamp, start timestamp")
    deliveries = spark.createDataFrame([(1, "d", "pending", None), (2, "d", "pending", None)], "attempt_id int, destination_key string, state string, retired_at timestamp")
    sent = spark.createDataFrame([(1, "d", "delivered")], "attempt_id int, destination_key string, state string")
    got = {r.attempt_id: r.state for r in reminders.dispatch(attempts, deliveries, now, sent).collect()}
    assert got == {1: "delivered", 2: "expired", 3: "delivered"}


def test_agenda(spark):
    rows = [event("a@b", start=dt.datetime(2024, 4, 30, 22), end=dt.datetime(2024, 5, 1, 1)), event("late", start=dt.datetime(2024, 5, 2), end=dt.datetime(2024, 5, 3), instance_id=2), event("day", all_day=True, start=dt.datetime(2024, 5, 1), end=dt.datetime(2024, 5, 2), instance_id=3, location="Hall")]
    df = spark.createDataFrame(rows, EVENT + ", end timestamp").withColumn("calendar_name", F.lit(None).cast("string"))
    assert [r.line for r in reminders.agenda(df, "2024-05-01").collect()] == ["Yesterday-01:00 | a@​b", "All day     | day", "            | Hall"]


def test_state_of_unknown_values(spark):
    scores = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, float("inf")), (9, 0.5), (4, None)], "item_id int, score double")
    live = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item_id int")
    assert [r.item_id for r in state.append_scores(scores, live).collect()] == [1]
    d = spark.createDataFrame([("good-id",), ("Bad",), ("list",)], "v string").select(checks.id_error(F.col("v")).alias("e"))
    assert [r.e for r in d.collect()] == [None, "ID_FORMAT", "ID_RESERVED"]


def test_subscription_ids_avoid_taken_ones(spark):
    df = spark.createDataFrame([("m", "a", "News", None), ("m", "b", "News", None), ("m", "c", "news", "kept")], "mailbox string, key string, basis string, source_id string")
    got = {r.key: r.source_id for r in subscriptions.suffixed_ids(df, ["news"]).collect()}
    assert got == {"a": "news-2", "b": "news-3", "c": "kept"}


def test_change_log(spark, tmp_path):
    log = tables.ChangeLog(spark, str(tmp_path / "t"), "k int, v string", ["k"])
    assert log.rows().count() == 0
    log.append(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    staged = log.stage(spark.createDataFrame([(1, "x")], "k int, v string"))
    assert sorted(map(tuple, log.rows().collect())) == [(1, "a"), (2, "b")]
    tables.commit_all([(log, staged)])
    log.compact()
    log.append(spark.createDataFrame([(3, "c")], "k int, v string"))
    assert sorted(map(tuple, log.rows().collect())) == [(1, "x"), (2, "b"), (3, "c")]


def test_paged_source(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.json").write_text('{"items": [{"id": %d, "label": "a"}, {"id": %d, "label": "b"}]}' % (2 * k, 2 * k + 1))
    paged.register(spark)
    df = spark.read.format("paged").schema("id int, label string").option("path", str(tmp_path)).load()
    assert sorted(r.id for r in df.where("label = 'a'").collect()) == [0, 2, 4]
    assert df.rdd.getNumPartitions() == 3
    assert spark.read.format("paged").schema("id int").option("path", str(tmp_path)).option("pages", "1").load().count() == 2


def test_calendar_rows(spark):
    raw = [("c", None, "i1", "s1", "", None, (None, "2024-05-01"), (None, "2024-05-02"), "https://l.example/1", None, "see https://d.example/2.", ["https://l.example/1"]), ("c", None, "i2", None, "x", "y", None, None, None, None, None, None)]
    got = schemas.events(spark.createDataFrame(raw, schemas.EVENT), "UTC").collect()
    assert [(r.event_id, r.title, r.all_day, r.links) for r in got] == [("s1", "(untitled)", True, ["https://l.example/1", "https://d.example/2"])]


def test_stream_equals_batch(spark, tmp_path):
    now = AT
    rows = [("c", k, "r", now - dt.timedelta(minutes=10 * k - 30), now - dt.timedelta(minutes=20 * k - 100), dt.datetime(2024, 5, 1, 6)) for k in range(12)]
    kind = "calendar_id string, instance_id long, rule_id string, reminder_at timestamp, start timestamp, now timestamp"
    df = spark.createDataFrame(rows, kind)
    spark.createDataFrame([*rows, ("tick", 0, "t", now + dt.timedelta(days=400), now, now)], kind).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    # a second file, so that a batch follows the watermark's rise
    spark.createDataFrame([("tick", 1, "t", now + dt.timedelta(days=400), now, now)], kind).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = []
    query = stream.deliver(stream.due_stream(source), lambda batch, k: got.extend(map(tuple, batch.select("instance_id", "action").collect())), str(tmp_path / "check"), every=None)
    query.awaitTermination(120)
    want = stream.dispatch_batch(df, F.lit(str(now)).cast("timestamp")).select("instance_id", "action").collect()
    assert sorted(got) == sorted(map(tuple, want))


def test_undelivered(spark):
    parts = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "delivery_id int, chunk_no int")
    done = spark.createDataFrame([(1, 1), (1, 2)], "delivery_id int, chunk_no int")
    assert sorted(map(tuple, stream.undelivered(parts, done).collect())) == [(1, 3), (2, 1)]


def test_configuration_as_tables(spark):
    rules = records.rules_table(spark, {"default_rules": [{"before": "30m"}, {"before": "5m"}], "rules": [{"id": "r", "match": {"title_contains": ["flight"]}, "reminders": [{"before": "2h"}, {"id": "x", "before": "30m"}]}]})
    found = schedule.in_time_order(schedule.schedule(spark.createDataFrame([event()], EVENT), rules))
    assert [r.rule_id for r in found.collect()] == ["r:2h", "x", "default:5m"]
    config = {"sources": [{"id": "a", "type": "gmail", "gmail_query": "q"}, {"id": "b", "type": "hackernews", "enabled": False}]}
    assert [(r.source_id, r.options) for r in records.sources_table(spark, config).collect()] == [("a", {"gmail_query": "q"})]
    with pytest.raises(ValueError, match="'b'"):
        records.sources_table(spark, config, "b")


def test_fetching_says_what_failed(spark):
    def get(url):
        if "bad" in url:
            raise TimeoutError
        return 200, "text/html", b"x" * (20 if "big" in url else 5)

    got = {r.url: (r.status, r.error) for r in records.fetched(spark.createDataFrame([("ok",), ("bad",), ("big",)], "url string"), get, 10).collect()}
    assert got == {"ok": (200, None), "bad": (None, "FETCH_FAILED:TimeoutError"), "big": (200, "ARTICLE_TOO_LARGE")}


def test_shrinking(spark):
    rows = spark.createDataFrame([("x" * 1000, 30), ("short", 30), ("x", 0), (None, 3), ("漢" * 100, 8)], "t string, b int")
    got = [r[0] for r in rows.select(records.shrunk_to_budget("t", "b")).collect()]
    assert got[0] == "x" * 100 and got[1:4] == ["short", "", None] and got[4] == "漢" * 10


def test_a_run_outlives_a_compaction(spark, tmp_path):
    log = tables.ChangeLog(spark, str(tmp_path / "t"), "k int, v string", ["k"])
    log.append(spark.createDataFrame([(1, "a")], "k int, v string"))
    run = log.stage(spark.createDataFrame([(2, "b")], "k int, v string"))
    log.compact()
    log.commit(run)
    assert sorted(map(tuple, log.rows().collect())) == [(1, "a"), (2, "b")]


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    both = [tables.ChangeLog(spark, str(tmp_path / n), "k int, v string", ["k"], manifest=str(tmp_path / "manifest")) for n in ("a", "b")]
    row = spark.createDataFrame([(1, "x")], "k int, v string")
    staged = [(log, log.stage(row)) for log in both]
    assert [log.rows().count() for log in both] == [0, 0]  # a crash here leaves nothing
    tables.commit_all(staged)
    assert [log.rows().count() for log in both] == [1, 1]
    # a number is given once
    first = both[0].stage(spark.createDataFrame([(1, "p")], "k int, v string"))
    assert not both[0].commits.publish(1, [("a", *first)]) and both[0].rows().first().v == "x"
    with pytest.raises(ValueError, match="share a manifest"):
        tables.commit_all([(both[0], first), (tables.ChangeLog(spark, str(tmp_path / "c"), "k int", ["k"]), first)])


def test_mail_selectors(spark):
    sources = spark.createDataFrame([("s", "gmail", "label:a"), ("h", "hackernews", None)], "id string, type string, gmail_query string")
    subscriptions = sources.where("id = 's'")
    assert store.mail_query(sources, subscriptions) == "" and store.mail_query(sources, subscriptions, query="x") == "x"
    assert store.mail_query(sources, subscriptions, source="s") == store.mail_query(sources, subscriptions, subscription="s") == "label:a"
    for bad, said in (({"source": "h"}, "doesn't read mail"), ({"source": "z"}, "there are: h, s$"), ({"query": "x", "source": "s"}, "not several")):
        with pytest.raises(ValueError, match=said):
            store.mail_query(sources, subscriptions, **bad)


def test_schema_without_lengths():
    assert store.without_max_length({"a": [{"maxLength": 3, "type": "string"}], "maxLength": 1}) == {"a": [{"type": "string"}]}


def test_pairs_of_a_frequent_token_stay_in_proportion(spark):
    rows = spark.createDataFrame([(k, "s", "Postgres news") for k in range(200)], "doc_id int, source string, text string")
    assert matching.nearest_pairs(rows, "doc_id", ["source"], 5).count() == sum(min(5, 199 - k) for k in range(200))


def test_selectors_know_every_id(spark):
    many = spark.range(10_050).select(F.col("id").cast("string").alias("id"), F.lit("gmail").alias("type"), F.concat(F.lit("q"), "id").alias("gmail_query"))
    assert store.mail_query(many, many, source="10049") == "q10049"
    with pytest.raises(ValueError, match=r"there are: 0, 1, 10, .* \.\.\.$"):
        store.mail_query(many, many, subscription="x")


def test_one_outcome_counts_for_a_document(spark):
    docs = spark.createDataFrame([(k, "failed", 1, "X", None, None, None) for k in (1, 2, 3)], "document_id int, state string, attempt_count int, last_error_code string, content_basis string, content_sha256 string, content_characters int")
    state = spark.createDataFrame([(k, None, "new") for k in (1, 2, 3)], "document_id int, final_url string, fetch_status string")
    outcomes = spark.createDataFrame([(1, None, None, None, "E"), (1, "a", "article", "u", None), (2, None, None, None, "E"), (2, None, None, None, "F"), (9, "z", "article", "u", None), (None, "z", None, None, None)], "document_id int, text string, basis string, final_url string, error string")
    d, s = store.resolve(docs, state, outcomes, F.current_timestamp())
    assert sorted((r.document_id, r.state, r.attempt_count, r.last_error_code, r.content_characters) for r in d.collect()) == [(1, "discovered", 1, None, 1), (2, "failed", 2, "F", None), (3, "failed", 1, "X", None)]
    assert sorted(map(tuple, s.collect())) == [(1, "u", "fetched"), (2, None, "F"), (3, None, "new")]


def test_flags_of_synced_attempts_must_be_free(spark):
    stored = spark.createDataFrame([(1, "a", "pending", 0, True)], "k int, content string, state string, progress int, reset boolean")
    wanted = spark.createDataFrame([(1, "b"), (1, "c")], "k int, content string")
    none = spark.createDataFrame([], "k int, destination string")
    with pytest.raises(ValueError, match="other flags"):
        store.attempts_after(stored, wanted, none, ["k"], ["content"])
    found = store.attempts_after(stored, wanted, none, ["k"], ["content"], flags=("again", "new"))
    assert [tuple(r) for r in found.attempts.collect()] == [(1, "c", "pending", 0, True, True, False)]
