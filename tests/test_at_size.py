"""What must hold so that queries grow with their tables: nothing large goes to every task or stays in one."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from sparkdigest import queries
from sparkdigest.functions import markup
from sparkdigest.llm import spelling, topk
from sparkdigest.operators import entries, matching
from tests.test_operators import NAMES, _fold


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_of_queries_are_not_broadcast(spark):
    vectors = spark.range(400).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 7).cast("float"), F.col("id").cast("float")).alias("embedding"))
    found = topk.search(vectors, F.col("id") % 20 == 0, k=3)
    assert "SortMergeJoin" in _plan(found) and "Broadcast" not in _plan(found)
    assert [tuple(r) for r in found.where("query_id = 380").orderBy("rank").select("rank", "vec_id").collect()] == [(1, 399), (2, 398), (3, 397)]


def test_lists_of_words_are_not_broadcast(spark):
    words = spark.createDataFrame([("lantern", 9), ("lanterm", 3), ("lanten", 4), ("copper", 5)], "word string, n long")
    forms = spelling._forms(words)
    for df in (forms, spelling._with_roots(forms)):
        assert "SortMergeJoin" in _plan(df) and "Broadcast" not in _plan(df)
    assert sorted((r.word, r.form) for r in forms.collect()) == [("copper", None), ("lanten", "lantern"), ("lanterm", "lantern"), ("lantern", None)]


def test_a_token_of_many_rows_gives_few_pairs(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("Alpha T"), (F.col("id") % 40).cast("string")).alias("text"))
    found = matching.first_pairs(rows, "doc_id", ["source"], 6)
    every = sorted((a, b) for a in range(300) for b in range(a + 1, 300))
    got = sorted((r.left_id, r.right_id) for r in found.collect())
    assert got[:6] == every[:6] and len(got) <= 41 * 12
    assert "WindowGroupLimit" in _plan(found)


def test_first_pairs_of_rare_tokens(spark):
    rng = random.Random(3)
    texts = [" ".join(f"N{rng.randint(0, 9)}" for _ in range(rng.randint(0, 3))) for _ in range(60)]
    df = spark.createDataFrame([(k, "a", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")
    every = [(a, b) for a in range(60) for b in range(a + 1, 60) if set(texts[a].split()) & set(texts[b].split())]
    for most in (1, 7, 40):
        got = sorted((r.left_id, r.right_id) for r in matching.first_pairs(df, "doc_id", ["source"], most).collect())
        assert got[:most] == every[:most] and set(got) <= set(every)


def test_pages_are_worked_on_in_small_stretches():
    pages = pd.Series([f'<title>t{k}</title><a href="https://a.example/{k}">x</a>' for k in range(150)])
    links = list(markup.extract_links.func(iter([(pd.Series([""] * 150), pages)])))
    texts = list(markup.extract_article.func(iter([pages])))
    assert max(map(len, links)) <= 64 and max(map(len, texts)) <= 64
    assert [x[0]["raw_url"] for b in links for x in b["links"]] == [f"https://a.example/{k}" for k in range(150)]
    assert [t for b in texts for t in b["title"]] == [f"t{k}" for k in range(150)]


def test_links_are_chosen_in_batches_of_documents_and_pages_parsed_once(spark):
    items = spark.createDataFrame([(d, k, "Alpha Beta") for d in range(150) for k in range(3)] + [(150, None, "x")], "document_id int, item_seq int, source_title string")
    rows = [(d, f"link-{k:04d}", f"https://a.example/{k}", a, "", k, "article") for d in range(150) for k, a in enumerate(["Alpha Beta", "Alpha Beta Gamma Delta"])]
    found = matching.assign_links(items, spark.createDataFrame(rows, "document_id int, candidate_id string, raw_url string, anchor_text string, nearby_text string, position int, kind string"))
    assert "InPandas" not in _plan(found)
    got = sorted(map(tuple, found.collect()), key=repr)
    want = [(d, k, "exact_anchor" if k == 0 else "unmatched", 1.0 if k == 0 else 0.0, "link-0000" if k == 0 else None) for d in range(150) for k in range(3)]
    assert got == sorted([*want, (150, None, "unmatched", 0.0, None)], key=repr)
    plan = _plan(queries.queries()["link_assignment"](spark, "/root/testdata/sf0.001"))
    assert "extract_links" not in plan


def _stories(n, rising):
    """Entries of one title and of one link, whose ranks rise with seq or not."""
    rng = random.Random(11)
    rank = lambda k: float(k if rising else rng.randint(0, 400))
    talk = lambda k: None if k % 5 else f"https://t.example/{k}"
    blank = dict.fromkeys(["hn_item_id", "review_score", "reranker_score", "hn_comments", "published"])
    own = lambda k: {"also_from": [f"s{k % 13}", "x"] if k % 17 == 0 else [], "merged_summaries": [f"m{k % 19}"] if k % 23 == 0 else []}
    rows = [{"seq": k, "title": "a", "summary": f"text {rng.randint(0, n)}", "source_name": rng.choice(["p", "q", "r", None, ""]), "article_url": "https://a.example/" if k % 4 == 0 else None, "discussion_url": talk(k), "importance": rank(k), "confidence": 0.0, "hn_score": 1.0 if talk(k) else None} | blank | own(k) for k in range(n)]
    return [{c: r[c] for c in (x.split()[0] for x in NAMES.split(", "))} for r in rows]


def test_a_fold_of_many_rows_is_as_one_by_one(spark):
    cols = ["seq", "also_from", "merged_summaries", "article_url", "discussion_url", "hn_score"]
    for rising in (True, False):
        rows = _stories(1100, rising)
        for counts in (True, False):
            got = entries.fold_entries(spark.createDataFrame(rows, NAMES), lent_counts=counts).orderBy("pos").collect()
            assert [[r[c] for c in cols] for r in got] == [[w[c] for c in cols] for w in _fold(rows)]


def test_a_step_of_a_fold_does_not_look_at_texts_met_before(spark):
    folded = entries.fold_entries(spark.createDataFrame(_stories(8, True), NAMES), lent_counts=False)
    fold = next(x for x in folded._jdf.queryExecution().analyzed().toString().splitlines() if "aggregate(" in x)
    assert "array_distinct" not in fold and "merged_summaries" not in fold and "regexp" not in fold


def test_all_links_of_a_page_are_kept(spark, tmp_path):
    many = "<ul>" + "".join(f'<li><a href="/story-{k}">Story number {k}</a></li>' for k in range(450)) + "</ul>"
    pages = [(1, "https://example.com/", many), (2, "https://example.com/", '<a href="/x">Some story</a>')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.queries()["link_candidates"](spark, str(tmp_path)).orderBy("document_id", "position").collect()
    assert [r.raw_url for r in found] == [f"https://example.com/story-{k}" for k in range(450)] + ["https://example.com/x"]
    assert [r.candidate_id for r in found] == [f"link-{k + 1:04d}" for k in range(450)] + ["link-0001"]
    chosen = queries.queries()["link_assignment"](spark, str(tmp_path)).collect()
    assert len(chosen) == 451 and {r.method for r in chosen} == {"exact_anchor"}


def test_links_go_back_before_many_are_held():
    page = "".join(f'<div><a href="https://a.example/{k}">x</a></div>' for k in range(3000))
    given = list(markup.extract_links.func(iter([(pd.Series([""] * 5), pd.Series([page] * 5))])))
    assert [len(b) for b in given] == [2, 2, 1] and {len(x) for b in given for x in b["links"]} == {3000}


def test_links_are_chosen_as_by_scores_of_all_pairs(spark):
    rng = random.Random(5)
    text = lambda n: rng.choice([None, "", *[" ".join(rng.choice(["Red", "blue", "green", "Fox", "cat"]) for _ in range(rng.randint(1, n))) for _ in range(6)]])
    items = [(d, k, text(4)) for d in range(30) for k in range(8)]
    links = [(d, f"link-{k:04d}", f"https://a.example/{(text(4) or '').replace(' ', '-')}", text(4), text(9), k, rng.choice(["article", "unknown", "non_article"])) for d in range(29) for k in range(9)]
    items_df = spark.createDataFrame(items, "document_id int, item_seq int, source_title string")
    links_df = spark.createDataFrame(links, "document_id int, candidate_id string, raw_url string, anchor_text string, nearby_text string, position int, kind string")
    m = matching.match_score(F.col("source_title"), F.col("anchor_text"), F.col("nearby_text"), F.col("raw_url"))
    pairs = {}
    for r in items_df.join(links_df.where("kind <> 'non_article'"), "document_id").select("document_id", "item_seq", "candidate_id", "position", m.alias("m")).where("m.score > 0").collect():
        pairs.setdefault((r.document_id, r.item_seq), []).append((-r.m.score, r.position, r.candidate_id, r.m.method))
    want, used = [], set()
    for d, k, _ in items:
        free = sorted(x for x in pairs.get((d, k), []) if (d, x[2]) not in used)
        if not free:
            want.append((d, k, "unmatched", 0.0, None))
        elif len(free) > 1 and round(free[1][0] - free[0][0], 6) < matching.LEAD:
            want.append((d, k, "ambiguous", -free[0][0], None))
        else:
            used.add((d, free[0][2]))
            want.append((d, k, free[0][3], -free[0][0], free[0][2]))
    assert sorted(map(tuple, matching.assign_links(items_df, links_df).collect())) == want
    assert {w[2] for w in want} == {"unmatched", "ambiguous", "exact_anchor", "heading_context", "fuzzy_anchor", "url_slug"}
