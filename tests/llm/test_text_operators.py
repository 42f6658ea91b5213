from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import pytest

from sparkdigest.llm import html, pii, quality, queries, sharding, topk, toxicity
from tests.conftest import SMALL, same_rows
from tests.llm.conftest import odd_texts


# ---- quality ----------------------------------------------------------------------------------------------------


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    cover = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(words) < 50 or 100 * len(cover) > 50 * len(words)


def test_rules_and_verdicts(spark, odd, empty):
    trusted = spark.createDataFrame([(10,), (12,), (None,)], "doc_id long")
    rows = quality.judge(odd, trusted).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows), key=repr)
    assert got == sorted(((d, *brute_rules(t)) for d, t in odd_texts()), key=repr)
    assert all(r.kept is not None and r.score is not None and not (r.kept and r.base_failed) for r in rows)
    assert quality.judge(empty, trusted).count() == 0
    assert all(r.score == 0 for r in quality.judge(odd, trusted.limit(0)).collect())


def test_op9(spark):
    rows = {r.doc_id: r for r in queries.op9_quality_rules(spark, SMALL).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for d, r in rows.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(docs[d])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    good = [rows[d].kept for d, q in labels.items() if q == 1 and not rows[d].base_failed]
    bad = [rows[d].kept for d, q in labels.items() if q == 0 and not rows[d].base_failed]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_ngrams_are_counted_without_interpreted_functions_over_arrays_of_them(spark, odd):
    text = quality.F.coalesce("text", quality.F.lit(""))
    rows = quality._gram_rows(odd.select(quality.F.lit(1).alias("good"), text.alias("text")))
    want = odd.select(quality.F.explode(quality.grams(text)).alias("bucket"))
    assert rows.select("bucket").exceptAll(want).count() == 0 and rows.count() == want.count()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "xxhash64(2, x" in plan and "xxhash64(2, lambda" not in plan


# ---- personal data ----------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def holds(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "phone":
            return 9 <= len(digits) <= 15
        if kind == "card":
            double = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
            return 13 <= len(digits) <= 19 and sum(double) % 10 == 0
        return True

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


ODD = ["a@b.c@d.e f@g.h.i_j@k.l", "1.2.3.4.5 300.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112 5555 5555 5555 4444", "+1 (553) 555-5580 +12 34 +1 2 3 4 5 6 7 8 9 ", "😀 x@y.zz 💥 10.0.0.1", "", None, "@" * 5000 + "a" * 50_000, "a.b@" * 3000, "1 " * 20_000, "x@" + "a." * 20_000 + "b", "+1" + " " * 3000 + "2", "1.1.1.1@2.2.2.2", "9" * 50_000]


def test_spans(spark, odd, empty):
    found = pii.find(spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "doc_id long, text string")).collect()
    for r in found:
        assert [(s.kind, s.start, s.end) for k in pii.PATTERNS for s in r[k]] == brute_spans(ODD[r.doc_id])
    assert len(pii.find(odd).collect()) == len(odd_texts()) and pii.find(empty).count() == 0


def test_op5(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op5_pii(spark, SMALL).collect():
        spans = brute_spans(docs[r.doc_id])
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.spans.startswith(said)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in spans) for kind in BASE)


def test_terms_that_reveal_an_entity_go(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta theta lambda sigma omega kappa tau upsilon".split()
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows = [f"{say(5)} Zorblatt {say(3)} zor@x.example.com {say(3)}" if k % 30 == 0 else say(30) for k in range(300)]
    rows += [f"{say(4)} Quirkle {say(4)} q@x.example.com"] * 10  # copies of one line are one witness
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("Zorblatt" not in t and "@" not in t for t in out.values())
    assert all("[TERM]" in out[k] and "[EMAIL]" in out[k] for k in range(0, 300, 30))
    assert all("Quirkle" in out[k] for k in range(300, 310)) and all(out[k] == rows[k] for k in range(300) if k % 30)


def test_terms_of_entities_that_stand_in_one_document(spark):
    rng = random.Random(2)
    words = "alpha beta gamma delta epsilon zeta theta lambda sigma omega kappa tau upsilon".split()
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows = [f"{say(5)} Vex {say(3)}\n{say(3)} user{k}@quorn.example.org {say(3)}" if k % 30 == 0 else say(30) for k in range(300)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all(out[k] == re.sub(r"user\d+@\S+", "[EMAIL]", rows[k]).replace("Vex", "[TERM]") for k in range(300))


# ---- search -----------------------------------------------------------------------------------------------------


def test_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 128)
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(600)] + [(600 + k, [0.5] * 8) for k in range(90)]
    rows += [(900, None), (901, [float("nan")] * 8), (902, [None] * 8), (903, [float("inf")] * 8), (None, [1.0] * 8), (920, [1.0, 2.0]), (940, [])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, score string, v string")
    found = topk.search(df, topk.F.col("id") % 20 == 0)
    got = sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect()))
    import math

    v = {i: [math.floor(64 * x) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))[:20]
        want += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert got == sorted(want)
    assert topk.search(df.limit(0), topk.F.col("id") % 20 == 0).count() == 0


def test_op6_equals_sql(spark, duck):
    same_rows(queries.op6_exact_topk(spark, SMALL), duck, queries.SQL["op6_exact_topk"])


# ---- shards -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [100, 5_000, 10**9])
def test_shards_fit_and_only_full_ones_split(odd, empty, limit):
    rows = sharding.shards(odd, limit).collect()
    assert sorted((r.doc_id or -1, r.bytes) for r in rows) == sorted((d or -1, len((t or "").encode())) for d, t in odd_texts())
    held = collections.defaultdict(list)
    for r in rows:
        held[r.shard_id].append(r)
    for shard, own in held.items():
        total = sum(r.bytes for r in own)
        assert total == own[0].shard_bytes and (total <= limit or len(own) == 1)
        depth = own[0].depth
        assert shard == (1 << depth) + (own[0].hash >> (sharding.BITS - depth))
        if depth:  # the bucket above was too large
            above = [r for r in rows if r.hash >> (sharding.BITS - depth + 1) == own[0].hash >> (sharding.BITS - depth + 1)]
            assert sum(r.bytes for r in above) > limit
    assert sharding.shards(empty, limit).count() == 0


# ---- toxicity ---------------------------------------------------------------------------------------------------


def _labelled(n=240):
    rng = random.Random(2)
    plain = "the river of stone and light was in a green valley that is near to many small towns with trains".split()
    bad = ["grobnik", "plufter", "snarkwit"]
    rows = []
    for k in range(n):
        words = rng.choices(plain, k=40)
        if k % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(40), rng.choice(bad))
        rows.append((k, " ".join(words) + ".", int(k % 4 == 0)))
    return rows


def test_held_out_accuracy_and_obfuscation():
    rows = _labelled()
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    model = toxicity.fit([r[1] for r in train], [r[2] for r in train])
    scorer = toxicity.Scorer(model)
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    got = scorer.scores([r[1] for r in test])
    assert sum((g >= 0.5) == bool(r[2]) for g, r in zip(got, test, strict=True)) >= 0.97 * len(test)
    tricks = scorer.scores(["you g.r.o.b.n.i.k here", "you plu-fter there", "you s n a r k w i t now", "a gro*bnik"])
    assert (tricks >= 0.5).all()
    assert (scorer.scores(["the green valley", "", None]) < 0.5).all()


def test_score_of_odd_documents(spark, odd, empty):
    rows = _labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (999, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    one_class = toxicity.train(docs, labels.where("toxic = 1"))
    assert all(r.score < 0.5 for r in toxicity.score(odd, one_class).collect())
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows if not r[2]}


def test_op3(spark):
    rows = queries.op3_toxicity(spark, SMALL).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)


# ---- pages ------------------------------------------------------------------------------------------------------


def test_op4_equals_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    import html as entities

    for r in queries.op4_html_extraction(spark, SMALL).collect():
        found = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)
        parts = re.split(r"</?(?:p|h1)>", found[1] if found else "")
        texts = (" ".join(entities.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", p.replace("<br>", " "))).split()) for p in parts)
        assert r.text == "\n".join(t for t in texts if t) and r.n_chars == len(r.text)


LONG = "It was the best of times and it was the worst of times, and that is what the story of the city is about when you read it from the start to the end of the book."
MAIN = f'<div id="content"><h2>A title here</h2><p>{LONG}</p><p>Short one.</p><p>{LONG} Again.</p><p>End &amp; <b>b</b>old.</p></div>'


@pytest.mark.parametrize(
    "around",
    [
        "<header><h1>Site</h1><nav><a href=x>Home</a></nav></header>{}<footer>(c) the site</footer>",
        '<div class="cookie-notice">We use cookies to make this site better for all of you who come here to see it and read.</div>{}',
        "{}<aside><p>" + LONG + "</p></aside>",
        '{}<section id="comments"><p>' + LONG + "</p></section>",
        '<ul><li><a href="/a">One of the menu</a></li><li><a href="/b">Another of it</a></li></ul>{}<form>Your name <input></form>',
        '<script>var t = "</p><p>the of and";</script><style>p{{}}</style>{}<!-- <p>the comment of it</p> -->',
    ],
)
def test_what_stands_around_the_article_goes(around):
    want = f"A title here\n{LONG}\nShort one.\n{LONG} Again.\nEnd & bold."
    assert html.main_text(f"<html><body>{around.format(MAIN)}</body></html>") == want


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "<article><p>x &amp; y<p>z <b"), (4, "u", "<article><p>x &amp; y<p>z <b"), (5, "u", "a < b"), (6, "u", "<div>" * 3000 + "x"), (7, "u", "<" * 20_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.text) for r in html.extract(df).collect()), key=repr)
    assert [g for g in got if g[0] == 4] == [(4, "x & y\nz")] * 2 and len(got) == len(rows)
    assert html.extract(df.limit(0)).count() == 0


def test_lists_are_left_when_outsiders_cannot_qualify():
    """Skewed vectors stop early; random ones are read nearly to the end, but scores are resolved for few."""
    import numpy as np

    rng = np.random.default_rng(3)
    for skewed, most in ((True, 0.6), (False, 0.97)):
        c = rng.integers(-64, 65, (3000, 16))
        if skewed:
            c[:40] += 400
        q = np.abs(rng.integers(1, 65, (20, 16))) if skewed else rng.integers(-64, 65, (20, 16))
        ids = rng.permutation(3000)
        r, got, score, read = topk.block_topk(np.arange(5000, 5020), q, topk.Lists(ids, c), 20, np.full(20, -np.inf))
        for row in range(20):
            s = dict(zip(ids.tolist(), (c @ q[row]).tolist(), strict=True))
            want = sorted(s, key=lambda i: (-s[i], i))[:20]
            mine = [(int(i), int(x)) for k, i, x in zip(r, got, score, strict=True) if k == row]
            assert sorted(mine, key=lambda x: (-x[1], x[0])) == [(i, s[i]) for i in want]
        assert read < most, (skewed, read)
        # what other blocks have reached cuts the reading short
        floor = np.array([sorted((c @ q[row]).tolist())[-5] for row in range(20)], float)
        assert topk.block_topk(np.arange(5000, 5020), q, topk.Lists(ids, c), 20, floor)[3] <= read


def test_scores_are_log_likelihood_ratios(spark):
    """Against plain counts of the buckets that grams() gives, with the target's pseudo-counts."""
    import math
    from collections import Counter

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    trusted = docs.where("doc_id % 3 = 0").select("doc_id")
    grams = {r.doc_id: r.g for r in docs.select("doc_id", quality.grams(quality.F.col("text")).alias("g")).collect()}
    raw = Counter(g for gs in grams.values() for g in gs)
    target = Counter(g for d, gs in grams.items() if d % 3 == 0 for g in gs)
    every, good, prior = sum(raw.values()), sum(target.values()), quality.PRIOR * (1 << 16)
    ratio = {g: math.log((target[g] + prior * n / every) / (good + prior) / (n / every)) for g, n in raw.items()}
    for r in quality.judge(docs, trusted).collect():
        gs = grams[r.doc_id]
        assert math.isclose(r.score, sum(ratio[g] for g in gs) / max(1, len(gs)), abs_tol=1e-9)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)
