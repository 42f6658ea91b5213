"""Kernel, disclosing terms and shards against plain versions of what they are defined as."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkdigest.llm import pii, queries, sharding, toxicity
from tests.conftest import SMALL
from tests.llm.test_text_operators import brute_spans

# ---- toxicity ---------------------------------------------------------------------------------------------------


def _subsequences(word):
    """Weight of each subsequence of ORDER letters within SPAN, by looking at all triples of places."""
    codes = [x for x in map(toxicity._code, word) if x]
    out = Counter()
    for i, j, k in itertools.combinations(range(len(codes)), 3):
        if k - i < toxicity.SPAN:
            out[codes[i], codes[j], codes[k]] += toxicity.DECAY ** (k - i - 2)
    return out


def _kernel(a, b):
    a, b = _subsequences(a), _subsequences(b)
    dot = lambda x, y: sum(v * y[u] for u, v in x.items())
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) if a and b else 0.0


def test_the_kernel_equals_all_gapped_triples():
    words = ["idiot", "idxiot", "i.d-i o!t", "idi0t", "aaaaaa", "abcabc", "straße", "abc", "ab", "", "xyzzyx", "thunderstorm", "тест"]
    feats, weights, norms, of = toxicity.kernel_map(words)
    assert list(of) == list(range(len(words)))
    phi = [Counter() for _ in words]
    for row, norm, k in zip(feats, norms, of, strict=True):
        for u, w in zip(row, weights, strict=True):
            if u:
                phi[k][int(u)] += float(w / norm)
    for a in range(len(words)):
        for b in range(len(words)):
            assert math.isclose(sum(v * phi[b][u] for u, v in phi[a].items()), _kernel(words[a], words[b]), abs_tol=1e-5)
    assert _kernel("idiot", "idxiot") > 0.5 > _kernel("idiot", "thunderstorm")


def test_decisions_are_weights_of_subsequences():
    rng = random.Random(4)
    say = lambda: " ".join(rng.choices("the river and copper meadow signal was in it".split(), k=12)) + "."
    texts = [f"{say()} you {rng.choice(['blorgface', 'zwickel', 'blorg-face'])}! {say()}" if k % 4 == 0 else f"{say()} and you too. {say()}" for k in range(120)]
    model = toxicity.fit(texts, [int(k % 4 == 0) for k in range(120)])
    words = ["blorgface", "bloxrgface", "river", "zwickel", "zw.ickel", "of", ""]
    for word, found in zip(words, model.decisions(words), strict=True):
        sub = _subsequences(word)
        norm = math.sqrt(sum(v * v for v in sub.values())) or 1.0
        want = sum(v * float(model.beta[(a << 12) | (b << 6) | c]) for (a, b, c), v in sub.items()) / norm + model.bias
        assert math.isclose(found, want, abs_tol=1e-4)
    scores = toxicity.Scorer(model).scores(["It was the blorrgface.", "The river was in the meadow.", None, "z w i c k e l"])
    assert scores[0] >= 0.5 > scores[1] and scores[2] < 0.5 <= scores[3]


def test_held_out_quality_on_the_tables(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in queries.op3_toxicity(spark, folder).where("held_out").collect() if r.doc_id in labels]
    toxic, clean = np.array([s for s, t in rows if t == 1]), np.array([s for s, t in rows if t == 0])
    assert len(toxic) > 50 and (toxic >= 0.5).mean() >= 0.7 and (clean >= 0.5).mean() <= 0.02
    assert (toxic[:, None] > clean[None, :]).mean() >= 0.9


# ---- disclosing terms -------------------------------------------------------------------------------------------


def _entities(kind, value):
    value = value.lower()
    digits = re.sub("[^0-9]", "", value)
    pool = {"email": value.rpartition("@")[2], "ip": value.rpartition(".")[0], "card": digits[:6], "phone": digits[:4]}[kind]
    return {f"{kind}:{value}", f"{kind}~{pool}", kind}


def _brute_terms(texts, disclosure=pii.DISCLOSURE, support=pii.SUPPORT):
    """Spans of terms by counting everything for every entity and word."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    times = Counter(w for t in texts for w in set(words(t)))
    context, lines, pairs, both, held = Counter(), defaultdict(set), defaultdict(set), defaultdict(set), []
    for d, t in enumerate(texts):
        found = [(k, t[a:b]) for k, a, b in brute_spans(t)]
        entities = set().union(*[_entities(k, v) for k, v in found])
        held.append(entities)
        context.update(entities)
        for line in t.split("\n") if entities else []:
            own = words(line)
            for k, w in enumerate(own):
                if not any(v in w or w in v for _, v in found):
                    for e in entities:
                        lines[e, w].add(line)
                        pairs[e, w].add((own[k - 1] if k else "", own[k + 1] if k + 1 < len(own) else ""))
                        both[e, w].add(d)
    bad = set()
    for (e, w), docs in both.items():
        information = -math.log2(context[e] / len(texts))
        revealed = math.log2(len(docs) * len(texts) / (context[e] * times[w]))
        if min(len(lines[e, w]), len(pairs[e, w])) >= support and information > 0 and revealed >= disclosure * information:
            bad.add((e, w))
    return [sorted((m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if any((e, m[0]) in bad for e in held[d])) for d, t in enumerate(texts)]


def _corpus(seed, planted):
    rng = random.Random(seed)
    common = "alpha beta gamma delta epsilon zeta theta lambda sigma omega kappa tau upsilon".split()
    say = lambda n: " ".join(rng.choices(common, k=n))
    texts = []
    for k in range(160):
        t = f"{say(6)}\n{say(9)}"
        if k % 16 == 0:
            t += f"\n{say(2)} {'Zorblatt' if planted else say(1)} {say(3)} zor{k}@acme.example.com {say(2)}"
        if k % 20 == 1:
            t += f"\n{say(3)} 10.7.3.{k} {'Quux' if planted else say(1)} {say(2)}\n{say(3)} +1 (553) 555-{5500 + k}"
        if k % 32 == 5:
            t += f"\n{say(4)} {'Quux' if planted else ''} {say(1)}"
        texts.append(t)
    return texts


@pytest.mark.parametrize(("seed", "planted"), [(1, True), (2, True), (3, False)])
def test_terms_equal_counting_everything(spark, seed, planted):
    texts = _corpus(seed, planted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: sorted((s.start, s.end) for s in r.terms) for r in pii.find(df).collect()}
    want = _brute_terms(texts)
    assert [found[k] for k in range(len(texts))] == want
    said = {texts[d][a:b] for d, spans in enumerate(want) for a, b in spans}
    assert said == ({"Zorblatt"} if planted else set())


# ---- shards -----------------------------------------------------------------------------------------------------


def _buckets(rows, limit, depth=0, prefix=0):
    """Extendible hashing by recursion: (hash, bytes) rows to {row number: (depth, prefix)}."""
    if sum(b for _, _, b in rows) <= limit or len(rows) == 1 or depth == sharding.BITS:
        return {n: (depth, prefix) for n, _, _ in rows}
    out = {}
    for bit in (0, 1):
        part = [r for r in rows if r[1] >> (sharding.BITS - depth - 1) & 1 == bit]
        out |= _buckets(part, limit, depth + 1, 2 * prefix + bit) if part else {}
    return out


@pytest.mark.parametrize("limit", [200, 5_000, 60_000, 1 << 30])
def test_shards_of_the_query_equal_recursion(spark, monkeypatch, limit):
    monkeypatch.setattr(queries, "SHARD_BYTES", limit)
    rows = queries.op7_sharding(spark, SMALL).collect()
    sizes = {r.doc_id: len((r.text or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: r.bytes for r in rows} == sizes and len(rows) == len(sizes)
    want = _buckets([(r.doc_id, r.hash, r.bytes) for r in rows], limit)
    assert {r.doc_id: (r.depth, r.shard_id - (1 << r.depth)) for r in rows} == want
    total = Counter()
    for r in rows:
        total[r.shard_id] += r.bytes
    assert all(total[r.shard_id] == r.shard_bytes for r in rows) and all(r.shard_bytes <= limit or total[r.shard_id] == r.bytes for r in rows)
    assert limit > 5_000 or len({r.depth for r in rows}) > 2
