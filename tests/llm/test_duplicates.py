from __future__ import annotations

import hashlib
import random

import pytest
import xxhash

from sparkdigest.llm import components, queries, simhash, substrings
from tests.conftest import SMALL, same_rows
from tests.llm.conftest import odd_texts


def fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    nodes = sorted(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if linked(a, b):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def check_classes(rows, texts):
    fps = {}
    for doc, text in texts:
        fps.setdefault(fingerprint(text), set()).add(doc)
    root = roots(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for fp, docs in fps.items():
        least.setdefault(root[fp], []).extend(d for d in docs if d is not None)
    want = sorted(((doc, fp := fingerprint(text), min(least[root[fp]], default=None)) for doc, text in texts), key=repr)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in rows), key=repr) == want


def test_odd_documents(odd, empty):
    check_classes(simhash.near_duplicates(odd).collect(), odd_texts())
    assert simhash.near_duplicates(empty).count() == 0


def test_op8(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = queries.op8_simhash_dedup(spark, SMALL).collect()
    assert all(r.fingerprint == f"{fingerprint(dict(docs)[r.doc_id]):016x}" for r in rows)
    check_classes(simhash.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet")).collect(), docs)


@pytest.mark.parametrize("paired", [1, 48])
def test_links_of_crowded_fingerprints(spark, monkeypatch, paired):
    """Chains and balls of near fingerprints, by pairs and by flipped bits."""
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(fps)[:4]:
        at = centre
        for _ in range(30):
            at ^= 1 << rng.randrange(64) ^ (rng.random() < 0.5 and 1 << rng.randrange(64))
            fps.add(at)
        fps.update(centre ^ (1 << k) for k in range(0, 64, 3))
    signed = lambda x: x - 2**64 if x >> 63 else x
    links = simhash.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    pairs = {(r.a % 2**64, r.b % 2**64) for r in links}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in pairs)
    same = {frozenset((a, b)) for a, b in pairs}
    want = roots(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert roots(fps, lambda a, b: frozenset((a, b)) in same) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    up = {}
    for a, b in edges:
        for x in (a, b):
            up.setdefault(x, x)
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in up.items() if k in linked}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def brute_removed(texts, window=13):
    words = [(doc, (text or "").encode().split()) for doc, text in texts]
    first = {}
    for doc, w in words:
        if doc is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, w in words:
        gone = set()
        if doc is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < doc:
                    gone.update(range(k, k + window))
        out.append((doc, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def test_substrings_of_odd_documents(odd, empty):
    got = substrings.remove_repeats(odd).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_removed(odd_texts())
    assert substrings.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError, match="block"):
        substrings.remove_repeats(odd, window=12)


def test_spacing_and_other_columns_stay(odd):
    texts = {d: t for d, t in odd_texts() if d is not None}
    rows = substrings.remove_repeats(odd, spaced=True, carry=True).where("doc_id is not null").collect()
    assert all(r.others.found == "x" and r.others.fp == 7 for r in rows)
    for r in rows:
        assert r.kept == (texts[r.doc_id] or "") if r.n_removed == 0 else r.kept.split() != texts[r.doc_id].split()


def test_op2_equals_sql(spark, duck):
    same_rows(queries.op2_substring_dedup(spark, SMALL), duck, queries.SQL["op2_substring_dedup"])
    row = queries.op2_substring_dedup(spark, SMALL).where("n_words = 0").first()
    assert row is None or row.kept_sha256 == hashlib.sha256(b"").hexdigest()
