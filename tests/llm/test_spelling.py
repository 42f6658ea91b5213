"""Spelling variants against comparing all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from sparkdigest.llm import queries, spelling
from tests.conftest import SMALL, same_rows


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def _count(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def _all_pairs(n):
    forms = {}
    for w in n:
        near = [v for v in n if v != w and _near(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        forms[w] = (best if best and n[best] >= 2 * n[w] else None, len(near))

    def root(w):
        return root(forms[w][0]) if forms[w][0] else w

    return sorted((w, n[w], forms[w][1], forms[w][0], n.get(forms[w][0]), root(w)) for w in n)


def _found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(df).collect())


def _words(rng):
    """Words of few letters, with runs of equal ones, anagrams and letters over 127, and variants of them at falling counts."""
    base = ["".join(rng.choice("aabé") for _ in range(rng.randint(5, 7))) for _ in range(60)] + ["aaaaaaa", "aaaaaa", "aaaaa", "ÀÖåaa", "Zeèççßß", "abababab", "babababa"]
    out = []
    for w in base:
        k = rng.choice([40, 20, 12])
        while k >= 3:
            out += [w] * k
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abcdéz") + w[at + 1 :], w[:at] + w[at] + w[at:]])
            k //= rng.choice([2, 3])
    rng.shuffle(out)
    return out


def test_all_pairs_of_odd_words(spark):
    rng = random.Random(3)
    words = _words(rng)
    rows = [(k, rng.choice([" ", "-", "1", "\n"]).join(words[k::60])) for k in range(60)]
    found = _found(spark, rows)
    assert found == _all_pairs(_count(rows))
    assert max(r[2] for r in found) > 3 and any(r[5] not in (r[0], r[3]) for r in found)


def test_damage_deletes_a_letter(spark):
    text = "Alphabet alphabet alphabet"
    hit = next(k for k in range(10_000) if zlib.crc32(f"{k}:alphabet".encode()) % 97 == 0)
    found = _found(spark, [(hit, text)])
    assert found == _all_pairs(_count([(hit, text)])) and len(found[0][0]) == 7


def test_nulls_empties_and_a_very_long_word(spark):
    long = "ab" * 30_000
    rows = [(None, "house house house"), (1, None), (2, ""), (3, "a é 12"), (4, f"{long} {long} {long} {long}x {long}x {long}x x{long}x x{long}x x{long}x"), (4, "HOUSE hoUSEs houses houses ×÷×÷× ×÷×÷× ×÷×÷×")]
    n = _count(rows)
    assert _found(spark, rows) == _all_pairs(n)
    assert _found(spark, []) == []


def test_hot_word_and_chain_of_forms(spark):
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    rows = [(k, " ".join(w for j, w in enumerate(chain) for _ in range(2**j))) for k in range(4)]
    found = _found(spark, rows)
    assert found == _all_pairs(_count(rows)) and {r[5] for r in found} == {"bbbbb"}


def test_query_equals_sql(spark, duck):
    same_rows(queries.queries()["op11_spelling_variants"](spark, SMALL), duck, queries.oracle_sql()["op11_spelling_variants"])
