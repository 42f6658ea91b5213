from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkdigest.llm import packing, queries, tokens
from tests.conftest import SMALL
from tests.llm.conftest import odd_texts

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))


@pytest.fixture(scope="session")
def reference():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def check_packing(rows, texts, reference, size):
    got = collections.defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = 0
    for doc, text in texts:
        ids = np.array([*reference(text), 0], "<u4")
        total += len(ids)
        want = [len(ids) % size or size] + [size] * (-(-len(ids) // size) - 1)
        starts = np.cumsum([0, *want])
        pieces = {(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got[doc]}
        assert {(k, int(starts[k]), n, zlib.crc32(ids[starts[k] : starts[k + 1]].tobytes())) for k, n in enumerate(want)} <= pieces
    assert len(rows) == sum(-(-(len(reference(t)) + 1) // size) for _, t in texts)
    return len(sequences), -(-total // size)


def test_odd_documents(odd, empty, reference):
    rows = packing.pack_documents(odd, JSON, 64).collect()
    n, bound = check_packing(rows, odd_texts(), reference, 64)
    assert n <= 1.02 * bound + 1
    assert packing.pack_documents(empty, JSON).count() == 0


def test_op1(spark, reference):
    rows = queries.op1_best_fit_packing(spark, SMALL).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    n, bound = check_packing(rows, texts, reference, 2048)
    assert n <= 1.02 * bound + 1


def test_runs_are_best_fit_decreasing():
    rng = random.Random(3)
    lengths = [rng.randint(1, 50) for _ in range(500)]
    runs = packing.match_runs(dict(collections.Counter(lengths)), 50)
    assert sum(b - a for _, a, b, _, _ in runs) == 500
    bins: list[int] = []  # plain best fit decreasing
    for x in sorted(lengths, reverse=True):
        fit = min((g for g in bins if g >= x), default=None)
        if fit is None:
            bins.append(50 - x)
        else:
            bins[bins.index(fit)] -= x
    opened = {s + r for length, a, b, s, _ in runs for r in range(b - a)}
    assert len(opened) == len(bins)


def test_op10_and_odd_texts(spark, odd, empty, reference):
    for r in tokens.encode(odd, RANKS, decoded=True).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.n_tokens
    by_id = {r.doc_id: r for r in tokens.encode(odd, RANKS, decoded=True).collect() if r.doc_id and r.doc_id != 6}
    for doc, text in odd_texts():
        if doc in by_id:
            assert bytes(by_id[doc].decoded) == (text or "").encode() and np.frombuffer(by_id[doc].ids, "<u4").tolist() == reference(text)
    assert tokens.encode(empty, RANKS).count() == 0
    back = tokens.decode(tokens.encode(odd, RANKS), RANKS)
    assert sorted(bytes(r.decoded) for r in back.collect()) == sorted((t or "").encode() for _, t in odd_texts())
    rows = {r.doc_id: r for r in queries.op10_byte_bpe(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = np.array(reference(r.text), "<u4").tobytes()
        assert (rows[r.doc_id].ids_sha256, rows[r.doc_id].decoded_sha256) == (hashlib.sha256(ids).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 200_000 + "x", "x y  z\n" * 40_000, "\n \n" * 60_000, "it's 1st! " * 20_000, "<|endoftext|> " * 9000])
def test_long_texts_are_cut_at_safe_boundaries(text):
    enc = tokens.encoding(RANKS)
    cut = tokens.ids_of(text, enc).tolist()
    assert enc.decode_bytes(cut) == text.encode()
    assert cut == enc.encode_ordinary(text) == tokens.ids_of(text, tokens.encoding(JSON)).tolist()
