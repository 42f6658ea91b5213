"""Byte-level BPE encoding and decoding with tiktoken and local vocabulary files."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from sparkdigest.llm.common import pick, small, tidy

#: Longer texts are cut before they are encoded.
LONG = 1 << 16
#: Stretches without a safe boundary that are longer than this are split by the pattern itself.
STRETCH = 1 << 18
#: A piece starts here whatever surrounds it: a space takes the following word along and never ends a piece before it.
_SAFE = regex.compile(r"(?<=\S)(?= \S)")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the
    others are numbered from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """A rank file (.tiktoken), or the vocabulary of a tokenizers file (.json), whose ids are its merge ranks."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", ()) if x.get("special")}
        chars = byte_of_char()
        ranks = {bytes(chars[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str) -> Iterator[str]:
    """A long text in parts of about LONG characters, cut only at safe boundaries."""
    at = 0
    while len(text) - at > LONG:
        found = _SAFE.search(text, at + LONG)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def ids_of(text: str | None, enc: tiktoken.Encoding, pattern: str = public_tokenizers.PATTERN) -> np.ndarray:
    """Ids of a whole text as little-endian unsigned 32-bit numbers; null counts as empty."""
    if not text:
        return np.empty(0, "<u4")
    if len(text) <= LONG:
        return np.array(enc.encode_ordinary(text), "<u4")
    out: list[int] = []
    for part in segments(text):
        if len(part) <= STRETCH:
            out += enc.encode_ordinary(part)
        else:
            for piece in regex.finditer(pattern, part):
                out += enc._encode_single_piece(piece[0])
    return np.array(out, "<u4")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids[, decoded]) of every row; ids are little-endian unsigned 32-bit numbers.

    Each match of the pattern is encoded separately, without special tokens: their strings are ordinary text. With
    decoded=True the ids are turned back to bytes. Null and empty texts have no ids; null ids, repeated rows and empty
    tables pass through; further columns are ignored.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in small(batches):
            ids = [ids_of(t, enc) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            if decoded:
                cols.append(pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"][: len(cols)])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded) of every row of encode(): the raw bytes, which need not be valid UTF-8 for cut ids. Null ids
    give no bytes."""
    rows = pick(tokens, id_col, ids_col).toDF("doc_id", "ids")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in small(batches):
            out = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, decoded binary")
