"""Exact repeats of word windows across documents, found by fixed-block anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdigest.llm.common import Rolling, partitions, raw, tidy

#: Bytes of text in a chunk of documents, which is dealt out and looked up as one; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Bits kept of an anchor's hash, besides the part it is dealt to: a chance hit only costs a candidate.
ANCHOR_BITS = 28
#: Bits kept of a window's two hashes, besides the part.
WINDOW_BITS = 48, 32
#: Level at which chunks and entries are compressed before they are exchanged.
LEVEL = 3

_CHUNKS = "chunk bigint, n_docs int, docs binary"
_ENTRIES = "part int, chunk bigint, n int, entries binary"
_REPLIES = "chunk bigint, part int, n int, hits binary"


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as byte planes, each with its length, compressed: upper planes are nearly all zero."""
    parts = []
    for a in arrays:
        parts += [np.array([len(a)], "<i8").tobytes(), a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()]
    data = b"".join(parts)
    return np.array([len(data)], "<i8").tobytes() + pa.Codec("zstd", LEVEL).compress(data, asbytes=True)


def _spread(blob: bytes) -> list[np.ndarray]:
    """The arrays of _squeezed(), as unsigned 64-bit numbers."""
    size = int(np.frombuffer(blob, "<i8", 1)[0])
    data = pa.Codec("zstd").decompress(memoryview(blob)[8:], size, asbytes=True)
    out, at = [], 0
    while at < size:
        n = int(np.frombuffer(data, "<i8", 1, at)[0])
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at + 8).reshape(8, n).T).view("<u8").ravel())
        at += 8 + 8 * n
    return out


def chunks(rows: DataFrame) -> DataFrame:
    """_CHUNKS of rows(doc_id, text, ...): documents of about CHUNK_BYTES together, all columns, compressed."""

    def blob(held: list[pa.RecordBatch]) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
            for b in held:
                out.write_batch(b)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []
        room = CHUNK_BYTES

        def flush() -> pa.RecordBatch:
            nonlocal k
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([base + k]), pa.array([sum(b.num_rows for b in held)], pa.int32()), pa.array([blob(held)], pa.binary())], ["chunk", "n_docs", "docs"])

        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            at = done = 0
            while at < b.num_rows:
                to = max(at + (not held), int(np.searchsorted(ends, done + room, "right")))
                if to > at:
                    held.append(b.slice(at, to - at))
                    room -= int(ends[to - 1]) - done
                    at, done = to, int(ends[to - 1])
                if at < b.num_rows or room <= 0:
                    yield flush()
                    held, room = [], CHUNK_BYTES
        if held:
            yield flush()

    return rows.mapInArrow(tidy(run), _CHUNKS)


class Chunk:
    """The documents of a chunk, their words' hashes, and the entries that are asked about elsewhere.

    Entries are distinct in a chunk, in order of part and hash. So a chunk sends each hash once however often it
    stands there, and an answer is one bit for each entry, which the same chunk can put back to its places.
    """

    def __init__(self, blob: bytes, parts: int, window: int, block: int, first: Rolling, second: Rolling):
        self.table = pa.ipc.open_stream(blob).read_all()
        self.ids = self.table.column(0).to_pylist()
        self.texts = [raw(t) for t in self.table.column(1).to_pylist()]
        self.words = [first.words(t) for t in self.texts]
        self.parts, self.window, self.block, self.first, self.second = parts, window, block, first, second
        # rows without an id neither lose words nor make others lose any
        self.told = [k for k, i in enumerate(self.ids) if i is not None]

    def _part(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)

    def blocks(self) -> None:
        """Every run of `block` words: of, the documents; anchor, whether it is one of the non-overlapping blocks."""
        runs = [self.first.windows(self.words[k][0], self.block) for k in self.told]
        self.n_runs = [len(x) for x in runs]
        h = np.concatenate([*runs, np.empty(0, np.uint64)])
        at = np.concatenate([*(np.arange(n) for n in self.n_runs), np.empty(0, np.int64)])
        of = np.repeat(np.array([self.ids[k] for k in self.told], np.int64), self.n_runs)
        code = self._part(h) << np.uint64(32) | h & np.uint64((1 << ANCHOR_BITS) - 1)
        self._group(code, np.argsort(code))
        anchor = np.logical_or.reduceat((at % self.block == 0)[self.order], self.new) if len(h) else np.empty(0, bool)
        of = of[self.order]
        several = np.minimum.reduceat(of, self.new) != np.maximum.reduceat(of, self.new) if len(h) else np.empty(0, bool)
        self.keys = [self.codes & np.uint64((1 << 32) - 1)]
        self.flags = anchor.astype(np.uint8) + 2 * several.astype(np.uint8)
        self.bounds = np.searchsorted(self.codes >> np.uint64(32), np.arange(self.parts + 1, dtype=np.uint64))

    def _group(self, code: np.ndarray, order: np.ndarray, other: np.ndarray | None = None) -> None:
        s = code[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        if other is not None:
            new[1:] |= other[order][1:] != other[order][:-1]
        self.order, self.new = order, np.flatnonzero(new)
        self.codes = s[self.new]

    def spread(self, by_entry: np.ndarray) -> np.ndarray:
        """What holds for each entry, at each of its places."""
        out = np.empty(len(self.order), by_entry.dtype)
        out[self.order] = np.repeat(by_entry, np.diff(np.append(self.new, len(self.order))))
        return out

    def answered(self, replies: list | None) -> np.ndarray:
        """The bit of each entry, from the replies of all parts."""
        out = np.zeros(len(self.codes), bool)
        for r in replies or ():
            lo, hi = self.bounds[r["part"]], self.bounds[r["part"] + 1]
            if hi - lo != r["n"]:
                raise ValueError("a chunk has other entries than when it asked: documents must not change while they are read")
            out[lo:hi] = np.unpackbits(np.frombuffer(r["hits"], np.uint8), count=r["n"]).view(bool)
        return out

    def candidates(self, replies: list | None) -> None:
        """The windows around the runs that were hit: anchors are extended, and whole windows are asked about."""
        self.blocks()
        hit = self.spread(self.answered(replies))
        where, h, g = [], [], []
        span = self.window - self.block
        at = 0
        for k, n in zip(self.told, self.n_runs, strict=True):
            hits = np.flatnonzero(hit[at : at + n])
            at += n
            words = self.words[k][0]
            last = len(words) - self.window + 1
            if not len(hits) or last <= 0:
                continue
            places = np.flatnonzero(covered(np.maximum(hits - span, 0), span + 1, len(words))[:last])
            where.append((np.full(len(places), k), places))
            h.append(self.first.windows(words, self.window)[places])
            g.append(self.second.windows(self.second.words(self.texts[k])[0], self.window)[places])
        self.doc = np.concatenate([*(x for x, _ in where), np.empty(0, np.int64)])
        self.place = np.concatenate([*(x for _, x in where), np.empty(0, np.int64)])
        none = np.empty(0, np.uint64)
        h, g = np.concatenate([*h, none]), np.concatenate([*g, none]) & np.uint64((1 << WINDOW_BITS[1]) - 1)
        part, low = self._part(h), h & np.uint64((1 << WINDOW_BITS[0]) - 1)
        order = np.lexsort((g, low, part))
        code = low ^ part << np.uint64(WINDOW_BITS[0])
        self._group(code, order, g)
        self.keys = [low[order][self.new], g[order][self.new]]
        ids = np.array([self.ids[k] for k in self.doc], np.int64)
        self.least = np.minimum.reduceat(ids[order], self.new) if len(ids) else ids
        self.own = ids
        self.bounds = np.searchsorted(part[order][self.new], np.arange(self.parts + 1, dtype=np.uint64))

    def repeats(self, hits: list | None, again: list | None) -> dict[int, np.ndarray]:
        """By document, the places of windows that also start in a document with a smaller id."""
        if not hits:
            return {}
        self.candidates(hits)
        gone = self.spread(self.answered(again)) | (self.own > self.spread(self.least))
        doc, place = self.doc[gone], self.place[gone]
        ends = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1], [True]))) if len(doc) else []
        return {int(doc[lo]): place[lo:hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)} if len(doc) else {}


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of so many from one of the starts: runs that touch merge to a maximal repeat."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, n), -1)
    return np.cumsum(edge[:n]) > 0


def _answers(asked: DataFrame, parts: int, judge: Callable[[list[list[np.ndarray]]], np.ndarray]) -> DataFrame:
    """_REPLIES to _ENTRIES: judge() gets the arrays of all entries of a part and says a bit for each.

    One part to a task. Parts are ranges of hashes, so they are even, and a chunk sends a hash once at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not rows:
            return
        bits = judge([_spread(r[3]) for r in rows])
        at = 0
        for lo in range(0, len(rows), 1024):
            out = []
            for part, chunk, n, _ in rows[lo : lo + 1024]:
                own = bits[at : at + n]
                at += n
                if own.any():
                    out.append((chunk, part, n, np.packbits(own).tobytes()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["chunk", "part", "n", "hits"])

    found = asked.repartitionById(parts, "part").mapInArrow(tidy(run), _REPLIES)
    return found.groupBy("chunk").agg(F.collect_list(F.struct("part", "n", "hits")).alias("hits"))


def _hit(entries: list[list[np.ndarray]]) -> np.ndarray:
    """Runs that are an anchor somewhere and stand in several documents."""
    keys = np.concatenate([np.cumsum(e[0]) for e in entries])
    flags = np.concatenate([e[1] for e in entries]).astype(np.uint8)
    order = np.argsort(keys)
    s = keys[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
    count = np.diff(np.append(new, len(s)))
    any_of = np.bitwise_or.reduceat(flags[order], new)
    good = ((any_of & 1) > 0) & ((count > 1) | (any_of > 1))
    out = np.empty(len(s), bool)
    out[order] = np.repeat(good, count)
    return out


def _later(entries: list[list[np.ndarray]]) -> np.ndarray:
    """Windows whose smallest document in their chunk isn't the smallest of all."""
    low = np.concatenate([np.cumsum(e[0]) for e in entries])
    g = np.concatenate([e[1] for e in entries])
    ids = np.concatenate([np.cumsum(e[3].view(np.int64))[e[2].astype(np.int64)] for e in entries])
    order = np.lexsort((g, low))
    low, g, sorted_ids = low[order], g[order], ids[order]
    new = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (g[1:] != g[:-1]))))
    out = np.empty(len(ids), bool)
    out[order] = sorted_ids > np.repeat(np.minimum.reduceat(sorted_ids, new), np.diff(np.append(new, len(ids))))
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Numbers in order as the first and the steps from each to the next."""
    return np.diff(keys, prepend=np.zeros(1, keys.dtype))


def _rows(parts: int, chunk: int, bounds: np.ndarray, entries: Callable[[int, int], bytes]) -> pa.RecordBatch:
    some = np.flatnonzero(np.diff(bounds))
    n = np.diff(bounds)[some]
    blobs = [entries(int(bounds[p]), int(bounds[p + 1])) for p in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([chunk] * len(some), pa.int64()), pa.array(n, pa.int32()), pa.array(blobs, pa.binary())], ["part", "chunk", "n", "entries"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block: int = 7, spaced: bool = False, carry: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every row: its text without the words of repeated windows.

    Words are runs of characters other than ASCII white space. A word goes if a window of `window` words that covers it
    also starts in a row with a smaller id, judged on the input. spans are the removed runs of words (from, to). kept
    has the remaining words joined by one space, or with spaced=True the text with its own white space, less the
    removed words and the white space after them. With carry=True the other columns of docs come along in
    a struct named others.

    A window of 2 * block - 1 words or more holds a whole block of any division into blocks. So the index has only every
    block-th run of words of each document, and the probes every one. A run that is an indexed block and stands in
    several documents is hit; hits are extended to the windows around them, these are compared as whole windows, and those
    that touch merge to maximal repeats. Documents go by chunks: a chunk asks for each of its distinct hashes once and
    gets one bit back, so neither places nor pairs are exchanged, and a hot passage costs an entry for each chunk.
    Windows are equal if WINDOW_BITS of two independent functions and the part are (long words are hashed by XXH3): among
    10**13 windows, one false repeat is expected in some 2000 runs.

    Null text has no words. A row with a null id keeps its words and makes no other row lose any. Rows that repeat an
    id are each judged against smaller ids only. Texts of fewer words than a window, and empty tables, pass through. The
    rows of docs must not change while the query runs: a chunk that does stops it.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it begins: window >= 2 * block - 1")
    parts = partitions(docs.sparkSession)
    others = [c for c in docs.columns if c not in (id_col, text_col)] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in others]).alias("others")] if others else []))
    # the three uses below share this exchange
    dealt = chunks(rows).repartition(parts, "chunk")
    first, second = Rolling(1), Rolling(2)
    load = lambda blob: Chunk(blob, parts, window, block, first, second)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column("chunk").to_pylist(), b.column("docs"), strict=True):
                c = load(blob.as_buffer())
                c.blocks()
                yield _rows(parts, chunk, c.bounds, lambda lo, hi, c=c: _squeezed(_steps(c.keys[0][lo:hi]), c.flags[lo:hi]))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob, hits in zip(b.column("chunk").to_pylist(), b.column("docs"), b.column("hits"), strict=True):
                if not hits.is_valid:
                    continue
                c = load(blob.as_buffer())
                c.candidates(hits.as_py())

                def entries(lo: int, hi: int, c: Chunk = c) -> bytes:
                    ids, of = np.unique(c.least[lo:hi], return_inverse=True)
                    return _squeezed(_steps(c.keys[0][lo:hi]), c.keys[1][lo:hi], of, _steps(ids).view(np.uint64))

                yield _rows(parts, chunk, c.bounds, entries)

    hits = _answers(dealt.mapInArrow(tidy(probes), _ENTRIES), parts, _hit)
    asked = dealt.join(hits, "chunk", "left")
    again = _answers(asked.mapInArrow(tidy(windows), _ENTRIES), parts, _later).withColumnRenamed("hits", "again")
    kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, hits, gone in zip(b.column("docs"), b.column("hits"), b.column("again"), strict=True):
                c = load(blob.as_buffer())
                found = c.repeats(hits.as_py(), gone.as_py())
                got = [_kept(t, c.words[k], found.get(k), window, spaced) for k, t in enumerate(c.texts)]
                n, spans, kept = zip(*got, strict=True)
                lost = [sum(hi - lo for lo, hi in x) for x in spans]
                spans = [[{"from": lo, "to": hi} for lo, hi in x] for x in spans]
                own = c.table.combine_chunks()
                cols = [own.column(0), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, kind), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "spans", "kept"]
                out = pa.table([*cols, *([own.column("others")] if others else [])], [*names, *(["others"] if others else [])])
                yield from out.combine_chunks().to_batches()

    schema = T._parse_datatype_string("doc_id long, n_words long, n_removed long, spans array<struct<from:long,to:long>>, kept string")
    return asked.join(again, "chunk", "left").mapInArrow(tidy(cut), schema.add(rows.schema["others"]) if others else schema)


def _kept(text: bytes, words: tuple, starts: np.ndarray | None, window: int, spaced: bool) -> tuple[int, list[list[int]], bytes]:
    """Number of words, runs of removed words (from, to), and the text that stays."""
    _, start, end = words
    if starts is None:
        return len(start), [], text if spaced else b" ".join(text.split())
    gone = covered(starts, window, len(start))
    edge = np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))
    runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
    if not spaced:
        return len(start), runs.tolist(), b" ".join([text[start[i] : end[i]] for i in np.flatnonzero(~gone)])
    out, at = [], 0
    for lo, hi in runs:
        out.append(text[at : start[lo]])
        at = start[hi] if hi < len(start) else end[-1]
    return len(start), runs.tolist(), b"".join([*out, text[at:]])
