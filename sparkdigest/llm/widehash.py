"""Near copies by similarity: wide SimHash fingerprints, nearest reference fingerprints, and a check on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdigest.llm.common import Rolling, mixed, no_rows, pick, raw, released, row_id, small, tidy, written
from sparkdigest.llm.components import components

#: Words of a shingle.
SHINGLE = 5
#: Two texts are near copies if their shingle sets' Jaccard similarity is at least NEAR[0] / NEAR[1].
NEAR = (4, 5)
#: Bits of a fingerprint. Sets at similarity 0.8 differ in 78 of them on average, with a deviation of 8.
BITS = 512
#: Pairs that differ in more bits go: 3 deviations above the mean at similarity 0.8.
RADIUS = 104
#: A finer fingerprint has two more bits each, of which pairs at similarity 0.8 differ in 171 on average (deviation 11).
LEVELS, FINE_RADIUS = (-1.0, 1.0), 190
#: A table's reference fingerprints: TURNS Walsh matrices and their complements, so 2 * TURNS * BITS, known by NEAREST_BITS bits.
TURNS, NEAREST_BITS = 2, 11
#: Probability that sets at similarity 0.8 have the same nearest reference fingerprint in one table (measured).
AGREE = 0.33
#: Share of pairs at similarity 0.8 that no key may find.
MISSED = 0.01
#: Reference fingerprints whose distances are kept, in steps of a SCALE-th of a deviation, and how much two may differ.
PIVOTS, SCALE, DIFFER = 16, 24, 44
#: Sizes of sets are told apart by powers of this in a key, from another start in each.
SIZES = 3.0
#: Rounds in which a class is compared with one of its members go on while one pair in so many is a link, at most ROUNDS.
WORTH, ROUNDS = 10, 3
#: Contractions after such a round: what they leave apart is only compared once more.
EARLY = 2
#: Pairs up to which their ids are sent to every task, 32 bytes each.
SENT = 500_000
#: Members of a key up to which its pairs are listed as rows; larger keys are compared in blocks, whose pairs stay in their task.
PAIRED = 3
#: Members of a block, and shingles of its members together (4 bytes each), at most.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 22

_rolling = Rolling(5)
_LANES = np.array([sum(1 << (8 * k) for k in range(8) if i >> k & 1) for i in range(256)], np.uint64)
_rng = np.random.Generator(np.random.PCG64(88))
_ODD = _rng.integers(1, 2**63, BITS // 64, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 2**63, BITS // 64, dtype=np.uint64)


def _walsh(n: int) -> np.ndarray:
    out = np.ones((1, 1), np.float32)
    while len(out) < n:
        out = np.block([[out, out], [out, -out]])
    return out


_LEFT, _RIGHT = _walsh(32), _walsh(BITS // 32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: the words' run if there are fewer, none without words."""
    words = _rolling.words(raw(text).lower())[0]
    return np.unique(_rolling.windows(words, min(SHINGLE, len(words)))) if len(words) else np.empty(0, np.uint64)


def margins(grams: np.ndarray) -> np.ndarray:
    """SimHash before the cut: by how many deviations more of the hashes set a bit than don't."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), 4080):
        lanes = _LANES[mixed(grams[at : at + 4080, None] * _ODD + _ADD).view(np.uint8)]
        ones += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return ((2 * ones - len(grams)) / math.sqrt(max(1, len(grams)))).astype(np.float32)


def distances(m: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Of each row of margins, how near each reference fingerprint is, for each row of signs.

    The reference fingerprints are the rows of a Walsh matrix with their bits turned by signs. What counts is the
    Hamming distance in which each bit weighs its margin; less a constant of the text and halved, it is minus this
    product. Two small matrix products give all BITS of them at once.
    """
    x = (m[:, None, :] * signs).reshape(-1, BITS // 32) @ _RIGHT
    x = np.ascontiguousarray(x.reshape(-1, 32, BITS // 32).transpose(0, 2, 1)).reshape(-1, 32) @ _LEFT
    return x.reshape(len(m), len(signs), BITS)


def tables_for(rows: int) -> tuple[int, int]:
    """How many tables a key joins, and how many keys there are.

    A key has as many bits as the number of rows, or more, so that chance meetings stay in proportion to the rows; the
    number of keys makes up for what longer keys find less often.
    """
    joined = max(2, math.ceil(math.log2(max(rows, 2)) / NEAREST_BITS))
    return joined, math.ceil(math.log(MISSED) / math.log(1 - AGREE**joined))


class Reader:
    """Signatures of sets: fingerprint, distances to PIVOTS reference fingerprints, and keys."""

    def __init__(self, joined: int, keys: int):
        rng = np.random.Generator(np.random.PCG64(89))
        self.joined = joined
        self.signs = rng.choice(np.array([-1, 1], np.float32), (1 + TURNS * joined * keys, BITS))
        self.start = rng.random(keys)
        self.salt = rng.integers(1, 2**63, (keys, joined + 1), dtype=np.uint64) | np.uint64(1)

    def read(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints and the bits of finer ones as longs, distances (n x PIVOTS, 8-bit), keys (n x keys)."""
        m = np.array([margins(s) for s in sets]).reshape(-1, BITS)
        bits, fine = np.packbits(m > 0, axis=1), np.hstack([np.packbits(m > x, axis=1) for x in LEVELS])
        pivots, near = [], []
        for at in range(0, len(m), 4):  # few at once, so that they stay in the cache
            d = distances(m[at : at + 4], self.signs)
            pivots.append(np.clip(np.rint(d[:, 0, :PIVOTS] * (SCALE / math.sqrt(BITS))), -127, 127).astype(np.int8))
            d = d[:, 1:].reshape(len(d), -1, TURNS * BITS)
            best = np.abs(d).argmax(axis=2)
            near.append(2 * best + (np.take_along_axis(d, best[..., None], 2)[..., 0] > 0))
        near = np.concatenate(near).reshape(len(m), -1, self.joined)
        size = np.floor(np.log([len(s) for s in sets])[:, None] / math.log(SIZES) + self.start).astype(np.int64)
        parts = np.concatenate([near, size[..., None]], axis=2).astype(np.uint64)
        return bits.view("<i8"), fine.view("<i8"), np.concatenate(pivots), mixed((mixed(parts + self.salt) * self.salt).sum(axis=2, dtype=np.uint64)).view(np.int64)


def _signatures(rows: DataFrame, reader: Reader) -> DataFrame:
    """(rid, doc_id, sid, n, bits, fine, pivots, keys) of rows(rid, doc_id, text): sid names the shingle set, n is its size."""
    kind = dict(rows.dtypes)["doc_id"]
    kinds = [pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sets = [shingles(t) for t in b.column(2).to_pylist()]
            sid = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            some = [k for k, s in enumerate(sets) if len(s)]
            found: list[list] = [[None] * len(sets), [None] * len(sets), [None] * len(sets), [[]] * len(sets)]
            if some:
                for col, values in zip(found, reader.read([sets[k] for k in some]), strict=True):
                    for k, x in zip(some, values, strict=True):
                        col[k] = x
            cols = [sid, [len(s) for s in sets], *found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["rid", "doc_id", "sid", "n", "bits", "fine", "pivots", "keys"])

    return rows.mapInArrow(tidy(run), f"rid binary, doc_id {kind}, sid binary, n int, bits array<bigint>, fine array<bigint>, pivots array<tinyint>, keys array<bigint>")


def _sets(rows: DataFrame) -> DataFrame:
    """(sid, grams) of rows(sid, text), 32 bits of each shingle's hash; a repeated row gives the same twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            grams = pa.array([(shingles(t) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), grams], ["sid", "grams"])

    return rows.mapInArrow(tidy(run), "sid binary, grams array<int>")


def _distance(x: str, y: str, bits: int = BITS) -> Column:
    return sum((F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(bits // 64)), F.lit(0))


def _may(x: str, y: str) -> Column:
    """Whether two sets can be near copies: sizes, no pivot distance differing by more than DIFFER, fingerprints within RADIUS."""
    n = F.least(f"{x}.n", f"{y}.n") * NEAR[1] >= F.greatest(f"{x}.n", f"{y}.n") * NEAR[0]
    for k in range(PIVOTS):
        n = n & (F.abs(F.get(f"{x}.pivots", F.lit(k)).cast("int") - F.get(f"{y}.pivots", F.lit(k)).cast("int")) <= DIFFER)
    return n & (_distance(f"{x}.bits", f"{y}.bits") <= RADIUS)


def _verified(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """near_pairs(), of which no sets are left behind."""
    return released(lambda: near_pairs(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sid")))), "verified")


def near_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b), a written table, that are near copies by their whole sets, of whose shingles 32 bits are compared.

    Sets travel to their pairs: once each for every pair. Up to SENT pairs, these go to the sets; beyond, both are dealt
    by set.
    """
    sides = pairs.select(F.explode(F.array("a", "b")).alias("sid"), "a", "b")
    both = sets.join(F.broadcast(sides) if pairs.count() <= SENT else sides, "sid").groupBy("a", "b").agg(F.min(F.struct("sid", "grams")).alias("x"), F.max(F.struct("sid", "grams")).alias("y"))
    shared = F.size(F.array_intersect("x.grams", "y.grams"))
    return both.where(shared * NEAR[1] >= (F.size("x.grams") + F.size("y.grams") - shared) * NEAR[0]).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members(key, sid, s) with their roots, of the keys that still hold more than one root."""
    now = members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    key = Window.partitionBy("key")
    apart = now.withColumns({"low": F.min("root").over(key), "high": F.max("root").over(key)}).where("low <> high")
    return written(apart.drop("low", "high"), "live")


def _in_blocks(members: DataFrame) -> DataFrame:
    """members(key, n, sid, ...) with their block, once for each two blocks (first, second) of the key that they take part in."""
    key = Window.partitionBy("key")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)).over(key) / BLOCK, F.sum("n").over(key) / BLOCK_SHINGLES))
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return dealt.withColumn("other", other).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")}).drop("blocks", "other")


def _rows(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """A column of arrays of equal length, as a matrix."""
    return np.asarray(column.combine_chunks().flatten()).view(kind).reshape(len(column), -1)


def _candidates(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of t's first block with those of its second that _may() lets pass, each pair once; with column fine, the finer
    fingerprints are compared, too."""
    n, bits, pivots, block = np.asarray(t["n"]).astype(np.int64), _rows(t["bits"], "u8"), _rows(t["pivots"], "i1").astype(np.int16), np.asarray(t["block"])
    fine = _rows(t["fine"], "u8") if "fine" in t.column_names else None
    first, second = t["first"][0].as_py(), t["second"][0].as_py()
    right = np.flatnonzero(block == second)
    for i in np.flatnonzero(block == first):
        j = right[right > i] if first == second else right
        j = j[np.minimum(n[i], n[j]) * NEAR[1] >= np.maximum(n[i], n[j]) * NEAR[0]]
        d = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        j, d = j[d <= RADIUS], d[d <= RADIUS]
        if fine is not None:
            j = j[d + np.bitwise_count(fine[i] ^ fine[j]).sum(axis=1, dtype=np.int64) <= FINE_RADIUS]
        yield i, j[(np.abs(pivots[i] - pivots[j]) <= DIFFER).all(axis=1)]


def _crowded(t: pa.Table) -> pa.Table:
    """The members of a group of two blocks that have a candidate of another root."""
    root = np.unique(t["root"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
    some = np.zeros(len(t), bool)
    for i, j in _candidates(t):
        j = j[root[j] != root[i]]
        some[j] = True
        some[i] |= len(j) > 0
    return t.filter(pa.array(some)).select(["key", "sid", "root"])


def _spanning(t: pa.Table) -> pa.Table:
    """Links (a, b) that join what the verified pairs of a group of two blocks join; pairs that are joined already are left out."""
    root = np.unique(t["root"].to_numpy(zero_copy_only=False), return_inverse=True)[1]
    n, sid, flat = np.asarray(t["n"]).astype(np.int64), t["sid"].to_pylist(), t["grams"].combine_chunks()
    ends = np.asarray(flat.offsets)
    hashes = np.asarray(flat.values).view(np.uint32)
    grams = [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    out = []
    for i, j in _candidates(t):
        j = j[root[j] != root[i]]
        if not len(j):
            continue
        others = [grams[k] for k in j]
        at = np.cumsum([0, *map(len, others)])
        others = np.concatenate(others)
        same = grams[i][np.minimum(np.searchsorted(grams[i], others), len(grams[i]) - 1)] == others
        shared = np.add.reduceat(same, at[:-1], dtype=np.int64)
        for k in j[shared * NEAR[1] >= (n[i] + n[j] - shared) * NEAR[0]]:
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                out.append((sid[i], sid[k]))
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})


def _crowd_links(crowds: DataFrame, known: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that join the sets that the verified pairs of each key in crowds(key, sid, s, root) join.

    Members of a key are compared in blocks: first to see who has a candidate, then, with their whole sets, to verify the
    candidates. Pairs stay in their task, so rows grow with the members and not with their pairs.
    """
    group = ["key", "first", "second"]
    some = _in_blocks(crowds.select("key", "sid", "root", "s.n", "s.bits", "s.pivots")).groupBy(group).applyInArrow(_crowded, "key bigint, sid binary, root binary")
    some = written(some.distinct(), "crowds")
    if some.isEmpty():
        return no_rows(crowds.sparkSession, "a binary, b binary")
    sets = known.select("sid", "n", "bits", "pivots", "fine").join(sets_of(some.select("sid")).dropDuplicates(["sid"]), "sid")
    return _in_blocks(some.join(sets, "sid")).groupBy(group).applyInArrow(_spanning, "a binary, b binary")


def set_links(members: DataFrame, known: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the components of all verified pairs that share a key in members(key, sid, s); s is (n, bits, pivots), and
    known(sid, n, bits, pivots, fine) has them all.

    Each round compares every member of a key with one of them, another one in each key, and verifies each set's nearest
    such candidate. This puts large groups of near copies together without their pairs. Then every pair of a key whose
    sides are still apart is compared, by the finer fingerprints, too, so that the components are those of all pairs: what is
    skipped is joined already. Keys of over PAIRED members do this in blocks. sets_of(sids) gives the whole sets of some members.
    """
    spark = members.sparkSession
    links = no_rows(spark, "a binary, b binary")
    roots = no_rows(spark, "node binary, root binary")
    live = members.withColumn("root", F.col("sid"))
    for k in range(ROUNDS):
        one = live.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(k), "key", "sid").alias("h"), F.col("sid").alias("b"), F.col("s").alias("t"), F.col("root").alias("root_b"))).alias("p")).select("key", "p.b", "p.t", "p.root_b")
        met = live.join(one, "key").where(F.col("sid") != F.col("b"))
        near = met.where((F.col("root") != F.col("root_b")) & _may("s", "t")).groupBy("sid").agg(F.min(F.struct(_distance("s.bits", "t.bits").alias("d"), "b")).alias("p"))
        pairs = written(_ordered(near.select(F.col("sid").alias("a"), F.col("p.b").alias("b"))), "pairs")
        if pairs.isEmpty():
            break
        new = _verified(pairs, sets_of)
        links = links.union(new)
        roots = components(links, EARLY)
        live = _rooted(live.drop("root"), roots)
        if WORTH * new.count() < pairs.count():
            break
    many = F.count(F.lit(1)).over(Window.partitionBy("key")) > PAIRED
    live = written(live.withColumn("many", many), "apart")
    links = links.union(released(lambda: _crowd_links(live.where("many"), known, sets_of), "crowded"))
    live = live.where("not many").join(known.select("sid", "fine"), "sid")
    right = live.select("key", F.col("sid").alias("b"), F.col("s").alias("t"), F.col("fine").alias("finer"), F.col("root").alias("root_b"))
    near = _distance("s.bits", "t.bits") + _distance("fine", "finer", len(LEVELS) * BITS) <= FINE_RADIUS
    rest = live.join(right, "key").where((F.col("root") < F.col("root_b")) & _may("s", "t") & near)
    pairs = written(_ordered(rest.select(F.col("sid").alias("a"), "b")), "pairs")
    return components(links.union(_verified(pairs, sets_of)))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, class_id, component_id) of every row; component_id is the smallest id that near copies reach, rid names id and text.

    Every set has a SimHash of BITS bits and, in each of several tables, a nearest reference fingerprint by Hamming
    distance, in which bits weigh their margins. Sets that have the same nearest ones in all tables of a key are
    candidates. Of these go the pairs whose sizes, whose distances to PIVOTS reference fingerprints, or whose fingerprints
    differ too much; the survivors are verified on their whole sets.

    Texts are compared in lower case (ASCII). Texts with equal sets are compared once; those without words are equal, null
    ones among them. A null id takes its class's smallest id; a class of null ids alone has a null one. Repeated rows
    are kept as rows; an empty table gives none. Further columns are ignored.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(row_id("doc_id", "text").alias("rid"), "doc_id", "text")
    found = _signatures(rows, Reader(*tables_for(docs.count()))).withColumn("uid", F.monotonically_increasing_id())
    found = written(found, "signatures")
    distinct = found.groupBy("sid").agg(F.min("doc_id").alias("first"), F.min("uid").alias("uid"))
    one = written(found.join(distinct.select("uid"), "uid").select("sid", "rid", "n", "bits", "fine", "pivots", "keys"), "distinct")
    each = one.select("sid", F.explode("keys").alias("key"))
    many = each.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    members = written(each.join(many, "key").join(one.select("sid", F.struct("n", "bits", "pivots").alias("s")), "sid"), "members")
    names = one.select("sid", "rid")

    def sets_of(sids: DataFrame) -> DataFrame:
        wanted = written(sids.distinct().join(names, "sid"), "wanted")
        held = rows.select("rid", "text").join(F.broadcast(wanted) if wanted.count() <= SENT else wanted, "rid")
        return _sets(held.select("sid", "text"))

    roots = set_links(members, one.select("sid", "n", "bits", "pivots", "fine"), sets_of).withColumnRenamed("node", "sid")
    classes = distinct.select("sid", "first").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.select("rid", "doc_id", "sid").join(classes.join(smallest, "root").select("sid", F.col("root").alias("class_id"), "component_id"), "sid").select("rid", "doc_id", "class_id", "component_id")
