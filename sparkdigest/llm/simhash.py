"""SimHash near-duplicates with pivot distance tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdigest.llm.common import pick, raw, released, row_id, small, written
from sparkdigest.llm.components import components

#: Links join fingerprints at so many differing bits or fewer.
MAX_BITS = 2
#: Blocks of a fingerprint; two fingerprints within MAX_BITS agree on at least BLOCKS - MAX_BITS of them.
BLOCKS = 4
WIDTH = 64 // BLOCKS
#: Reference fingerprints for each block, besides the one of all zeros.
PIVOTS = 12
#: Rows up to which their names are sent to every task, 16 bytes each.
SENT = 500_000
#: Members of a candidate class up to which its pairs are compared one by one; larger classes go by flipped bits.
PAIRED = 48

_rng = np.random.Generator(np.random.PCG64(64))
#: The reference fingerprints by block: ones in that block only.
TABLE = [[int(p) << (WIDTH * b) for p in _rng.choice(np.arange(1, 1 << WIDTH), PIVOTS, replace=False)] for b in range(BLOCKS)]
_LANES = np.array([sum(1 << (8 * k) for k in range(8) if i >> k & 1) for i in range(256)], np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned fingerprint of one text: a bit is 1 if over half of the shingle hashes set it; no words give 0."""
    v = raw(text).lower().split()
    if not v:
        return 0
    grams = map(b" ".join, zip(*(v[i:] for i in range(words)), strict=False)) if len(v) >= words else [b" ".join(v)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in grams], np.uint64)
    lanes = _LANES[h.view(np.uint8).reshape(-1, 8)]
    counts = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(rid, doc_id, fp) of every row; fp is the fingerprint as a signed long, rid names id and text. Whole texts, one pass, no shuffle."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(row_id("doc_id", "text").alias("rid"), "doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fp = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["rid", "doc_id", "fp"])

    return rows.mapInArrow(run, f"rid binary, doc_id {kind}, fp bigint")


def _distances(fp: str, b: int) -> list:
    """Distances from the column to the pivots of block b."""
    return [F.bit_count(F.col(fp).bitwiseXOR(F.lit(p - (1 << 64) if p >> 63 else p))) for p in TABLE[b]]


def _table_key(fp: str, pair: tuple[int, ...]):
    """What the pivot table shows of those blocks alone: distances less the distance to the pivot of all zeros."""
    zero = F.bit_count(F.col(fp))
    return F.xxhash64(F.lit(sum(1 << b for b in pair)), *[d - zero for b in pair for d in _distances(fp, b)])


def _near(a: str, b: str):
    """The pivot test (no coordinate of the two tables differs by more than MAX_BITS), then the real distance."""
    test = F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS
    for block in reversed(range(BLOCKS)):
        for x, y in zip(_distances(a, block), _distances(b, block), strict=True):
            test = (F.abs(x - y) <= MAX_BITS) & test
    return test


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fps(fp) within MAX_BITS.

    Every fingerprint has a row of distances to fixed pivots. Two within MAX_BITS differ by MAX_BITS at most in every
    coordinate, and in at least BLOCKS - MAX_BITS blocks every block coordinate is equal: classes of equal block
    coordinates hold all pairs, found by an equality join in place of comparing all rows with all. A class of up to
    PAIRED members is compared pair by pair: pivot test, then real distance. A larger class (thousands of near copies)
    takes an exact linear way: two fingerprints within 2 bits have a common neighbour at most 1 bit from both, so each
    one is listed under itself and its 1-bit neighbours outside the agreed blocks, and all under one neighbour are
    within 2 bits and linked to the smallest.
    """
    pairs = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    keyed = fps.select("fp", F.posexplode(F.array(*[_table_key("fp", p) for p in pairs])).alias("pair", "k"))
    sizes = keyed.groupBy("k", "pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["k", "pair"]), "classes")
    few = shared.where(F.col("n") <= PAIRED)
    left, right = few.select("k", "pair", F.col("fp").alias("a")), few.select("k", "pair", F.col("fp").alias("b"))
    close = left.join(right, ["k", "pair"]).where("a < b").where(_near("a", "b")).select("a", "b")
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for b in range(BLOCKS) if b not in p for i in range(WIDTH * b, WIDTH * (b + 1))]) for p in pairs])
    under = shared.where(F.col("n") > PAIRED).select("k", "pair", "fp", F.explode(flips[F.col("pair")]).alias("flip")).select("k", "pair", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    balls = under.groupBy("k", "pair", "v").agg(F.collect_list("fp").alias("all")).where("size(all) > 1").select(F.array_min("all").alias("b"), F.explode("all").alias("a")).where("a <> b").select("a", "b")
    return close.union(balls).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(rid, doc_id, fp, class_id, component_id) of every row; component_id is the smallest id that links of MAX_BITS reach.

    Null text counts as empty: its fingerprint is zero and it links like any other. Repeated rows and exact copies share a
    fingerprint, which is compared once. A null id is kept and takes its class's smallest id; a class of null ids
    alone has a null one; class_id, its smallest fingerprint, always names it. Further columns are ignored; an empty table gives no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    classes = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(classes.join(smallest, "root").select("fp", F.col("root").alias("class_id"), "component_id"), "fp").select("rid", "doc_id", "fp", "class_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that come first in their near-duplicate class; see keep_first()."""
    return keep_first(docs, lambda: near_duplicates(docs, id_col, text_col), id_col, text_col)


def keep_first(docs: DataFrame, find: Callable[[], DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, all columns, for each class of find() -> (rid, doc_id, class_id): that of the smallest id, then rid.

    Classes and not ids decide: texts of one id that are no near copies all stay, and null ids come last. Of repeated
    rows (same id and text) one stays. Null and empty texts are one class. An empty table gives no rows; columns of docs
    may have any name.
    """
    found = released(lambda: find().select("rid", "doc_id", "class_id"), "near")
    first = found.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")).select("first.rid")
    times = found.groupBy("rid").agg(F.count(F.lit(1)).alias("times")).join(first.withColumn("first", F.lit(True)), "rid", "left")
    # what goes, and rows that are repeated: few as a rule, and then no text is exchanged
    apart = written(times.where("first is null or times > 1").select("rid", "first"), "apart")
    n = apart.count()
    sent = F.broadcast if n <= SENT else lambda x: x
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id(id_col, text_col).alias("rid"))
    out = rows.join(sent(apart.select("rid")), "rid", "left_anti").select("row")
    again = apart.where("first").select("rid")
    if not again.isEmpty():
        out = out.union(rows.join(sent(again), "rid", "left_semi").groupBy("rid").agg(F.first("row").alias("row")).select("row"))
    return out.select("row.*")
