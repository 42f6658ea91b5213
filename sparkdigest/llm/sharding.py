"""Shards of bounded size by extendible hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdigest.llm.common import pick, written

#: Hash bits looked at in one pass over the sums; deeper buckets take another pass.
STEP = 12
BITS = 60


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """(depth, prefix, bytes) of each bucket of sizes(h, bytes): the shortest prefixes whose rows fit the limit.

    A bucket of several rows that is too large splits on one more bit, and nothing else does. Sums by prefix are made for STEP depths at
    a time from sums by the longest of them, so a pass shuffles a row for each task and prefix. A pass looks only at
    what the passes before left too large; the bits end after BITS, where what still is too large stays one bucket.
    """
    left, out, depth = sizes, None, 0
    while True:
        to = min(BITS, depth + STEP)
        cells = left.select((F.shiftright("h", BITS - to)).alias("cell"), "bytes").groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
        cells = written(cells, "cells")
        each = cells.select(F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("cell", to - d).alias("prefix")) for d in range(depth, to + 1)])).alias("x"), "bytes", "n")
        sums = written(each.groupBy("x.depth", "x.prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "sums")
        full = (F.col("bytes") > limit) & (F.col("n") > 1)
        ends = ~full | (F.col("depth") == BITS)
        parents = sums.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"), full.alias("split"))
        fits = sums.where(ends).join(parents, ["depth", "prefix"], "left").where((F.col("depth") == depth) | F.col("split"))
        if depth:  # the first depth of a later pass was too large in the pass before
            fits = fits.where(F.col("depth") > depth)
        fits = fits.select("depth", "prefix", "bytes")
        out = fits if out is None else out.union(fits)
        large = sums.where((F.col("depth") == to) & full).select(F.col("prefix").alias("cell"))
        if to == BITS or large.isEmpty():
            return out
        left = left.withColumn("cell", F.shiftright("h", BITS - to)).join(large, "cell", "left_semi").select("h", "bytes")
        depth = to


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bytes, hash, depth, shard_id, shard_bytes) of every row; no shard holds more than `limit` bytes of text.

    The hash is of the id, so a row's shard doesn't hang on its place in the input. Shards are buckets of extendible
    hashing: depth is the number of hash bits that the bucket needed, and shard_id is these bits with a 1 before them, which
    names depth and bits. Rows that share an id (repeated rows, null ids) share a bucket that no bit divides: they are
    told apart by further hashes of the text, and where the text is the same, too, of a number given to the row, kept
    in the written table. A single text above the limit is a shard of its own. Null text has 0 bytes. An empty table
    gives no rows; further columns are ignored.
    """
    d = pick(docs, id_col, text_col).toDF("doc_id", "text")
    mask = (1 << BITS) - 1
    cut = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(mask))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(d.select("doc_id", F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("t"), F.monotonically_increasing_id().alias("n")), "sizes")
    # ids that more than one row has: their rows hash by id, text and number
    twice = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("doc_id").alias("id2"), F.lit(True).alias("again"))
    twice = written(twice, "twice")
    rows = rows.join(twice, F.col("doc_id").eqNullSafe(F.col("id2")), "left") if not twice.isEmpty() else rows.withColumn("again", F.lit(None).cast("boolean"))
    hashed = written(rows.select("doc_id", "bytes", F.when(F.col("again"), cut(F.lit(1), "doc_id", "t", "n")).otherwise(cut("doc_id")).alias("h")), "hashed")
    found = written(directory(hashed.select("h", "bytes"), limit), "directory")
    depths = [r["depth"] for r in found.select("depth").distinct().collect()]
    # at most BITS + 1 depths: a row is in the one bucket that its prefixes name
    keyed = hashed.withColumn("p", F.explode(F.array(*[F.struct(F.lit(k).alias("depth"), F.shiftright("h", BITS - k).alias("prefix")) for k in sorted(depths)]))) if depths else hashed.withColumn("p", F.struct(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix")))
    both = keyed.select("doc_id", "bytes", "h", "p.depth", "p.prefix").join(found.withColumnRenamed("bytes", "shard_bytes"), ["depth", "prefix"])
    shard = F.col("prefix") + F.element_at(F.array(*[F.lit(1 << k) for k in range(BITS + 1)]), F.col("depth") + 1)
    return both.select("doc_id", "bytes", F.col("h").alias("hash"), "depth", shard.alias("shard_id"), "shard_bytes")
