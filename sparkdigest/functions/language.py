"""Language of texts by hashed letter n-grams: words, profiles and sums by DataFrame functions, the words' numbers by numpy.

A word gives two features, its first and its last three signs, with ^ before and $ after it; each is a number below BUCKETS. A
language's profile holds the log probability of each bucket in its texts. A text has the language with the greatest sum over
its features, and the margin, per feature, to the next one says how sure that is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of n-grams of up to three signs: a prime, as signs are digits of a number in base BASE.
BUCKETS, BASE = 4093, 131
#: Pseudo-count of each bucket in a profile.
PRIOR = 0.5
#: Languages at most, so that the profiles, 32 KB each, stay small enough to go to every task.
MOST = 200


def words(text: Column) -> Column:
    """Runs of letters in lower case; null texts have none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))


#: Texts whose code points a worker holds at once.
TEXTS = 256


def buckets(text: str) -> np.ndarray:
    """Buckets of the n-grams of words with one space between them, first ones before last ones."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    space = codes == ord(" ")
    start, end = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:])
    second, before = np.where(space, 0, codes)[start + 1], codes[end - 1]
    first = ((ord("^") * BASE + codes[start]) * BASE + second) % BUCKETS
    last = np.where(start == end, (codes[end] * BASE + ord("$")) * BASE, (before * BASE + codes[end]) * BASE + ord("$")) % BUCKETS
    return np.concatenate([first, last]).astype(np.int32)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _buckets(texts: pa.Array) -> pa.Array:
    parts: list[pa.Array] = []
    for at in range(0, len(texts), TEXTS):
        found = [buckets(t) for t in texts[at : at + TEXTS].to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        parts.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found))))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def features(text: Column) -> Column:
    """Buckets of the n-grams of a text, first ones before last ones."""
    return _buckets(F.concat_ws(" ", words(text)))


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row: languages (in order) and weights, for each of them the log probabilities of all buckets.

    N-grams are counted in each task before they are shuffled: BUCKETS rows a language and task at most. Rows without a language
    are left out. More than MOST languages are refused."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(features(F.col(text_col))).alias("b"))
    counts = known.groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    every = totals.select("lang", "total", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))).alias("b"))
    weight = F.log((F.coalesce("n", F.lit(0)) + PRIOR) / (F.col("total") + PRIOR * BUCKETS))
    rows = every.join(counts, ["lang", "b"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("b", weight.alias("w")))).alias("w"))
    listed = F.array_sort(F.collect_list(F.struct("lang", F.transform("w", lambda x: x["w"]).alias("w"))))
    found = rows.agg(listed.alias("p"))
    few = F.when(F.size("p") <= MOST, F.col("p")).otherwise(F.raise_error(F.lit(f"more than {MOST} languages")))
    return found.select(F.transform(few, lambda x: x["lang"]).alias("languages"), F.transform(few, lambda x: x["w"]).alias("weights"))


def detected(docs: DataFrame, profile: DataFrame, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """docs with detected (null for a text without letters or with a margin under `least`) and margin, the gain per feature over
    the next language (null where there is no other). profile is profiles(); it goes to each task as a value, so nothing is
    shuffled. Ties go to the first language in order. The names detected, margin and columns of docs that end in __ are taken."""
    one = profile.select(F.struct("languages", "weights").alias("p")).scalar()
    scored = docs.withColumn("profile__", one).withColumn("features__", features(F.col(text_col)))
    sums = F.transform(F.col("profile__.weights"), lambda w: F.aggregate("features__", F.lit(0.0), lambda a, b: a + F.get(w, b)))
    ranked = F.sort_array(F.transform(sums, lambda s, k: F.struct(s.alias("s"), (-k).alias("k"))), asc=False)
    n = F.size("features__")
    scored = scored.withColumn("ranked__", F.when(n > 0, ranked))
    margin = (F.get("ranked__", F.lit(0))["s"] - F.get("ranked__", F.lit(1))["s"]) / n
    sure = F.coalesce(margin, F.lit(float("inf"))) >= least
    language = F.get(F.col("profile__.languages"), -F.get("ranked__", F.lit(0))["k"])
    return scored.withColumn("detected", F.when(sure, language)).withColumn("margin", margin).drop("profile__", "features__", "ranked__")
