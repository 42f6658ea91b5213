"""Spelling variants by anagram hashing: words whose letters add up to keys that differ by one letter are compared.

The key of a word is the sum of a power of each letter's code, so it doesn't depend on their order. A word is listed under the
keys that are left when one letter goes. Two words that differ by an exchanged letter share such a key; a word with a letter
more shares it with the whole key of the other. As an edit lies in one quarter of a word, the three others equal letter by
letter are part of what is joined, so that anagrams of whole words, of which there are many, don't meet. What meets is then
verified by edit distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdigest.llm.common import pick, released, written

#: The power of letters' codes, and the prime that sums are taken modulo, so that they never overflow.
POWER, PRIME = 5, (1 << 61) - 1
#: Parts of a word, in one of which an edit lies.
PARTS = 4
#: Letters of words: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "[A-Za-zÀ-ÿ]+"
#: A run of letters is damaged if this divides its number.
DAMAGE = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form has this many times the occurrences of the word at least.
RATIO = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word) of every run of letters: A-Z in lower case, without the letter that damage deletes: with h the crc32 of
    `<id>:<run>`, where DAMAGE divides h, the one at h modulo the length. Null texts have none; a null id is empty there."""
    own = pick(df, id_col, text_col).toDF("id", "text")
    found = own.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"({LETTERS})"), F.lit(1))).alias("run"))
    small = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", _UPPER, _LOWER))
    found = found.select("id", small.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame) -> DataFrame:
    """(word, n): distinct words of LEAST_LENGTH letters or more that occur LEAST_COUNT times or more."""
    counted = words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(POWER - 1):
        out = out * code
    return out


def _sum(letters: Column) -> Column:
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, x: (a + _power(x)) % PRIME)


def _bound(length: Column, part: Column | int) -> Column:
    """Letters before a part of a word of this length."""
    return F.floor(length * part / PARTS).cast("int")


def _listed(words: DataFrame) -> DataFrame:
    """(key, rest, part, whole, word, n): rest stands for the length and the letters outside a part, key for all letters of the
    word (whole) or for all but one of the part. Length, part and bounds are those without that letter."""
    word, part = F.col("word"), F.col("part")
    own = words.withColumns({"all": _sum(F.split(word, "")), "long": F.length(word)})
    each = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part")

    def rest(length: Column, more: int) -> Column:
        start, end = _bound(length, part), _bound(length, part + 1)
        return F.xxhash64(length, part, F.left(word, start), F.substring(word, end + 1 + more, F.col("long")))

    kept = own.select("word", "n", "all", "long", each)
    kept = kept.select(F.col("all").alias("key"), rest(F.col("long"), 0).alias("rest"), "part", F.lit(True).alias("whole"), "word", "n")
    less = F.col("long") - 1
    start, end = _bound(less, part), F.when(part == PARTS - 1, F.col("long")).otherwise(_bound(less, part + 1))
    inside = F.array_distinct(F.filter(F.split(F.substring(word, start + 1, end - start), ""), lambda x: x != ""))
    cut = own.select("word", "n", "all", "long", each).select("*", F.explode(inside).alias("letter"))
    key = F.pmod(F.col("all") - _power(F.col("letter")), F.lit(PRIME))
    return kept.union(cut.select(key, rest(less, 1), "part", F.lit(False), "word", "n"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of words(word, n) that differ by one inserted, deleted or replaced letter, each pair once."""
    listed = _listed(words)
    a, b = listed.alias("a"), listed.alias("b")
    # no broadcast: Spark judges the lists by the file of words, of which they are many times the size in memory
    met = a.join(b.hint("merge"), ["key", "rest"]).where("not a.whole and (b.whole or a.word < b.word)")
    # A letter that goes may be the same one in several parts: the pair counts in the part with the first difference.
    less = F.least(F.length("a.word") - 1, F.length("b.word"))
    end = _bound(F.when(F.col("b.whole"), F.length("b.word")).otherwise(less), F.col("a.part") + 1)
    first = (F.col("a.part") == PARTS - 1) | (F.left("a.word", end) != F.left("b.word", end))
    found = met.where(first & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    return found.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def _forms(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of all words."""
    pairs = near_pairs(words)
    both = F.explode(F.array(F.struct("word", "n", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    told = words.join(near.hint("merge"), "word", "left")
    often = -F.col("best.less") >= RATIO * F.col("n")
    return told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))


def _with_roots(forms: DataFrame) -> DataFrame:
    """forms with root: pointers double in each round, and as occurrences do so from form to form, 6 rounds are the most."""
    links = written(forms.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "links")
    while links.where("open").take(1):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = links.join(on.hint("merge"), "root", "left")
        links = written(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "links")
    return forms.join(links.select("word", "root").hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the vocabulary of all texts.

    n_near counts the words that differ by one letter; form is the most frequent of them (ties: the first in code-point order)
    if it occurs RATIO times as often, else null; root is the last word on the way from form to form, the word itself if it has
    none. Null and empty texts and an empty table give no words; repeated rows count again; further columns are left out."""

    def made() -> DataFrame:
        words = written(vocabulary(runs(df, id_col, text_col)), "words")
        return _with_roots(written(_forms(words), "forms"))

    return released(made, "variants")
