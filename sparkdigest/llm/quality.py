"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdigest.llm.common import pick, written

WHITE = r"[\x20\x09-\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Bits that name a bucket of hashed n-grams, the same for every corpus, so that a text's score doesn't change with the number of
#: texts beside it; the table of their ratios, 512 KB, goes to every task.
BITS = 16
#: Trusted ids up to which they are sent to every task, 8 bytes each; beyond, documents and ids are dealt by id.
SENT = 1_000_000
#: Pseudo-counts of the target for each bucket, dealt out as the raw counts are.
PRIOR = 0.5
#: A document stays if its mean log ratio per n-gram is at least this.
THRESHOLD = -0.2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def hashes_of(words: Column) -> Column:
    """64 bits of each word: strings are read once, all that follows compares and hashes numbers."""
    return F.transform(words, lambda x: F.xxhash64(x))


def repeated_words(hashes: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the text, the first included; hashes are those of its words.

    Windows are sorted by a hash with their places; those with an equal neighbour are repeated, and the words that they
    cover are counted along their places.
    """

    def by_order(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        key = lambda h, i: h(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        return let(F.transform(starts, lambda i: key(F.xxhash64, i)), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), key(F.hash, i).alias("g"), i.alias("i")))), covered)))

    def covered(s: Column) -> Column:
        same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["g"] == y["g"]), F.lit(False))
        again = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(places, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]

    return F.when(F.size(hashes) < 4, F.lit(0).cast("long")).otherwise(by_order(hashes))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    # trimming ends at the first word, where taking white space out would go on to the end
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: Column | None = None) -> DataFrame:
    """(doc_id, text, n_words, n_repeat_words, word_chars, n_symbols, n_dup_lines, base_failed) of every row.

    With ratios (a log ratio for each of 2**BITS buckets), score is the mean of the text's n-grams. Words are split and
    hashed once for all of it.
    """
    d = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    of_words = [lambda w, s: F.size(w).cast("long").alias("n_words"), lambda w, s: repeated_words(w).alias("n_repeat_words")]
    if ratios is not None:
        d = d.withColumn("ratios", ratios)
        of_words.append(lambda w, s: mean_ratio(w, s, F.col("ratios")).alias("score"))
    return d.select(
        "doc_id",
        "text",
        _hashed(text, lambda w, s: F.struct(*[f(w, s) for f in of_words])).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.size(F.split(text, f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
        duplicate_lines(text).alias("n_dup_lines"),
    ).select("doc_id", "text", "w.*", "word_chars", "n_symbols", "n_dup_lines").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def shapes_of(text: Column) -> Column:
    """The words' shapes: runs of small or caseless letters, capitals and digits become one sign each.

    The small letters go first: what the later patterns read is then a fraction of the text.
    """
    for pattern, sign in ((r"[\p{Ll}\p{Lo}]+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "9")):
        text = F.regexp_replace(text, pattern, sign)
    return words_of(text)


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def _at(w: Column, s: Column, x: Column, i: Column) -> tuple[Column, Column, Column]:
    """Buckets of word i of w, of it and the next, and of their shapes in s and whether they are equal."""
    after = F.get(w, i + 1)
    return _bucket(x), _bucket(F.xxhash64(F.lit(2), x, after)), _bucket(F.xxhash64(F.lit(3), F.get(s, i), F.get(s, i + 1), x == after))


def _hashed(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    """body of the hashes of a text's words and of their shapes."""
    return let(F.struct(hashes_of(words_of(text)).alias("w"), hashes_of(shapes_of(text)).alias("s")), lambda v: body(v["w"], v["s"]))


def grams(text: Column) -> Column:
    """Buckets of a text's n-grams: words, pairs of words, and pairs of word shapes that say if the words are equal."""

    def of(w: Column, s: Column) -> Column:
        pairs = F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))
        return F.concat(F.transform(w, lambda x, i: _at(w, s, x, i)[0]), F.transform(pairs, lambda x, i: _at(w, s, x, i)[1]), F.transform(pairs, lambda x, i: _at(w, s, x, i)[2]))

    return _hashed(text, of)


def _gram_rows(d: DataFrame) -> DataFrame:
    """(good, bucket): a row for each of grams() of d(good, text). Made from a row for each word, as Spark compiles what it does with
    rows, but interprets functions over arrays."""
    text = F.col("text")
    words = d.select("good", hashes_of(words_of(text)).alias("w"), hashes_of(shapes_of(text)).alias("s")).select("good", "w", "s", F.posexplode("w").alias("i", "x"))
    one, two, three = _at(F.col("w"), F.col("s"), F.col("x"), F.col("i"))
    last = F.col("i") + 1 == F.size("w")
    return words.select("good", F.explode(F.when(last, F.array(one)).otherwise(F.array(one, two, three))).alias("bucket"))


def mean_ratio(w: Column, s: Column, ratios: Column) -> Column:
    """Mean of the log ratios of n-grams of hashed words w and shapes s, 0 without words."""
    n = F.size(w)

    def worth(x: Column, i: Column) -> Column:
        one, two, three = (F.get(ratios, b) for b in _at(w, s, x, i))
        return one + F.when(i + 1 < n, two + three).otherwise(0.0)

    total = F.aggregate(F.transform(w, worth), F.lit(0.0), lambda a, v: a + v)
    return total / F.greatest(3 * n - 2, F.lit(1))


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: an array of 2**BITS log ratios of the trusted target's multinomial to the raw corpus's.

    Raw counts are of all documents, target counts of all whose id is in trusted(doc_id). N-grams are counted in each
    task before they are shuffled, at most 2**BITS rows a task.
    """
    spark = docs.sparkSession
    good = written(pick(trusted, id_col).toDF("doc_id").where("doc_id is not null").distinct(), "trusted").withColumn("good", F.lit(1))
    d = pick(docs, id_col, text_col).toDF("doc_id", "text").join(F.broadcast(good) if good.count() <= SENT else good, "doc_id", "left")
    each = _gram_rows(d.withColumn("text", F.coalesce("text", F.lit(""))))
    counts = written(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("good").alias("target")), "counts")
    sums = counts.select(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target"))
    every = spark.range(1 << BITS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    share = F.col("raw") / F.col("all_raw")
    prior = PRIOR * (1 << BITS)
    ratio = F.coalesce(F.log((F.col("target") + prior * share) / (F.col("all_target") + prior) / share), F.lit(0.0))
    table = every.join(F.broadcast(sums)).select("bucket", ratio.alias("ratio"))
    return table.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"]).alias("ratios"))


def judge(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """rules() without the text, with score (mean log ratio per n-gram; 0 without words) and kept.

    kept is false if base_failed, else whether score >= threshold, for every row by the same rule. Null text has no words
    and fails; without trusted rows every ratio is 0 and all that pass the rules stay. Null ids, repeated rows and empty
    tables pass through; further columns are ignored.
    """
    ratios = written(log_ratios(docs, trusted, id_col, text_col), "ratios").scalar()
    found = rules(docs, id_col, text_col, ratios).drop("text")
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))

