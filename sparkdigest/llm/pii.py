"""Personal data: patterns, and terms that reveal them, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdigest.llm.common import pick, released, row_id, written
from sparkdigest.llm.quality import let, words_of

# The kinds in their order. Runs are possessive and begin where a run begins or the last match ended,
# which finds the same leftmost matches in linear time and without recursion.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The kind of the spans that the method adds.
TERM = "term"
#: Share of an entity's information that a term may give away: at this share or more it goes.
DISCLOSURE = 0.9
#: Different lines, and different surroundings (word before, word after), of a term in an entity's documents.
SUPPORT = 3

#: Spans up to which they are sent to every task, some 60 bytes each; beyond, texts are dealt to them.
SENT = 200_000

_SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _valid(kind: str) -> Callable[[Column], Column]:
    return lambda span: _holds(kind, span["value"])


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) <= 3) & (F.when(q == "", "0").otherwise(F.left(q, F.lit(3))).cast("int") <= 255)))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    # Luhn: from the right, every second digit doubled, the digits of the doubles added
    odd = lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    total = lambda x: F.aggregate(F.transform(F.split(F.reverse(x), ""), lambda c, i: odd(c.cast("int"), i)), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return F.length(digits).between(13, 19) & (let(F.left(digits, F.lit(19)), total) % 10 == 0)


def places(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern with their places (code points), as _SPAN."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def of(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

        def step(a: Column, k: Column) -> Column:
            begin = a["at"] + F.length(F.get(x["gaps"], k))
            value = F.get(x["found"], k)
            end = begin + F.length(value)
            return F.struct(end.alias("at"), F.concat(a["spans"], F.array(F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), value.alias("value")))).alias("spans"))

        return F.aggregate(F.sequence(F.lit(0), F.size(x["found"]) - 1), start, step)["spans"]

    none = F.array().cast(f"array<{_SPAN}>")
    return let(F.struct(found.alias("found"), gaps.alias("gaps")), lambda x: F.when(F.size(x["found"]) == 0, none).otherwise(of(x)))


def base_spans(text: Column) -> dict[str, Column]:
    """The valid matches of each kind, in order."""
    signs = {"email": "@", "ip": ".", "card": None, "phone": "+"}
    none = F.array().cast(f"array<{_SPAN}>")
    out = {}
    for kind, pattern in PATTERNS.items():
        # a card needs 13 digits; the other kinds their sign
        may = F.contains(text, F.lit(signs[kind])) if signs[kind] else text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")
        out[kind] = F.when(may, F.filter(places(text, pattern, kind), _valid(kind))).otherwise(none)
    return out


#: What entities of a kind have in common besides it: an email's domain, an address's network, a card's issuer, a number's region.
POOLS = {"email": (r"^.*@", ""), "ip": (r"\.[0-9]+$", ""), "card": (r"^([0-9]{6}).*$", "$1"), "phone": (r"^([0-9]{4}).*$", "$1")}


def _pooled(span: Column) -> Column:
    """The names under which an entity counts: its value, its pool and its kind."""
    kind, value = span["kind"], F.lower(span["value"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    pool = F.coalesce(*[F.when(kind == k, F.regexp_replace(value if k in ("email", "ip") else digits, *how)) for k, how in POOLS.items()])
    return F.array(F.concat_ws(":", kind, value), F.concat_ws("~", kind, pool), kind)


def _contexts(found: DataFrame) -> DataFrame:
    """(uid, entities, values, text) of each row with protected entities: the whole text is their context."""
    return found.where("size(spans) > 0").select("uid", F.array_distinct(F.flatten(F.transform("spans", _pooled))).alias("entities"), F.array_distinct(F.transform("spans", lambda s: s["value"])).alias("values"), "text")


def _lines(text: Column, terms: Column) -> Column:
    """The lines that hold a term, with their places."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,line:string>>").alias("all"))

    def step(a: Column, line: Column) -> Column:
        end = a["at"] + F.length(line)
        return F.struct((end + 1).alias("at"), F.when(F.arrays_overlap(words_of(line), terms), F.concat(a["all"], F.array(F.struct(a["at"].alias("start"), line.alias("line"))))).otherwise(a["all"]).alias("all"))

    return F.aggregate(F.split(text, "\n"), start, step)["all"]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(rid, doc_id, email, ip, card, phone, terms) of every row: arrays of spans of the whole text.

    rid names the row's id and text. The four kinds are the valid matches of PATTERNS. terms are words that reveal a
    protected entity. An entity is a value of the four kinds, and also its pool (POOLS) and its kind, so that values
    that stand in one document alone are judged together. Its context is every document that holds it: its information
    is -log2 p(context), what a term reveals of it is the pointwise mutual information log2 p(term, context) / (p(term)
    p(context)), both counted over documents. A term that reveals at least `disclosure` of the information is a span
    wherever it stands in a document of the entity, if it was seen in at least `support` different lines and between as
    many different pairs of words of the context: copies of a line or of a passage are one witness, not many.

    Null text counts as empty. Null ids, repeated rows and empty tables pass through; further columns are ignored.
    """
    d = pick(docs, id_col, text_col).toDF("doc_id", "text").select(row_id("doc_id", "text").alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    based = d.select("rid", "doc_id", text, F.struct(*[v.alias(k) for k, v in base_spans(text).items()]).alias("b"))
    based = based.select("rid", "doc_id", "text", let(F.col("b"), lambda b: F.struct(b.alias("b"), F.concat(*[b[k] for k in PATTERNS]).alias("spans"))).alias("b"))
    found = written(based.select(F.monotonically_increasing_id().alias("uid"), "rid", "doc_id", "b.b.*", "b.spans", F.when(F.size("b.spans") > 0, text).alias("text")), "spans")

    tokens = let(words_of(F.col("line")), lambda w: F.transform(w, lambda x, k: F.struct(x.alias("term"), F.coalesce(F.get(w, k - 1), F.lit("")).alias("before"), F.coalesce(F.get(w, k + 1), F.lit("")).alias("after"))))
    held = _contexts(found)
    # counted before any join: a task shuffles a row for each of its words
    counts = d.select(F.explode(F.array_distinct(words_of(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("times"))
    total = written(d.agg(F.count(F.lit(1)).alias("total")), "total").scalar()
    # What no term of an entity can lack: `support` places in documents with entities, and p(context | term) of at least
    # p(context) ** (1 - disclosure), which is least for one document. Only such terms meet single entities.
    inside = held.select(F.explode(F.array_distinct(words_of(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("inside"))
    often = held.select(F.explode(words_of(text)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") >= support)
    least = F.pow(total.cast("double"), F.lit(disclosure - 1.0)) * F.col("times") * (1 - 1e-9)
    may = written(often.join(inside, "term").join(counts, "term").where(F.col("inside") >= least).select("term", "times"), "may")
    some = held.select("uid", F.explode(F.array_distinct(words_of(text))).alias("term")).join(may, "term").groupBy("uid").agg(F.collect_list("term").alias("some"))
    held = written(held.join(some, "uid"), "held")

    near = held.select("uid", "entities", "values", "some", F.explode(F.split("text", "\n")).alias("line")).select("uid", "entities", "values", F.xxhash64("line").alias("line"), F.explode(F.filter(tokens, lambda t: F.array_contains("some", t["term"]))).alias("t"))
    near = near.where(~F.exists("values", lambda v: F.contains(v, F.col("t.term")) | F.contains(F.col("t.term"), v)))
    near = near.select("uid", "line", "t.term", F.xxhash64("t.before", "t.after").alias("pair"), F.explode("entities").alias("entity"))
    # witnesses first: copies of a line, however many, then are one row
    seen = near.groupBy("entity", "term", "line", "pair").agg(F.lit(1).alias("n")).groupBy("entity", "term").agg(F.least(F.count_distinct("line"), F.count_distinct("pair")).alias("seen")).where(F.col("seen") >= support)
    both = near.select("uid", "entity", "term").distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    sizes = _contexts(found).select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("context"))
    pairs = written(both.join(seen, ["entity", "term"]).join(sizes, "entity"), "pairs")
    counted = pairs.join(may, "term").withColumn("total", total)
    counted = counted.withColumn("information", -F.log2(F.col("context") / F.col("total"))).withColumn("revealed", F.log2(F.col("both") * F.col("total") / (F.col("context") * F.col("times"))))
    bad = written(counted.where((F.col("information") > 0) & (F.col("revealed") >= F.lit(disclosure) * F.col("information"))).select("entity", "term"), "disclosing")

    words = held.select("uid", "entities", F.explode("some").alias("term"))
    terms = words.select("uid", "term", F.explode("entities").alias("entity")).join(bad, ["entity", "term"]).groupBy("uid").agg(F.collect_set("term").alias("terms"))
    lines = held.join(terms, "uid").select("uid", "terms", F.explode(_lines(text, F.col("terms"))).alias("l"))
    at = F.filter(places(F.col("l.line"), r"[^\x20\x09-\x0D]+", TERM), lambda s: F.array_contains("terms", s["value"]))
    spans = lines.select("uid", F.transform(at, lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + F.col("l.start")).alias("start"), (s["end"] + F.col("l.start")).alias("end"), s["value"].alias("value"))).alias("s"))
    spans = written(spans.groupBy("uid").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("terms")), "terms")
    return found.join(spans, "uid", "left").select("rid", "doc_id", *PATTERNS, F.coalesce("terms", F.array().cast(f"array<{_SPAN}>")).alias("terms"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first and longest stays."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        new = F.struct(s["end"].alias("at"), F.concat(a["parts"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"))
        return F.when(s["start"] < a["at"], a).otherwise(new)

    rest = lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(order, start, step, rest))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """docs with every span of find() generalised to its kind; rows without one stay as they are.

    Null and empty texts, null ids and repeated rows stay as rows of their own; an empty table gives no rows. Columns of
    docs may have any name.
    """
    place = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    spans = F.transform(F.concat(*PATTERNS, "terms"), place)
    held = released(lambda: find(docs, id_col, text_col, disclosure, support).select("rid", spans.alias("spans")).where("size(spans) > 0").dropDuplicates(["rid"]), "held")
    few = (held.agg(F.sum(F.size("spans") + 1)).first()[0] or 0) <= SENT
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_id(id_col, text_col).alias("rid"), F.col(f"`{text_col}`").alias("text"))
    both = rows.join(F.broadcast(held) if few else held, "rid", "left").withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(sanitised(F.col("text"), F.col("spans"))))
    return both.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
