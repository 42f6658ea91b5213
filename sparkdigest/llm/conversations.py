"""Repair of the structure of conversations: faults by windows, cheapest edits by a fold over sorted turns.

Legal are a system turn at most, then user and assistant in turn: s?(ua)+, or nothing. aggregate() carries, for each of the four
states of that pattern, the cheapest (cost, audit) that ends in it; an audit names the edits in order, K keep, R rerole, D delete,
I insert. Long conversations are folded in segments of SEGMENT turn numbers, from each state that a segment may begin in, and a
second fold joins the segments, so that no array holds the texts of a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdigest.llm.common import pick, written

#: Costs of edits; KEPT_CUT is added for a truncated turn that stays.
REROLE, DELETE, INSERT, KEPT_CUT = 1, 2, 5, 5
#: Turn numbers of a segment.
SEGMENT = 256
#: White space of the contract, and ends of whole sentences.
SPACE, ENDS = " \t\n\x0b\x0c\r", [".", "!", "?"]
#: First letters of the roles that may follow each other.
LEGAL = ["su", "ua", "au"]
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_BEST = "struct<cost:bigint,audit:string>"
_JOINED = "struct<cost:bigint,audit:array<string>,begins:array<int>>"


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), damaged by crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes
    . ! ? out of it, 3 repeats the row, 4 makes its role user. A null counts as one space, in the number and in role and text."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    told = pick(df, "conv_id", "turn", "role", "text").withColumn("damage", F.crc32(key.cast("binary")) % 20).where("damage <> 0")
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return told.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """Rows in order, equal ones of a turn as one row with their number n, and what is wrong with the first of them: fault is
    blank, duplicate, truncated or null; those after it are blank or duplicate. segment and at (rows before it there) tell
    the place; prior is the first letter of the role before it in the segment."""
    runs = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    said = F.rtrim("text", F.lit(SPACE))
    fault = F.when(said == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(said, F.lit(1)).isin(ENDS), "truncated")
    found = runs.withColumn("seen", seen).withColumn("fault", fault).withColumn("segment", F.floor(F.col("turn") / SEGMENT)).withColumn("initial", F.substring("role", 1, 1))
    placed = Window.partitionBy("conv_id", "segment").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.sum("n").over(placed.rowsBetween(Window.unboundedPreceding, -1))
    return found.withColumns({"at": F.coalesce(before, F.lit(0)), "prior": F.lag("initial").over(placed)}).drop("seen")


def _then(best: Column, cost: Column | int, edit: Column | str) -> Column:
    """A state's best, one edit later; null if there is none."""
    edit = F.lit(edit) if isinstance(edit, str) else edit
    return F.when(best.isNotNull(), F.struct((best["cost"] + cost).alias("cost"), F.concat(best["audit"], edit).alias("audit")))


def _after(best: Column, turn: Column) -> Column:
    """The four states after a turn and its repetitions. Insertions come just before a turn that stays: before a deletion the
    same edits the other way round are less in ASCII, and at the end deleting what they would complete is cheaper."""
    start, system, user, assistant = (best[f"s{k}"] for k in range(4))
    to_user = F.least(user, *[_then(x, INSERT, "I") for x in (start, system, assistant)])
    to_assistant = F.least(assistant, _then(to_user, INSERT, "I"))
    more = F.when(turn["fault"] == "truncated", KEPT_CUT).otherwise(0)
    free = turn["fault"].isNull() | (turn["fault"] == "truncated")

    def stays(letter: str, *before: Column) -> list[Column]:
        own = turn["initial"] == letter
        edit, cost = F.when(own, "K").otherwise("R"), more + F.when(own, 0).otherwise(REROLE)
        return [F.when(free, _then(x, cost, edit)) for x in before]

    now = [
        _then(start, DELETE, "D"),
        F.least(_then(system, DELETE, "D"), F.when(free & (turn["initial"] == "s"), _then(start, more, "K"))),
        F.least(_then(user, DELETE, "D"), *stays("u", start, system, to_assistant)),
        F.least(_then(assistant, DELETE, "D"), *stays("a", to_user)),
    ]
    again = F.repeat(F.lit("D"), (turn["n"] - 1).cast("int"))
    return F.struct(*[_then(x, DELETE * (turn["n"] - 1), again).alias(f"s{k}") for k, x in enumerate(now)])


def _segments(turns: DataFrame) -> DataFrame:
    """A row for each segment: counts, first and last role, and for each state that it may begin in the four bests it ends with."""
    whole = turns.groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("at", "turn", "initial", "fault", "n"))).alias("turns"),
        F.min("turn").alias("least"),
        F.max("turn").alias("most"),
        F.sum((F.col("fault") == "blank").cast("long") * F.col("n")).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", F.col("n")).when(F.col("fault") == "blank", 0).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum((F.col("fault") == "truncated").cast("long")).alias("truncated"),
        F.sum(F.col("n") - 1 + (F.col("prior").isNotNull() & ~F.concat("prior", "initial").isin(LEGAL)).cast("long")).alias("illegal"),
    )
    distinct = F.size(F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"]), lambda x: x.isNotNull())))
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("segment").asc_nulls_first())) == 1
    begins = F.when(F.col("first"), F.array(F.lit(START))).otherwise(F.array(*map(F.lit, range(4))))
    nothing, none = F.lit(None).cast(_BEST), F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    fold = F.transform(
        begins, lambda b: F.aggregate("turns", F.struct(*[F.when(b == k, none).otherwise(nothing).alias(f"s{k}") for k in range(4)]), _after)
    )
    whole = whole.withColumns({"first": first, "distinct": distinct.cast("long")}).withColumn("ends", fold)
    return whole.withColumns({"head": F.col("turns")[0]["initial"], "tail": F.element_at("turns", -1)["initial"]}).drop("turns")


def _follow(best: Column, segment: Column) -> Column:
    """The four states after one more segment; audits stay one string a segment."""
    ends, now = segment["ends"], []
    for k in range(4):
        ways = []
        for b in range(4):
            way, was = F.get(ends, F.lit(b))[f"s{k}"], best[f"s{b}"]
            audit, begins = F.concat(was["audit"], F.array(way["audit"])), F.concat(was["begins"], F.array(F.lit(b)))
            joined = F.struct((was["cost"] + way["cost"]).alias("cost"), audit.alias("audit"), begins.alias("begins"))
            ways.append(F.when(was.isNotNull() & way.isNotNull(), joined))
        now.append(F.least(*ways).alias(f"s{k}"))
    return F.struct(*now)


def plans(turns: DataFrame) -> DataFrame:
    """A row for each conversation of flagged(): gaps, blank, duplicate, truncated, illegal, cost, audit, and pieces: for each
    segment its edits and the state it begins in."""
    own = F.sort_array(F.collect_list(F.struct("segment", "head", "tail", "ends")))
    found = _segments(turns).groupBy("conv_id").agg(
        own.alias("own"),
        F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("distinct"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
    )
    nothing = F.lit(None).cast(_JOINED)
    none = F.struct(F.lit(0).cast("long").alias("cost"), F.array().cast("array<string>").alias("audit"), F.array().cast("array<int>").alias("begins"))
    zero = F.struct(none.alias("s0"), *[nothing.alias(f"s{k}") for k in (1, 2, 3)])
    found = found.withColumn("best", F.aggregate("own", zero, _follow, lambda x: F.least(x["s0"], x["s3"])))
    bounds = F.zip_with(F.slice("own", F.lit(1), F.size("own") - 1), F.slice("own", F.lit(2), F.size("own") - 1), lambda a, b: F.concat(a["tail"], b["head"]))
    illegal = F.col("illegal") + F.size(F.filter(bounds, lambda x: ~x.isin(LEGAL)))
    pieces = F.transform("own", lambda s, k: F.struct(s["segment"].alias("segment"), F.col("best")["audit"][k].alias("edits"), F.col("best")["begins"][k].alias("begins")))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", illegal.alias("illegal"), F.col("best")["cost"].alias("cost"), F.array_join(F.col("best")["audit"], "").alias("audit"), pieces.alias("pieces"))


def repaired(turns: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, at, part, edit, role, text): the turns of repaired conversations; place, at and part give their order.

    From the first turn that isn't a kept system one, roles take turns: user, assistant, user ... The number of those before
    a turn tells the role of a turn that is inserted or gets another role."""
    pieces = planned.select(F.col("conv_id").alias("its_id"), F.posexplode("pieces").alias("place", "piece"))
    tokens = F.regexp_extract_all(F.col("piece.edits"), F.lit("(I*[DKR])"), F.lit(1))
    pieces = pieces.select("its_id", "place", F.col("piece.segment").alias("its_segment"), F.col("piece.begins").alias("begins"), tokens.alias("tokens"))
    told = turns.join(pieces, turns["conv_id"].eqNullSafe(pieces["its_id"]) & turns["segment"].eqNullSafe(pieces["its_segment"]))
    told = told.withColumn("token", F.translate(F.get("tokens", F.col("at").cast("int")), "D", "")).where("token <> ''")
    turning = F.length("token") - (F.col("token").endswith("K") & (F.col("initial") == "s")).cast("int")
    before = F.sum(turning).over(Window.partitionBy("conv_id", "segment").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    told = told.withColumn("turned", (F.col("begins") == USER).cast("long") + F.coalesce(before, F.lit(0)))
    parts = told.select("conv_id", "place", "at", "role", "text", "turned", F.posexplode(F.split("token", "")).alias("part", "edit")).where("edit <> ''")
    due = F.when((F.col("turned") + F.col("part")) % 2 == 0, "user").otherwise("assistant")
    role, text = F.when(F.col("edit") == "K", F.col("role")).otherwise(due), F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    return parts.select("conv_id", "place", "at", "part", "edit", role.alias("role"), text.alias("text"))


def repair(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans and repaired turns of the rows of df, which stay as they are.

    df(conv_id, turn, role, text); further columns are left out. Rows go by turn, nulls first, then role and text; equal rows
    are duplicates of the first. Roles and texts must not be null, as damaged() leaves them. A null conv_id is a conversation of
    its own. An empty table gives none."""
    turns = written(flagged(df), "turns")
    planned = written(plans(turns), "plans")
    return planned, repaired(turns, planned)


def audited(df: DataFrame) -> DataFrame:
    """A row for each conv_id of df, which is damaged first: counts, cost, audit, and repaired_sha256 of the repaired turns
    as `role:text`, joined by newlines. A conversation without a row after damage has zeros and the hash of an empty text."""
    planned, turns = repair(damaged(df))
    line = F.concat_ws(":", "role", "text").alias("line")
    lines = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "at", "part", line))).alias("lines"))
    lines = lines.select(F.col("conv_id").alias("its_id"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    told = planned.join(lines, planned["conv_id"].eqNullSafe(lines["its_id"]), "left").drop("its_id", "pieces").withColumnRenamed("conv_id", "its_id")
    every = df.select("conv_id").distinct()
    out = every.join(told, every["conv_id"].eqNullSafe(told["its_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("repaired_sha256"))
