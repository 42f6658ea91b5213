"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql.types import _parse_datatype_string

from sparkdigest.llm import conversations, queries
from tests.conftest import SMALL, same_rows

SCHEMA = "conv_id long, turn long, role string, text string"
WS = " \t\n\x0b\x0c\r"


def _damage(rows):
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        for _ in range(0 if d == 0 else 2 if d == 3 else 1):
            yield conv, turn, "user" if d == 4 else role, text


def _cheapest(turns):
    """The least (cost, audit, lines) over all ways to edit turns (role, text, fault), by Dijkstra's search with insertions anywhere."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, k, state, lines = heapq.heappop(heap)
        if (k, state) in done:
            continue
        if k == len(turns) and state in (0, 3):
            return cost, audit, lines
        done.add((k, state))
        due = "assistant" if state == 2 else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", k, 3 if state == 2 else 2, (*lines, f"{due}:")))
        if k < len(turns):
            role, text, fault = turns[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] == "s" and state == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, 1, (*lines, f"{role}:{text}")))
                own = role[:1] == due[0]
                said = role if own else due
                heapq.heappush(heap, (cost + more + (not own), audit + ("K" if own else "R"), k + 1, 3 if state == 2 else 2, (*lines, f"{said}:{text}")))


def _by_search(rows):
    by_id = {r[0]: [] for r in rows}
    for r in _damage(rows):
        by_id[r[0]].append(r[1:])
    out = []
    for conv, own in by_id.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns = set(), []
        for _, role, text in own:
            said = text.rstrip(WS)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else None if said[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [r[0] for r in own if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = [sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, lines = _cheapest(turns)
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def _found(spark, rows, schema=SCHEMA):
    df = conversations.audited(spark.createDataFrame(rows, schema))
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=repr)


def _random_rows(seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Yes.", "No!", "Why?", "cut", "", " \n", "a ", "Yes. \x0b", None, "x.y", "long words here."]
    rows = []
    for conv in [*range(60), None]:
        turn = rng.randint(-3, 3)
        for _ in range(rng.randint(1, 14)):
            rows.append((conv, rng.choice([turn, turn, turn, None]) if rng.random() < 0.2 else turn, rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 2, 5])
    return rows


@pytest.mark.parametrize("segment", [conversations.SEGMENT, 2])
def test_edits_equal_the_search(spark, monkeypatch, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = _random_rows(7)
    assert _found(spark, rows) == _by_search(rows)


def test_truncated_turns_stay_where_that_is_cheaper(spark):
    rows = [(8, 0, "system", "S."), (8, 1, "user", "U."), (8, 2, "assistant", "cut")]
    found = _found(spark, rows)
    assert found == _by_search(rows)


def test_nothing_left_and_nothing_given(spark):
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert _found(spark, [(dropped, 0, "user", "Hi.")]) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert _found(spark, [], _parse_datatype_string(SCHEMA)) == []


def test_long_conversation_with_repeated_rows_and_clashing_columns(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}." if k % 37 else "again") for k in range(900)] + [(1, 5, "user", "Hi.")] * 40
    wide = [(*r, 9, "z") for r in rows]
    assert _found(spark, wide, SCHEMA + ", segment long, fault string") == _by_search(rows)


def test_query_equals_sql(spark, duck):
    same_rows(queries.queries()["op12_conversation_repair"](spark, SMALL), duck, queries.oracle_sql()["op12_conversation_repair"])
