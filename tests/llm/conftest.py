from __future__ import annotations

import random

import pytest

from tests.conftest import *  # noqa: F403

#: Columns that operators use inside, to clash with.
EXTRA = "fp long, found string, piece string, score string, h string, kept string, spans string, term string, rid string, width string, share string, text_ string"
WORDS = "the of and to a in is it that was lantern river copper meadow signal harbor violet thunder marble whisper canyon ember".split()


def odd_texts() -> list[tuple]:
    """(doc_id, text): nulls, empties, white space, copies, near copies, ties, repeated rows, a shared passage, long texts."""
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    passage = say(30)
    base = say(120)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, base), (7, base), (8, base + " end"), (9, passage), (10, say(20) + " " + passage + "\n" + say(20)), (11, say(5) + "\n" + passage)]
    rows += [(12, say(20_000)), (13, "x" * 100_000), (14, "same same " * 300), (15, "Ünïcödé 😀 " + say(40)), (6, base), (None, base), (None, say(30)), (None, None)]
    return rows + [(k, say(rng.randint(1, 80))) for k in range(16, 60)]


@pytest.fixture(scope="session")
def odd(spark):
    cols = EXTRA.count(",") + 1
    rows = [(*r, *([7] + ["x"] * (cols - 1))) for r in odd_texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + EXTRA).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
