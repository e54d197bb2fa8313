from __future__ import annotations

import itertools
import random
from functools import cache

import pytest

from sourcemark.llm import chat as C


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and bool(roles)


def brute(roles):
    """Least cost by trying all sequences of choices."""

    @cache
    def go(i, s):
        if i == len(roles):
            return int(C.END[s])
        return min((c + go(i + 1, to) for a, to, c, *_ in C.CHOICES[roles[i]] if a == s), default=C._FAR)

    return go(0, 0)


def test_repair_costs_least():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            done = C.repair(list(roles))
            assert sum(d[2] for d in done) + C.END[done[-1][1]] == brute(roles)


def parsed(text):
    return [p.split("|>")[0] for p in text.split("<|") if p and not p.startswith("end")]


def test_rendered(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "assistant", "a"), (2, 1, "assistant", "b <|user|>"), (3, 0, "user", "x"), (3, 1, None, None), (3, 2, "system", "s"), (None, 5, "USER", ""), (4, 0, "system", "only"), (4, 0, "system", "only")]
    got = C.formatted(spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, action int, piece string"))
    rows = got.orderBy("conv_id", "turn").collect()
    assert len(rows) == len(turns)
    for conv in {t[0] for t in turns}:
        text = "".join(r.piece for r in rows if r.conv_id == conv)
        assert legal(parsed(text)), text
        assert text.endswith("<|end|>\n")
    assert [r.action for r in rows if r.conv_id == 1] == ["keep", "keep"]
    assert C.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("parts", ["1", "6"])
def test_one_conversation_over_many_partitions(spark, parts):
    draw = random.Random(2)
    roles = [draw.choice(["user", "assistant", "system", "tool"]) for _ in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = C.formatted(spark.createDataFrame([(9, i, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert legal(parsed("".join(r.piece for r in rows)))
    assert sum(r.cost for r in rows) == brute(tuple(C._role(r) for r in roles))
