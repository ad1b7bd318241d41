"""Packed sequences: the plan, whole packs, and what comes out again."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lathework.operators import packs


def check_plan(sizes, capacity):
    places, count = packs.plan_packs(sizes, capacity)
    filled = [[] for _ in range(count)]
    numbers = Counter()
    for p in places:
        for i in range(p.count):
            filled[p.pack + i].append((p.offset, p.size))
        numbers.update((p.size, n) for n in range(p.start, p.start + p.count))
    assert numbers == Counter((size, n) for size, total in sizes.items() for n in range(total))
    for parts in filled:
        ends = 0
        for offset, size in sorted(parts):
            assert offset == ends
            ends += size
        assert 0 < ends <= capacity
    return count, places


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), max_size=12))
def test_the_plan_places_each_piece_once(sizes):
    count, _ = check_plan(sizes, 40)
    total = sum(s * n for s, n in sizes.items())
    # any two packs of a best fit hold more than one capacity together
    assert count <= max(1, math.ceil(2 * total / 40)) or not sizes


def test_the_plan_is_tight_and_does_not_grow_with_the_rows():
    draw = random.Random(4)
    sizes = {s: draw.randint(1, 9) for s in range(1, 513)}
    count, places = check_plan(sizes, 512)
    assert count <= math.ceil(1.02 * sum(s * n for s, n in sizes.items()) / 512)
    many, more = packs.plan_packs({s: n * 10**9 for s, n in sizes.items()}, 512)[::-1]
    assert many <= 1.02 * 10**9 * sum(s * n for s, n in sizes.items()) / 512 and len(more) < 4 * len(places)


def test_a_size_beyond_the_capacity_is_refused():
    with pytest.raises(ValueError):
        packs.plan_packs({5: 1}, 4)


def test_packs_hold_every_token_once(spark):
    draw = random.Random(9)
    rows = [(i % 50 if i % 7 else None, [draw.randint(1, 99) for _ in range(draw.choice([0, 1, 3, 7, 8, 9, 16, 29]))]) for i in range(300)]
    rows += [(1000, None), (1001, list(range(1, 101)))]
    df = spark.createDataFrame(rows, "key long, tokens array<int>").repartition(4)
    whole = packs.packed_sequences(df, "key", "tokens", 8, pad=-1).collect()
    assert sorted(r["pack"] for r in whole) == list(range(len(whole)))
    seen = Counter()
    for r in whole:
        assert len(r["tokens"]) == len(r["segments"]) == len(r["positions"]) == 8
        assert r["tokens"][r["used"] :] == [-1] * (8 - r["used"]) and r["segments"][r["used"] :] == [0] * (8 - r["used"])
        at = 0
        for n, s in enumerate(r["sources"], 1):
            assert s["offset"] == at
            at += s["length"]
            assert r["segments"][s["offset"] : at] == [n] * s["length"]
            assert r["positions"][s["offset"] : at] == list(range(s["length"]))
            seen[s["key"], s["piece"], tuple(r["tokens"][s["offset"] : at])] += 1
        assert at == r["used"]
    wanted = Counter((k, i // 8, tuple(t[i : i + 8])) for k, t in rows if t for i in range(0, len(t), 8))
    assert seen == wanted
    assert len(whole) <= math.ceil(1.05 * sum(len(t or []) for _, t in rows) / 8)


def test_unpacking_gives_the_pieces_back(spark):
    df = spark.createDataFrame([(1, [5, 6, 7]), (2, [8]), (3, [])], "key long, tokens array<int>")
    out = packs.unpacked(packs.packed_sequences(df, "key", "tokens", 4), ["tokens", "positions"])
    assert sorted((r["key"], r["tokens"], r["positions"]) for r in out.collect()) == [(1, [5, 6, 7], [0, 1, 2]), (2, [8], [0])]
    assert packs.packed_sequences(df.where(F.lit(False)), "key", "tokens", 4).count() == 0
