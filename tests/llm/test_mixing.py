from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rallyframe.llm import mixing


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 50), min_size=1), st.integers(20, 120))
def test_cycle_never_deviates_by_a_block(weights, cycle):
    slots = mixing.shares(weights, max(cycle, 16 * len(weights)))
    size = sum(slots.values())
    picks = mixing.cycle_schedule(slots)
    assert sorted(p for ps in picks.values() for p in ps) == list(range(size))
    for s, c in slots.items():
        for i, p in enumerate(picks[s]):
            assert Fraction(i * size, c).__floor__() <= p < -(-(i + 1) * size // c)
        for t in range(size + 1):
            assert abs(Fraction(c * t, size) - sum(p < t for p in picks[s])) < 1


def slow_mix(blocks, weights, cycle):
    """Slot by slot: the released block with the earliest deadline, new phase when a source ends."""
    left, done, out = {s: n for s, n in blocks.items() if n}, {}, []
    while left:
        slots = mixing.shares({s: weights[s] for s in left}, max(cycle, 16 * len(left)))
        size, taken, t = sum(slots.values()), dict.fromkeys(left, 0), 0
        while all(taken[s] < left[s] for s in left):
            due = min((-(-(taken[s] + 1) * size // slots[s]), s) for s in left if taken[s] * size // slots[s] <= t)
            s = due[1]
            out.append((s, done.get(s, 0) + taken[s]))
            taken[s] += 1
            t += 1
        for s in taken:
            done[s] = done.get(s, 0) + taken[s]
            left[s] -= taken[s]
        left = {s: n for s, n in left.items() if n}
    return out


@pytest.mark.parametrize("blocks", [{"a": 50, "b": 3, "c": 17}, {"a": 1}, {"a": 0, "b": 2}, {"a": 400, "b": 400, "c": 1, "d": 90}])
def test_plan_is_the_slot_by_slot_schedule(blocks):
    weights = {"a": 5, "b": 3, "c": 1, "d": 2}
    slots = {}
    for s, first, last, slot0, cycle, picks in mixing.plan(blocks, weights, 20):
        for b in range(first, last + 1):
            i = b - first
            slots[slot0 + i // len(picks) * cycle + picks[i % len(picks)]] = (s, b)
    assert [slots[t] for t in sorted(slots)] == slow_mix(blocks, weights, 20)
    assert sorted(slots) == list(range(sum(blocks.values())))


def test_rows_follow_the_schedule(spark):
    rows = spark.range(1000).select(
        "id", F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 2 == 0, "mid").otherwise("low").alias("source"), F.lit(1).alias("_slot")
    )
    placed = mixing.schedule(rows, "source", "id", {"big": 1, "mid": 1, "low": 2}, block_rows=10, cycle=64)
    got = sorted((r.slot, r.start, r._key, r._source) for r in placed.collect())
    by = {}
    for slot, start, key, source in got:
        by.setdefault(source, []).append((start, key, slot))
    blocks = {s: -(-len(x) // 10) for s, x in by.items()}
    order = slow_mix(blocks, {"big": 1, "mid": 1, "low": 2}, 64)
    for source, listed in by.items():
        assert [k for _, k, _ in sorted(listed)] == sorted(k for _, k, _ in listed)
        assert [start for start, _, _ in sorted(listed)] == list(range(len(listed)))
        for start, _, slot in listed:
            assert order[slot] == (source, start // 10)
    mixed = mixing.mixed(rows, "source", "id", weights={"big": 1, "mid": 1, "low": 2}, block_rows=10, cycle=64).collect()
    assert [r.id for r in mixed] == [key for _, _, key, _ in got]


def test_odd_rows_all_stay(spark, small):
    mixed = mixing.mixed(small)
    assert mixed.columns == small.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, mixed.collect())) == sorted(map(key, small.collect()))
    placed = mixing.schedule(small).collect()
    assert sum(r.copies for r in placed) == small.count() and "" in {r._source for r in placed}
    assert mixing.mixed(small.filter("false")).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(small, weights={"a": 1})
