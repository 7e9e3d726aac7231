import random

import pytest

from lexiloom.operators.periods import continuous_periods


def merged(rows):
    by = {}
    for key, a, b in rows:
        if a is not None and b is not None and a < b:
            by.setdefault(key, []).append((a, b))
    out = set()
    for key, spans in by.items():
        start, end = sorted(spans)[0]
        for a, b in sorted(spans):
            if a > end:
                out |= {(key, "period", start, end), (key, "gap", end, a)}
                start, end = a, b
            end = max(end, b)
        out.add((key, "period", start, end))
    return out


@pytest.mark.parametrize("shard_bits", [6, 16])
def test_against_sorted_merge(spark, shard_bits):
    rng = random.Random(7)
    rows = []
    for key in ["a", "b", None, "c"]:
        for _ in range(80):
            reach = rng.choice([100, 1000, 300_000, 2**40])
            start = rng.randint(-reach, reach)
            rows.append((key, start, start + rng.choice([-3, 0, 1, 5, 63, 64, 128, reach])))
    rows += [("a", None, 4), ("z", 1, None), ("y", 0, 64), ("y", 64, 128), ("y", 64, 128), ("x", -5, -1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "k string, start_pos long, end_pos long, kind int")
    assert {tuple(r) for r in continuous_periods(df, ["k"], shard_bits=shard_bits).collect()} == merged(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, start_pos long, end_pos long")
    assert continuous_periods(df, ["k"]).collect() == []
