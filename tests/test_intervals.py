import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loreloom.operators import intervals

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("unit", [60, 3600, 86_400])
def test_pairs_equal_all_pairs(spark, unit):
    rng = random.Random(unit)
    rows = []
    for i in range(160):
        a = START + dt.timedelta(seconds=rng.randrange(0, 400_000, 1800))
        b = a + dt.timedelta(seconds=rng.choice([0, 1800, 7200, 90_000, 300_000, -5]))
        rows.append((rng.choice(["k", "k", "m", None]), i, a if rng.random() > 0.15 else None, b if rng.random() > 0.15 else None))
    df = spark.createDataFrame(rows, "k string, id long, a timestamp, b timestamp")
    low, high = dt.datetime.min, dt.datetime.max

    def overlap(x, y):
        s, e = max(x[2] or low, y[2] or low), min(x[3] or high, y[3] or high)
        return x[0] is not None and x[0] == y[0] and s < e and all(not (r[2] and r[3]) or r[2] < r[3] for r in (x, y))

    expected = sorted((x[0], x[1], y[1]) for i, x in enumerate(rows) for y in rows[i + 1:] if overlap(x, y))
    got = sorted(tuple(r) for r in intervals.overlapping_pairs(df, ["k"], "id", "a", "b", unit).collect())
    assert got == expected
    assert intervals.overlapping_pairs(df.limit(0), ["k"], "id", "a", "b").count() == 0


def test_cells_cover_each_tick_once(spark):
    rows = [(a, b) for a in range(0, 40) for b in range(a, 70)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("c", intervals.cells(F.col("a"), F.col("b"), 5))
    for r in df.collect():
        ticks = [t for c in r["c"] for t in range(c["cell"] * 4 ** c["level"], (c["cell"] + 1) * 4 ** c["level"])]
        assert sorted(ticks) == list(range(r["a"], r["b"]))
        assert len(r["c"]) <= 30


def test_value_at_a_moment(spark):
    rng = random.Random(3)
    at = lambda: START + dt.timedelta(days=rng.randrange(120), seconds=rng.randrange(3) * 1000)
    changes = [(rng.choice([1, 1, 1, 2, None]), at() if rng.random() > 0.05 else None, f"n{i}", i) for i in range(90)]
    facts = [(rng.choice([1, 1, 2, 3, None]), i, at() if rng.random() > 0.05 else None) for i in range(200)]
    got = intervals.as_of(
        spark.createDataFrame(facts, "k long, id long, at timestamp"), spark.createDataFrame(changes, "k long, since timestamp, name string, v int"),
        ["k"], "at", "since", ["name", "v"])
    assert got.columns == ["k", "id", "at", "name", "v"]
    for r in got.collect():
        before = [(c[1], c[2], c[3]) for c in changes if c[0] == r["k"] and c[1] and r["at"] and c[1] <= r["at"]]
        assert (r["name"], r["v"]) == (max(before)[1:] if before else (None, None))
    assert got.count() == 200
