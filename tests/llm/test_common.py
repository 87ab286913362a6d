import random

from pyspark.sql import functions as F

from loreloom.llm.common import components, running_sums


def test_running_sums_follow_the_order(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(20), rng.randrange(100)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = running_sums(df, ["k", "v"], {"before": F.col("v").cast("long")}).collect()
    total = 0
    for row, (k, v) in zip(sorted(got, key=lambda r: (r.k, r.v, r.before)), sorted(rows)):
        assert (row.k, row.v, row.before) == (k, v, total)
        total += v


def test_running_sums_of_nothing(spark):
    df = spark.createDataFrame([], "k int")
    assert running_sums(df, ["k"], {"n": F.lit(1).cast("long")}).count() == 0


def brute(edges):
    group = {}
    for a, b in edges:
        group.setdefault(a, a), group.setdefault(b, b)
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(group[a], group[b])
            moved |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    return group


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1040)]
    other = [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    edges = chain + star + other + star + [(b, a) for a, b in chain]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    expected = {n: c for n, c in brute([(a, b) for a, b in edges if a != b]).items()}
    assert {r.node: r.component for r in components(df).collect()} == expected


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
