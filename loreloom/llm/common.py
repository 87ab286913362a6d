"""Helpers that several of these operators share."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreloom.session import cut_lineage

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the jobs that run inside the block."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts that a Python worker gets at a time, where the session has Spark's default of 10,000.
TEXT_ROWS = "500"


def text_rows(df: DataFrame) -> DataFrame:
    """``df`` unchanged; its session sends few rows at a time to Python workers.

    A batch is held whole by the executor and the worker, and a row can be a text
    of any length.  The setting has to last until the result is computed; a
    session that names a value of its own keeps it.
    """
    conf = df.sparkSession.conf
    if conf.get(ROWS_PER_BATCH) == "10000":
        conf.set(ROWS_PER_BATCH, TEXT_ROWS)
    return df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sorted_parts(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` written in ranges of ``order``: ``_part`` numbers the range, ``_tie`` orders equal rows.

    Ranges are cut on ``_tie`` last, so even rows that are equal in every
    column spread over several ranges.
    """
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(*[F.col(c) for c in order], F.col("_tie"))
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """For every row of ``df`` the sum of each column of ``sums`` over all rows before it in ``order``.

    A global prefix sum without a global window: totals per range, a running
    sum over the totals (one row per range), and a window inside each range.
    """
    parts = sorted_parts(df.withColumns({f"_in_{k}": c for k, c in sums.items()}), order)
    totals = parts.groupBy("_part").agg(*[F.sum(f"_in_{k}").alias(f"_total_{k}") for k in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "_part", *[F.coalesce(F.sum(f"_total_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in sums]
    )
    inside = Window.partitionBy("_part").orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: as many rows as the shuffle has partitions.
    placed = parts.join(F.broadcast(before), "_part").withColumns(
        {k: F.col(f"_before_{k}") + F.coalesce(F.sum(f"_in_{k}").over(inside), F.lit(0)) for k in sums}
    )
    return placed.select(*df.columns, *sums)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that its edges reach.

    Alternating large-star and small-star steps; every step is a minimum per
    node and a join, and its result is written, so no key gathers its
    neighbours in one place.  Loops and repeated edges do no harm.
    """
    now = cut_lineage(edges.where("a <> b").select(
        F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")
    ).distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("m", "v")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select("v", "m").distinct()
        parent = large.groupBy("v").agg(F.min("m").alias("p"))
        small = large.join(parent, "v").select(
            F.explode(F.array(F.struct("v", F.col("p").alias("m")), F.struct(F.col("m").alias("v"), F.col("p").alias("m")))).alias("e")
        ).select("e.v", "e.m").where("v <> m").distinct()
        now = cut_lineage(small, "edges")
        # Sums of hashes modulo 2^64 tell whether anything moved.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    roots = now.select(F.col("m").alias("v"), "m").distinct()
    return now.union(roots).toDF("node", "component")
