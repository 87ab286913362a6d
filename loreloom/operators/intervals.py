"""Joins over time: intervals that overlap, and the value that held at a moment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cells of one level that a cell of the next level covers.
RADIX = 4
DAY = 86_400


def cells(low: Column, high: Column, levels: int) -> Column:
    """The fewest cells (level, cell) that cover the ticks from ``low`` to before ``high``, each tick once.

    A cell of level n covers ``RADIX ** n`` ticks, so an interval of any length
    has a few cells a level.
    """
    none = F.array().cast("array<bigint>")

    def whole(level: int) -> tuple[Column, Column]:
        """The cells of a level that lie inside."""
        return F.ceil(low / RADIX**level), F.floor(high / RADIX**level)

    parts = []
    for level in range(levels):
        begin, end = whole(level)
        up, down = whole(level + 1)
        inner = up < down
        left = F.when(inner, up * RADIX).otherwise(end)
        first = F.when(begin < left, F.sequence(begin, left - 1)).otherwise(none)
        last = F.when(inner & (down * RADIX < end), F.sequence(down * RADIX, end - 1)).otherwise(none)
        parts.append(F.transform(F.concat(first, last), _cell(level)))
    return F.concat(*parts)


def _cell(level: int):
    return lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell"))


def overlapping_pairs(
    rows: DataFrame, keys: Sequence[str], id_col: str, start: str, end: str, unit: int = DAY
) -> DataFrame:
    """(keys, a, b): ids of all pairs of ``rows`` of one key whose intervals overlap, each pair once.

    * An interval runs from ``start`` to before ``end`` (timestamps); a null start
      or end is open.  Empty intervals overlap with nothing, touching ones not
      with each other.  Rows with a null key meet nothing.
    * Two intervals overlap where the later one starts inside the other.  So
      each start is one tick of ``unit`` seconds, looked up once a level among the
      cells that cover the intervals; a pair meets in exactly one cell, and rows
      meet only if they overlap or differ by less than a tick.  A key that holds
      a third of all rows is spread over its cells.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    timed = rows.select(*keys, F.col(id_col).alias("id"), micros(start).alias("from"), micros(end).alias("to")).where(
        F.col("from").isNull() | F.col("to").isNull() | (F.col("from") < F.col("to")))
    tick = lambda c: F.floor(c / (unit * 1_000_000))
    least, most = timed.agg(
        F.least(F.min(tick(F.col("from"))), F.min(tick(F.col("to")))), F.greatest(F.max(tick(F.col("from"))), F.max(tick(F.col("to"))))
    ).first()
    least, most = least or 0, most or 0
    # Tick 0 is before all others: open starts.
    width = most - least + 3
    levels = max(1, math.ceil(math.log(width, RADIX)) + 1)
    low = F.coalesce(tick(F.col("from")) - F.lit(least - 1), F.lit(0)).cast("long")
    high = F.coalesce(tick(F.col("to") - 1) - F.lit(least - 2), F.lit(width)).cast("long")
    placed = timed.withColumns({"low": low, "high": high})
    cover = placed.select(*keys, F.col("id").alias("a"), F.col("from").alias("a_from"), F.col("to").alias("a_to"), F.explode(
        cells(F.col("low"), F.col("high"), levels)).alias("at")).select("*", "at.level", "at.cell").drop("at")
    above = F.array(*[_cell(n)(F.floor(F.col("low") / RADIX**n).cast("long")) for n in range(levels)])
    points = placed.select(*keys, F.col("id").alias("b"), F.col("from").alias("b_from"), F.col("to").alias("b_to"), F.explode(
        above).alias("at")).select("*", "at.level", "at.cell").drop("at")
    begin = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))
    first = (begin("a_from") < begin("b_from")) | ((begin("a_from") == begin("b_from")) & (F.col("a") < F.col("b")))
    holds = F.col("a_to").isNull() | F.col("b_from").isNull() | (F.col("b_from") < F.col("a_to"))
    met = cover.join(points, [*keys, "level", "cell"]).where(first & holds)
    return met.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def as_of(
    facts: DataFrame, changes: DataFrame, keys: Sequence[str], at: str, changed_at: str, values: Sequence[str], bucket: str = "month"
) -> DataFrame:
    """``facts`` with the ``values`` of the last of ``changes`` of their key at or before ``at``; null without one.

    Both are put into one order and the last value is carried on: inside buckets
    of time (``bucket`` as in date_trunc), and from the end of one bucket to the
    next, one row per bucket, so a hot key is many buckets.  Of changes at one
    moment the greatest values hold.  Null keys are a key like any other; facts
    without a time get nulls.
    """
    value = F.struct(*values)
    kinds = ", ".join(f"`{n}`: {t}" for n, t in changes.select(*values).dtypes)
    none = F.lit(None).cast(f"struct<{kinds}>")
    moment = lambda c: F.col(c).cast("timestamp").alias("_at")
    row = F.struct("*")
    left = facts.select(*keys, moment(at), F.lit(1).alias("_kind"), none.alias("_value"), row.alias("_row"))
    right = changes.where(F.col(changed_at).isNotNull()).select(*keys, moment(changed_at), F.lit(0).alias("_kind"), value.alias("_value"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_bucket", F.date_trunc(bucket, "_at"))
    inside = W.partitionBy(*keys, "_bucket").orderBy("_at", "_kind", "_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = both.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).where(F.col("_kind") == 1)
    ends = right.withColumn("_bucket", F.date_trunc(bucket, "_at")).groupBy(*keys, "_bucket").agg(
        F.max_by("_value", F.struct("_at", "_value")).alias("_end"))
    # A row per bucket with changes or facts of the key.
    spans = both.select(*keys, "_bucket").distinct().join(
        ends.withColumnsRenamed({k: f"_e_{k}" for k in keys} | {"_bucket": "_e_bucket"}),
        reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys] + [F.col("_bucket") == F.col("_e_bucket")]),
        "left")
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_bucket").alias("_c_bucket"),
                           F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.col("_bucket") == F.col("_c_bucket")])
    found = F.coalesce("_inside", "_carried")
    return held.join(carried, same, "left").select("_row.*", *[
        F.when(F.col("_at").isNotNull(), found[v]).alias(v) for v in values])
