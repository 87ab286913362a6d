"""Numbering and folding rows in order without putting a whole key into one task.

A plain window over a key sorts all its rows in one task.  Here the rows of a
key are cut into buckets that follow the order (an hour, a day); each bucket is
handled on its own and only one summary row per bucket is combined per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, bucket: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over the rows of the key up to and including this one.

    ``bucket`` must be non-decreasing along ``order`` within a key.  Rows with a
    null key or bucket are kept: null is a key like any other.
    """
    marked = df.withColumn("_bucket", bucket).withColumn("_value", value)
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = marked.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    together = [*keys, "_bucket"]
    offsets = totals.select(
        *[F.col(k).alias(f"_o{i}") for i, k in enumerate(together)],
        F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"),
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(together)])
    return (
        marked.withColumn("_inside", F.sum("_value").over(inside))
        .join(offsets, same)
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_bucket", "_value", "_inside", "_offset", *[f"_o{i}" for i in range(len(together))])
    )


def number_rows(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str = "number") -> DataFrame:
    """Row number from 1 within the key."""
    return running_sum(df, keys, order, F.lit(1), bucket, name)


def replay(
    events: DataFrame, key: str, order: list[str], action: str, fine: Column, coarse: Column,
    rules: dict[tuple[str, str], str], start: str,
) -> DataFrame:
    """Replay actions through a transition table; illegal ones are rejected and change nothing.

    ``rules`` maps (state, action) to the next state.  A bucket of rows acts on the
    state as a small state -> state table, whatever it holds, and such tables can be
    chained.  So every fine bucket is folded from all states at once, the tables are
    chained within coarse buckets and then per key, and with its start state known
    each fine bucket is replayed on its own.  No step gathers more than one fine
    bucket's rows or one level's tables.  Adds ``from_state``, ``to_state`` and
    ``accepted``.
    """
    states = sorted({s for s, _ in rules} | set(rules.values()) | {start})
    names = F.array(*[F.lit(s) for s in states])
    # States and actions are numbers in all steps; an action is looked up once per row.
    acts = sorted({a for _, a in rules})
    known = F.create_map(*[F.lit(x) for n, a in enumerate(acts) for x in (a, n)])
    moves = F.array(*[F.lit(states.index(rules[s, a]) if (s, a) in rules else None).cast("int") for a in acts for s in states])
    everywhere = F.array(*[F.lit(n) for n in range(len(states))])

    def after(state: Column, row: Column) -> Column:
        return F.get(moves, row["_code"] * len(states) + state)

    def through(effect: Column, state: Column) -> Column:
        return F.get(effect, state)

    marked = events.withColumn("_fine", fine).withColumn("_coarse", coarse)
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(action).alias("_act"), F.try_element_at(known, F.col(action)).alias("_code"))))
    buckets = marked.groupBy(key, "_coarse", "_fine").agg(rows.alias("_rows"))
    fold = lambda s: F.aggregate("_rows", s, lambda acc, r: F.coalesce(after(acc, r), acc))
    effects = buckets.select(key, "_coarse", "_fine", F.transform(everywhere, fold).alias("_effect"))

    def chained(df: DataFrame, keys: list[str], bucket: str) -> DataFrame:
        listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(bucket).alias("b"), "_effect"))).alias("_list"))
        whole = lambda s: F.aggregate("_list", s, lambda acc, e: through(e["_effect"], acc))
        return listed.select(*keys, "_list", F.transform(everywhere, whole).alias("_effect"))

    def entries(chain: DataFrame, keys: list[str], bucket: str, begin: Column) -> DataFrame:
        kind = dict(marked.dtypes)[bucket]
        empty = F.struct(begin.alias("state"), F.array().cast(f"array<struct<b:{kind},state:int>>").alias("out"))
        walked = F.aggregate("_list", empty, lambda acc, e: F.struct(
            through(e["_effect"], acc["state"]).alias("state"),
            F.array_append(acc["out"], F.struct(e["b"].alias("b"), acc["state"].alias("state"))).alias("out"),
        ))["out"]
        return chain.select(*keys, F.explode(walked).alias("_e")).select(
            *keys, F.col("_e.b").alias(bucket), F.col("_e.state").alias("_start")
        )

    per_coarse = chained(effects, [key, "_coarse"], "_fine")
    per_key = chained(per_coarse.drop("_list"), [key], "_coarse")
    coarse_start = entries(per_key, [key], "_coarse", F.lit(states.index(start)))
    fine_start = entries(per_coarse.join(coarse_start, [key, "_coarse"]), [key, "_coarse"], "_fine", F.col("_start"))

    fields = ", ".join(f"`{c}`:{dict(events.dtypes)[c]}" for c in order)
    log = f"array<struct<{fields},_act:string,from_state:int,to_state:int,accepted:boolean>>"
    begin = F.struct(F.col("_start").alias("state"), F.array().cast(log).alias("log"))

    def step(acc: Column, r: Column) -> Column:
        following = after(acc["state"], r)
        reached = F.coalesce(following, acc["state"])
        row = F.struct(
            *[r[c].alias(c) for c in order], r["_act"].alias("_act"), acc["state"].alias("from_state"),
            reached.alias("to_state"), following.isNotNull().alias("accepted"),
        )
        return F.struct(reached.alias("state"), F.array_append(acc["log"], row).alias("log"))

    replayed = buckets.join(fine_start, [key, "_coarse", "_fine"]).select(
        key, F.explode(F.aggregate("_rows", begin, step)["log"]).alias("_l")
    )
    return replayed.select(
        key, *[F.col(f"_l.{c}").alias(c) for c in order], F.col("_l._act").alias(action),
        F.get(names, F.col("_l.from_state")).alias("from_state"), F.get(names, F.col("_l.to_state")).alias("to_state"), "_l.accepted",
    )
