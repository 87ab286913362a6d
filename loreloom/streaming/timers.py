"""Keyed state in event-time order: rows wait until the watermark has passed them, timers close what has run out.

Rows of a key are held in a list until no earlier row can come, then they are
folded in the order of (time, event), whatever files and micro-batches they came
in.  A timer wakes the key when its next row is due or its state has run out, so
keys without rows hold no state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loreloom import config
from loreloom.streaming.state import new_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Later than all rows; pandas counts nanoseconds up to the year 2262.
FAR = "2262-01-01"


@dataclass
class Fold:
    """What to do with the rows of a key.

    ``step(state, us, event, kind)`` and ``close(state, us)`` return the state
    after it (None: nothing to keep) and result rows; ``due(state)`` is when an
    open state runs out, in microseconds.  A state is anything JSON can hold.
    """

    step: Callable[[Any, int, int, str], tuple[Any, list[tuple]]]
    due: Callable[[Any], int | None]
    close: Callable[[Any, int], tuple[Any, list[tuple]]]


class InOrder(StatefulProcessor):
    def __init__(self, fold: Fold, key: str, columns: list[str]) -> None:
        self.fold, self.key, self.columns = fold, key, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us bigint, event bigint, kind string")
        self.kept = handle.getValueState("kept", "state string")

    def wake(self, at_us: int, now_ms: int) -> None:
        at = max(-(-at_us // 1000), now_ms + 1)
        waiting = list(self.handle.listTimers())
        if not waiting or at < min(waiting):
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [tuple(r) for part in rows for r in part[["us", "event", "kind"]].itertuples(index=False) if r.event is not None and r.event == r.event]
        if new:
            self.held.appendList([(int(us), int(event), kind) for us, event, kind in new])
            self.wake(min(int(r[0]) for r in new), timerValues.getCurrentWatermarkInMs())
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.held.get())
        ready = [r for r in rows if r[0] <= now_ms * 1000]
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        out: list[tuple] = []

        def close_before(us: int) -> None:
            nonlocal state
            while state is not None and (due := self.fold.due(state)) is not None and due < us:
                state, found = self.fold.close(state, due)
                out.extend(found)

        for us, event, kind in ready:
            close_before(us)
            state, found = self.fold.step(state, us, event, kind)
            out.extend(found)
        close_before(now_ms * 1000)
        left = rows[len(ready):]
        self.held.put(left) if left else self.held.clear()
        self.kept.update((json.dumps(state),)) if state is not None else self.kept.clear()
        due = self.fold.due(state) if state is not None else None
        following = [us for us in (left[0][0] if left else None, due and due + 1) if us]
        if following:
            self.wake(min(following), now_ms)
        if out:
            frame = pd.DataFrame(out, columns=self.columns[1:])
            frame.insert(0, self.key, key[0])
            yield frame


def folded(
    stream: DataFrame, key: str, at: str, event: str, kind: str | None, fold: Fold, results: str, delay: str,
    acting: tuple[str, ...] | None = None,
) -> DataFrame:
    """The result rows of ``fold`` over each key of ``stream``: the key and ``results`` (a schema).

    ``acting`` names the kinds that ``fold`` acts on where it passes over all others:
    those are not kept in state.  Rows without an event move the watermark and stay.
    """
    rows = stream.select(
        F.col(key), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"),
        F.col(event).cast("long").alias("event"), (F.col(kind).cast("string") if kind else F.lit("")).alias("kind"),
    )
    if acting is not None:
        rows = rows.filter(F.col("kind").isin(*acting) | F.col("event").isNull())
    rows = rows.withWatermark("at", delay)
    names = [key, *[c.strip().split(" ")[0] for c in results.split(",")]]
    return rows.groupBy(key).transformWithStateInPandas(
        InOrder(fold, key, names), f"`{key}` {dict(stream.dtypes)[key]}, {results}", "append", "eventTime")


def rate_fold(limit: int = config.RATE_LIMIT, period: int = config.RATE_PERIOD_SECONDS) -> Fold:
    """Fixed windows of ``period`` seconds that open at a key's first event; the window goes when it has run out."""

    def step(state, us, event, kind):
        start, count = state or (None, 0)
        if start is None or us > start + period * 1_000_000:
            start, count = us, 0
        count += 1
        return (start, count), [(event, start, count, count <= limit)]

    return Fold(step, lambda state: state[0] + period * 1_000_000, lambda state, us: (None, []))


def work_fold(start: str, end: str, seconds: int) -> Fold:
    """Work that begins with an event of kind ``start``: ``succeeded`` at the next ``end`` of its key, else ``interrupted`` when time is out."""

    def step(state, us, event, kind):
        state = state or []
        if kind == start:
            return [*state, (us, event)], []
        if kind == end and state:
            return None, [(begun, "succeeded", us) for _, begun in state]
        return state or None, []

    def close(state, us):
        gone = [(begun, "interrupted", us) for at, begun in state if at + seconds * 1_000_000 <= us]
        left = [s for s in state if s[0] + seconds * 1_000_000 > us]
        return left or None, gone

    return Fold(step, lambda state: state[0][0] + seconds * 1_000_000, close)


def run_to_end(stream: DataFrame, build: Callable[[DataFrame], DataFrame], at: str) -> tuple[DataFrame, str]:
    """What ``build(stream)`` gives for all rows there are, and the folder of its progress.

    A stream alone never learns that its last rows are due.  After the first run
    two rows of the far future, of no key, move the watermark past all others;
    the second run goes on from the progress of the first.
    """
    spark = stream.sparkSession
    folder = new_folder(spark, "in-order")
    none = spark.createDataFrame([], stream.schema)
    none.write.parquet(f"{folder}/end/none")
    ends = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/end/*")
    result = build(stream.unionByName(ends))
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for run in range(2):
            if run:
                far = spark.range(1).select(*[
                    (F.lit(FAR).cast(f.dataType) if f.name == at else F.lit(None).cast(f.dataType)).alias(f.name) for f in stream.schema])
                far.write.parquet(f"{folder}/end/a")
                far.write.parquet(f"{folder}/end/b")
            result.writeStream.format("parquet").outputMode("append").option(
                "checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(result.schema).parquet(f"{folder}/rows"), f"{folder}/progress"
