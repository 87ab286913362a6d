"""Word boxes of scanned pages to lines, cells and table candidates; media timelines."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom import config
from loreloom.session import cut_lineage

PAGE = ("doc_id", "page")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def word_starts(lines: pd.Series) -> pd.Series:
    """Where each word of a line split at single blanks begins; one pass, a line may be a whole document."""

    def starts(line: str | None) -> list[int] | None:
        if line is None:
            return None
        found, at = [], 0
        for word in line.split(" "):
            found.append(at)
            at += len(word) + 1
        return found

    return lines.map(starts)


def page_cells(boxes: DataFrame) -> DataFrame:
    """Cells of every page in reading order; ``table_no`` marks lines that form a table.

    ``boxes`` is ``(doc_id, page, text, left, top, width, height)``, pages of any
    size.  Words whose centres follow each other closely are a line, words of a
    line with a wide gap between them are cells.  Consecutive lines of equally
    many cells that start below each other are a table candidate.  All steps are
    windows and aggregates over a page; distances are in units of its middle
    word height.
    """
    # Rows without a page belong to no layout.
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in PAGE])
    words = boxes.filter((F.trim("text") != "") & known).withColumn("center", F.col("top") + F.col("height") / 2)
    # The middle height reaches its page through windows, so words are made and dealt to pages once.
    page = W.partitionBy(*PAGE)
    words = words.withColumn("_k", F.row_number().over(page.orderBy("height"))).withColumn("_n", F.count("*").over(page))
    unit = F.when(F.col("height") > 0, F.col("height")).otherwise(F.lit(config.LAYOUT_WORD_HEIGHT))
    middle = F.max(F.when(F.col("_k") == F.floor(F.col("_n") / 2) + 1, unit)).over(page)
    words = words.withColumn("unit", middle).drop("_k", "_n")

    down = W.partitionBy(*PAGE).orderBy("center", "left", "text")
    opens = F.col("center") - F.lag("center").over(down) > F.col("unit") * config.LAYOUT_LINE_GAP
    words = words.withColumn("line", _count(opens, down) + 1)

    across = W.partitionBy(*PAGE, "line").orderBy("left", "center", "text")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(across)
    wide = gap > F.greatest(F.lit(config.LAYOUT_CELL_GAP_PIXELS), F.col("unit") * config.LAYOUT_CELL_GAP)
    cells = words.withColumn("cell", _count(wide, across) + 1).groupBy(*PAGE, "line", "cell").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("left", "center", "text"))), lambda w: w["text"]
        ), " ").alias("text"),
        F.min("left").alias("left"), F.min("top").alias("top"),
        F.max(F.col("left") + F.col("width")).alias("right"), F.max(F.col("top") + F.col("height")).alias("bottom"),
        F.min("center").alias("center"), F.first("unit").alias("unit"),
    )
    # Read for the tables and for the result.
    cells = cut_lineage(cells, "cells")
    return cells.join(_tables(cells), [*PAGE, "line"], "left").select(
        *PAGE, "line", "cell", "text", "left", "top", "right", "bottom", "table_no"
    )


def _count(flag: Column, window: W) -> Column:
    """How often ``flag`` has held up to and including this row."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(window.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")


def _tables(cells: DataFrame) -> DataFrame:
    """``(doc_id, page, line, table_no)`` of the lines that belong to a table candidate."""
    above = W.partitionBy(*PAGE, "cell").orderBy("line")
    reach = F.greatest(F.lit(config.LAYOUT_ALIGN_PIXELS), F.col("unit") * config.LAYOUT_ALIGN)
    beside = (F.lag("line").over(above) == F.col("line") - 1) & (F.abs(F.col("left") - F.lag("left").over(above)) <= reach)
    lines = cells.withColumn("beside", F.coalesce(beside, F.lit(False))).groupBy(*PAGE, "line").agg(
        F.max("cell").alias("width"), F.bool_and("beside").alias("aligned"), F.min("center").alias("center"),
        F.first("unit").alias("unit"),
    )
    down = W.partitionBy(*PAGE).orderBy("line")
    follows = (
        F.col("aligned") & (F.lag("width").over(down) == F.col("width"))
        & (F.col("center") - F.lag("center").over(down) < F.col("unit") * config.LAYOUT_ROW_GAP)
    )
    runs = lines.withColumn("run", _count(~F.coalesce(follows, F.lit(False)), down))
    tables = runs.groupBy(*PAGE, "run").agg(F.count("*").alias("rows"), F.first("width").alias("width")).filter(
        (F.col("rows") >= config.LAYOUT_TABLE_ROWS) & F.col("width").between(2, config.LAYOUT_TABLE_COLUMNS)
    )
    numbered = tables.withColumn("table_no", F.row_number().over(W.partitionBy(*PAGE).orderBy("run")))
    return runs.join(numbered.select(*PAGE, "run", "table_no"), [*PAGE, "run"]).select(*PAGE, "line", "table_no")


# --- media --------------------------------------------------------------------

def frame_times(duration_ms: Column, frames: int = 12, min_gap: int = 10_000) -> Column:
    """Evenly spaced sample times of a video, and one near its end."""
    gap = F.greatest(F.lit(min_gap), F.ceil(duration_ms / (frames - 1))).cast("bigint")
    count = F.least(F.lit(frames).cast("bigint"), F.ceil(duration_ms / gap).cast("bigint"))
    times = F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(count - 1, F.lit(0).cast("bigint"))), lambda i: i * gap)
    last = duration_ms.cast("bigint") - 1000
    more = (F.size(times) < frames) & (duration_ms > 1000) & (F.element_at(times, -1) < last)
    return F.when(duration_ms <= 0, F.array().cast("array<bigint>")).when(more, F.array_append(times, last)).otherwise(times)


def timeline(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Transcript segments and frame texts of each document in time order.

    Both are ``(doc_id, start_ms, end_ms, text)``.
    """
    return (
        segments.withColumn("kind", F.lit("transcript")).unionByName(frames.withColumn("kind", F.lit("frame_text")))
        .filter(F.trim("text") != "").orderBy("doc_id", "start_ms", "kind")
    )


def timeline_problems(segments: DataFrame, durations: DataFrame) -> DataFrame:
    """Segments that break the order, are empty or leave the duration (1 s tolerance).

    ``segments`` is ``(doc_id, segment, start_ms, end_ms, text)``; segments are
    numbered, so the previous one is found by an equi-join.
    """
    before = segments.select("doc_id", (F.col("segment") + 1).alias("segment"), F.col("start_ms").alias("_before"))
    joined = segments.join(before, ["doc_id", "segment"], "left").join(durations, "doc_id")
    problem = (
        F.when((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")), "bad_range")
        .when(F.col("end_ms") > F.col("duration_ms") + 1000, "beyond_end")
        .when(F.col("start_ms") < F.col("_before"), "out_of_order")
        .when(F.trim("text") == "", "empty_text")
    )
    return joined.withColumn("problem", problem).filter("problem IS NOT NULL").select("doc_id", "segment", "problem")
