"""Exact questions over tables: filter, project, group, aggregate, sort, limit.

A table is any DataFrame.  Cells are compared the way a register is read: text
equality for ``eq``/``in``/``contains``, and for ranges dates as dates and
everything else as exact decimals with 12 places.  A blank is missing, never 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.functions.text import is_blank, strip

EXACT = T.DecimalType(38, 12)
NUMBER = r"^[+-]?\d+(?:\.\d{1,12})?$"
DATE = r"^\d{4}-\d{2}-\d{2}(?:T.*)?$"
OPERATORS = ("eq", "neq", "contains", "in", "gt", "gte", "lt", "lte", "between")
AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: object


@dataclass(frozen=True)
class Aggregation:
    op: str
    column: str | None = None
    name: str | None = None

    @property
    def alias(self) -> str:
        return self.name or f"{self.op}_{self.column or 'rows'}"


@dataclass(frozen=True)
class TableQuery:
    """One question; ``limit`` is the number of rows wanted, None for all."""

    filters: list[Filter] = field(default_factory=list)
    select: list[str] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregations: list[Aggregation] = field(default_factory=list)
    sort: list[tuple[str, str]] = field(default_factory=list)
    limit: int | None = 100

    def check(self, columns: list[str], limits: dict[str, int] | None = None) -> None:
        """Raise on unknown names and operators, and on more parts than ``limits`` (``config.TOOL_LIMITS``) allows."""
        allowed = limits or {}

        def need(ok: bool, message: str) -> None:
            if not ok:
                raise ValueError(message)

        for part in ("filters", "select", "group_by", "aggregations", "sort"):
            most = allowed.get(part)
            need(most is None or len(getattr(self, part)) <= most, f"at most {most} in {part}")
        names = [a.alias for a in self.aggregations]
        need(len(set(names)) == len(names), "result names must differ")
        for f in self.filters:
            need(f.op in OPERATORS, f"unknown operator {f.op}")
            most = allowed.get("values")
            need(f.op != "in" or most is None or len(f.value) <= most, f"at most {most} values in a set")
            need(f.op != "between" or len(f.value) == 2, "a range has two bounds")
        for a in self.aggregations:
            need(a.op in AGGREGATES, f"unknown aggregation {a.op}")
            need(a.op == "count" or a.column is not None, f"{a.op} needs a column")
        used = [f.column for f in self.filters] + self.select + self.group_by
        used += [a.column for a in self.aggregations if a.column]
        for name in used:
            need(name in columns, f"unknown column {name}")
        result = self.group_by + names if self.aggregations else (self.select or columns)
        for name, direction in self.sort:
            need(name in result and direction in ("asc", "desc"), f"cannot sort by {name} {direction}")


def exact_number(df: DataFrame, name: str, lenient: bool = False) -> Column:
    """A cell as an exact decimal, null when blank; other text is an error unless lenient."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(name).cast(EXACT)
    cell = strip(F.col(name).cast("string"))
    other = (
        F.lit(None).cast(EXACT)
        if lenient
        else F.raise_error(F.concat(F.lit(f"column {name} holds a non-numeric cell: "), cell)).cast(EXACT)
    )
    return (
        F.when(is_blank(F.col(name).cast("string")), F.lit(None).cast(EXACT))
        .when(cell.rlike(NUMBER), cell.try_cast(EXACT))
        .otherwise(other)
    )


def _compare(df: DataFrame, name: str, op: str, bound: object, lenient: bool) -> Column:
    text = str(bound)
    is_date = bool(re.match(DATE, text))
    kind = df.schema[name].dataType
    # On typed columns the bare column meets a literal of its type, which the
    # scan can use; cells of text are parsed first.
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        left, right = F.col(name), F.lit(text).cast(kind)
    elif isinstance(kind, T.NumericType) and not is_date:
        left = F.col(name)
        right = F.lit(Decimal(text)) if isinstance(kind, T.DecimalType) else F.lit(text).cast(
            kind if re.match(r"^[+-]?\d+$", text) else "double"
        )
    elif is_date:
        cell = F.col(name).cast("string")
        left = F.when(cell.rlike(DATE), F.try_to_timestamp(cell))
        right = F.to_timestamp(F.lit(text))
        if not lenient:
            wrong = ~is_blank(cell) & ~cell.rlike(DATE)
            left = F.when(wrong, F.raise_error(F.lit(f"column {name} is not a date"))).otherwise(left)
    else:
        left, right = exact_number(df, name, lenient), F.lit(text).cast(EXACT)
    return {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right}[op]


def predicate(df: DataFrame, f: Filter, lenient: bool = False) -> Column:
    # Typed literals keep plain equality on typed columns pushable to the scan.
    cell = F.col(f.column)
    numeric = isinstance(df.schema[f.column].dataType, T.NumericType)
    same = lambda v: cell == F.lit(v) if numeric and isinstance(v, (int, float)) else cell.cast("string") == F.lit(str(v))
    if f.op == "eq":
        return same(f.value)
    if f.op == "neq":
        missing_differs = cell.isNull() if str(f.value) != "" else F.lit(False)
        return missing_differs | ~same(f.value)
    if f.op == "contains":
        return F.contains(cell.cast("string"), F.lit(str(f.value)))
    if f.op == "in":
        if numeric and all(isinstance(v, (int, float)) for v in f.value):
            return cell.isin(list(f.value))
        return cell.cast("string").isin([str(v) for v in f.value])
    text = isinstance(df.schema[f.column].dataType, T.StringType)
    present = ~is_blank(cell) if text else cell.isNotNull()
    if f.op == "between":
        low, high = f.value
        return present & _compare(df, f.column, "gte", low, lenient) & _compare(df, f.column, "lte", high, lenient)
    return present & _compare(df, f.column, f.op, f.value, lenient)


def filter_table(df: DataFrame, filters: list[Filter], lenient: bool = False) -> DataFrame:
    if not filters:
        return df
    return df.filter(reduce(lambda a, b: a & b, [predicate(df, f, lenient) for f in filters]))


def _aggregate(df: DataFrame, a: Aggregation, lenient: bool) -> Column:
    if a.op == "count":
        return (F.count("*") if a.column is None else F.count_if(~is_blank(F.col(a.column).cast("string")))).alias(a.alias)
    number = exact_number(df, a.column, lenient)
    if a.op == "avg":
        return F.round(F.avg(number), 12).cast(EXACT).alias(a.alias)
    return {"sum": F.sum, "min": F.min, "max": F.max}[a.op](number).cast(EXACT).alias(a.alias)


def natural_key(col: Column) -> Column:
    """Text order with runs of digits compared as numbers."""
    padded = F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), r"(\d+)", "0" * 20 + "$1")
    return F.collate(F.regexp_replace(padded, r"\d*(\d{20})", "$1"), "zh")


def _sort(df: DataFrame, sort: list[tuple[str, str]]) -> list[Column]:
    keys = []
    for name, direction in sort:
        numeric = isinstance(df.schema[name].dataType, T.NumericType)
        key = F.col(name) if numeric else natural_key(F.col(name))
        keys.append(key.desc() if direction == "desc" else key.asc())
    return keys


def matched_table(df: DataFrame, q: TableQuery, row_number: str | None = None, lenient: bool = False) -> DataFrame:
    """The whole answer, before sort and limit."""
    q.check(df.columns)
    rows = filter_table(df, q.filters, lenient)
    if q.aggregations:
        missing = [
            F.count_if(is_blank(F.col(a.column).cast("string"))).alias(f"missing_{a.alias}")
            for a in q.aggregations if a.column
        ]
        return rows.groupBy(*q.group_by).agg(*[_aggregate(df, a, lenient) for a in q.aggregations], *missing)
    chosen = q.select or [c for c in df.columns if c != row_number]
    if row_number:
        return rows.select(*chosen, F.col(row_number).alias("source_row_number"))
    return rows.select(*chosen)


def query_table(
    df: DataFrame, q: TableQuery, row_number: str | None = None, lenient: bool = False, complete: str | None = None
) -> DataFrame:
    """Sorted and limited answer; ties fall to the source row number or the group keys.

    ``complete`` names a column that tells with every row whether the limit cut
    the answer.
    """
    result = matched_table(df, q, row_number, lenient)
    tie = q.group_by if q.aggregations else (["source_row_number"] if row_number else [])
    order = [*_sort(result, q.sort), *tie]
    ordered = result.orderBy(*order) if order else result
    if q.limit is None:
        return ordered.withColumn(complete, F.lit(True)) if complete else ordered
    limit = max(0, q.limit)
    if complete is None:
        return ordered.limit(limit)
    # One row more tells whether there are more; the windows see limit + 1 rows at most.
    first = ordered.limit(limit + 1)
    place = W.orderBy(*order) if order else W.orderBy(F.lit(1))
    return first.withColumns(
        {"_n": F.row_number().over(place), complete: F.count("*").over(W.partitionBy()) <= limit}
    ).filter(F.col("_n") <= limit).orderBy("_n").drop("_n")


def answer_coverage(df: DataFrame, q: TableQuery, lenient: bool = False) -> DataFrame:
    """One row: result rows, rows returned under the limit and whether that is all."""
    limit = F.lit(q.limit).cast("long")
    return matched_table(df, q, None, lenient).agg(F.count("*").alias("result_rows")).select(
        "result_rows",
        F.least("result_rows", limit).alias("returned_rows"),
        F.coalesce(F.col("result_rows") <= limit, F.lit(True)).alias("complete"),
    )


def record_quality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows checked, rows with every cell filled, missing cells per column."""
    names = columns or df.columns
    blank = {c: is_blank(F.col(c).cast("string")) for c in names}
    full = reduce(lambda a, b: a & b, [~b for b in blank.values()])
    return df.agg(
        F.count("*").alias("checked_rows"),
        F.count_if(full).alias("complete_rows"),
        *[F.count_if(b).alias(f"missing_{c}") for c, b in blank.items()],
    )


def column_profile(df: DataFrame, row_number: str, columns: list[str] | None = None, values: int = 8, chars: int = 100) -> DataFrame:
    """Per column: inferred type, distinct and missing counts, first distinct values.

    Values are counted per (column, value) first, so a value that fills a third
    of the table travels as one row per task.
    """
    names = columns or [c for c in df.columns if c != row_number]
    long = df.select(F.col(row_number).alias("_row"), *[F.col(c).cast("string").alias(c) for c in names]).unpivot(
        ["_row"], names, "column", "value"
    )
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"), F.min("_row").alias("first_row"))
    filled = ~is_blank(F.col("value"))
    trimmed = strip(F.col("value"))
    summary = counted.groupBy("column").agg(
        F.count_if(filled).alias("distinct_values"),
        F.coalesce(F.sum(F.when(~filled, F.col("n"))), F.lit(0)).alias("missing_values"),
        F.bool_and(F.when(filled, trimmed.rlike(r"^[-+]?\d+(?:\.\d+)?$"))).alias("all_numbers"),
        F.bool_and(F.when(filled, trimmed.rlike(r"^\d{4}-\d{2}-\d{2}(?:[ T].*)?$"))).alias("all_dates"),
        F.max(F.when(filled, F.length("value"))).alias("longest"),
    )
    order = W.partitionBy("column").orderBy("first_row", "value")
    preview = (
        counted.filter(filled)
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= values)
        .groupBy("column")
        .agg(F.array_sort(F.collect_list(F.struct("_n", F.substring("value", 1, chars).alias("v")))).alias("p"))
        .select("column", F.transform("p", lambda s: s["v"]).alias("preview"))
    )
    kind = (
        F.when(F.col("distinct_values") == 0, "unknown")
        .when(F.col("all_numbers"), "number")
        .when(F.col("all_dates"), "date")
        .otherwise("text")
    )
    return summary.join(preview, "column", "left").select(
        "column", kind.alias("type"), "distinct_values", "missing_values", "preview",
        ((F.col("distinct_values") <= values) & (F.coalesce("longest", F.lit(0)) <= chars)).alias("values_complete"),
    )


def infer_schema(rows: DataFrame, key: list[str]) -> DataFrame:
    """Names and types of the columns of many tables in long form.

    ``rows`` has the table key, ``row_no`` (from 1) and ``cells``.  The first
    record names the columns when it is as wide as the table, has at least two
    filled cells and none starts like a number or date; otherwise columns get
    generated names.  Duplicate names get their position.
    """
    width = rows.groupBy(*key).agg(F.max(F.size("cells")).alias("width"))
    first = rows.filter("row_no = 1").select(*key, F.col("cells").alias("first"))
    filled = F.filter("first", lambda v: strip(v) != "")
    header = (
        (F.size("first") == F.col("width")) & (F.size(filled) >= 2)
        & F.forall(filled, lambda v: ~strip(v).rlike(r"^[-+]?\d|^\d{4}[-/]"))
    )
    generated = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.concat(F.lit("列"), i.cast("string")))
    labels = F.transform("names", lambda v, i: F.when(strip(v) == "", F.concat(F.lit("列"), (i + 1).cast("string"))).otherwise(strip(v)))
    heads = (
        width.join(first, key)
        .withColumn("has_header", header)
        .withColumn("names", F.when(F.col("has_header"), F.col("first")).otherwise(generated))
        .withColumn("labels", labels)
        .withColumn(
            "headers",
            F.transform(
                "labels",
                lambda v, i: F.when(
                    F.size(F.filter("names", lambda n: strip(n) == v)) > 1,
                    F.concat(v, F.lit("（列"), (i + 1).cast("string"), F.lit("）")),
                ).otherwise(v),
            ),
        )
    )
    cells = rows.select(*key, "row_no", F.posexplode("cells").alias("position", "value")).filter(strip(F.col("value")) != "")
    patterns = {"numbers": r"^[-+]?\d+(?:\.\d+)?$", "dates": r"^\d{4}-\d{2}-\d{2}(?:[ T].*)?$"}
    fits = {name: strip(F.col("value")).rlike(pattern) for name, pattern in patterns.items()}
    # Tested with and without the first record; which one counts is known per table, so cells meet no join.
    typed = cells.groupBy(*key, "position").agg(
        *[F.bool_and(fit).alias(f"all_{name}") for name, fit in fits.items()],
        *[F.bool_and(F.when(F.col("row_no") > 1, fit)).alias(f"rest_{name}") for name, fit in fits.items()],
    )
    columns = heads.select(*key, "has_header", F.posexplode("headers").alias("position", "header"))
    tested = {name: F.when(F.col("has_header"), F.col(f"rest_{name}")).otherwise(F.col(f"all_{name}")) for name in patterns}
    kind = (
        F.when(tested["numbers"].isNull(), "unknown").when(tested["numbers"], "number")
        .when(tested["dates"], "date").otherwise("text")
    )
    return columns.join(typed, [*key, "position"], "left").select(
        *key, "position", "header", kind.alias("type"), "has_header"
    )


def completeness(rows: DataFrame, key: list[str]) -> DataFrame:
    """Proof that the fragments of a table hold every row exactly once.

    ``rows`` has the key, ``row_no``, ``cells``, ``headers``, ``total_rows`` and
    ``confirmed`` (review state where a review is needed).  Duplicate row numbers
    with equal cells are reported but counted once.
    """
    fingerprint = F.xxhash64(F.to_json(F.struct("cells")))
    per_row = rows.groupBy(*key, "row_no").agg(
        F.count("*").alias("copies"),
        F.min(fingerprint).alias("low"), F.max(fingerprint).alias("high"),
        F.min(F.size("cells") == F.size("headers")).alias("wide"),
        F.min("confirmed").alias("confirmed"),
        F.min("total_rows").alias("min_total"), F.max("total_rows").alias("max_total"),
        F.min(F.to_json(F.struct("headers"))).alias("min_head"), F.max(F.to_json(F.struct("headers"))).alias("max_head"),
    )
    checks = per_row.groupBy(*key).agg(
        F.count("*").alias("distinct_rows"), F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"),
        F.sum(F.col("copies") - 1).alias("duplicate_rows"), F.max("max_total").alias("total_rows"),
        F.bool_and((F.col("low") == F.col("high"))).alias("agree"),
        F.bool_and("wide").alias("wide"), F.bool_and("confirmed").alias("confirmed"),
        (F.min("min_total") == F.max("max_total")).alias("same_total"),
        (F.min("min_head") == F.max("max_head")).alias("same_headers"),
    )
    whole = (F.col("distinct_rows") == F.col("total_rows")) & (F.col("first_row") == 1) & (F.col("last_row") == F.col("total_rows"))
    return checks.withColumn("gap", ~whole).withColumn(
        "complete", whole & F.col("agree") & F.col("wide") & F.col("confirmed") & F.col("same_total") & F.col("same_headers")
    )


def paginate(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page with ``total`` and the offset of the next page (null at the end)."""
    total = df.select(F.count("*")).scalar()
    end = F.lit(offset + limit)
    return df.orderBy(*order).offset(offset).limit(limit).select(
        "*", total.alias("total"), F.when(end < total, end).alias("next_offset")
    )


def column_letters(index: Column) -> Column:
    """Spreadsheet letters of a zero-based column index."""
    start = F.struct((index + 1).cast("int").alias("n"), F.lit("").alias("s"))
    folded = F.aggregate(
        F.sequence(F.lit(1), F.lit(7)), start,
        lambda acc, _: F.when(acc["n"] <= 0, acc).otherwise(
            F.struct(
                F.floor((acc["n"] - 1) / 26).cast("int").alias("n"),
                F.concat(F.chr((F.lit(65) + (acc["n"] - 1) % 26).cast("long")), acc["s"]).alias("s"),
            )
        ),
    )
    return folded["s"]


def serial_date(days: Column, date1904: bool = False, time_only: bool = False) -> Column:
    """Spreadsheet serial number to ISO text; whole days without a time."""
    days = days.cast("double")
    epoch = (
        F.lit("1904-01-01") if date1904
        else F.when(days < 60, F.lit("1899-12-31")).otherwise(F.lit("1899-12-30"))
    )
    moment = F.timestamp_millis(
        F.unix_millis(F.to_timestamp(epoch)) + F.floor(days * 86400000 + 0.5).cast("long")
    )
    if time_only:
        return F.date_format(moment, "HH:mm:ss")
    return F.when(days == F.floor(days), F.date_format(moment, "yyyy-MM-dd")).otherwise(
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
    )
