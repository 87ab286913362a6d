"""Table questions over the order tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from loreloom.operators import tables as tb
from loreloom.operators.tables import Aggregation, Filter, TableQuery
from loreloom.plans.registry import Tables, query

REPORT = TableQuery(
    filters=[
        Filter("l_returnflag", "in", ["A", "R"]),
        Filter("l_quantity", "between", [5, 40]),
        Filter("l_shipdate", "gte", "1996-06-01"),
        Filter("l_linestatus", "neq", "X"),
    ],
    group_by=["l_returnflag", "l_linestatus"],
    aggregations=[
        Aggregation("count"), Aggregation("sum", "l_extendedprice"), Aggregation("avg", "l_discount"),
        Aggregation("min", "l_tax"), Aggregation("max", "l_quantity"), Aggregation("count", "l_suppkey"),
    ],
    sort=[("l_returnflag", "desc"), ("l_linestatus", "asc")],
    limit=200,
)


@query(
    "table_filter_agg",
    """SELECT l_returnflag, l_linestatus, count(*) AS count_rows,
      round(sum(l_extendedprice::DECIMAL(38,12))::DOUBLE, 2) AS sum_l_extendedprice,
      round((sum(l_discount::DECIMAL(38,12)) / count(*))::DOUBLE, 9) AS avg_l_discount,
      min(l_tax) AS min_l_tax, max(l_quantity) AS max_l_quantity, count(l_suppkey) AS count_l_suppkey,
      0::BIGINT AS missing_l_extendedprice
    FROM lineitem WHERE l_returnflag IN ('A','R') AND l_quantity BETWEEN 5 AND 40
      AND l_shipdate >= TIMESTAMP '1996-06-01' AND l_linestatus <> 'X' GROUP BY ALL""",
)
def table_filter_agg(t: Tables):
    answer = tb.query_table(t.lineitem, REPORT)
    return answer.select(
        "l_returnflag", "l_linestatus", "count_rows",
        F.round(F.col("sum_l_extendedprice").cast("double"), 2).alias("sum_l_extendedprice"),
        F.round(F.col("avg_l_discount").cast("double"), 9).alias("avg_l_discount"),
        F.col("min_l_tax").cast("double").alias("min_l_tax"),
        F.col("max_l_quantity").cast("double").alias("max_l_quantity"),
        "count_l_suppkey", F.col("missing_sum_l_extendedprice").alias("missing_l_extendedprice"),
    )


@query(
    "table_select_sorted",
    """SELECT p_name, p_brand, p_size, p_partkey AS source_row_number FROM part
    WHERE contains(p_name, 'ring') AND p_size > 20
    ORDER BY regexp_extract(p_brand, '[0-9]+')::INT DESC, p_partkey LIMIT 100""",
)
def table_select_sorted(t: Tables):
    q = TableQuery(
        filters=[Filter("p_name", "contains", "ring"), Filter("p_size", "gt", 20)],
        select=["p_name", "p_brand", "p_size"], sort=[("p_brand", "desc")],
    )
    return tb.query_table(t.part, q, row_number="p_partkey")


@query(
    "table_answer_coverage",
    """SELECT count(*) AS result_rows, least(count(*), 500) AS returned_rows, count(*) <= 500 AS complete
    FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 250000""",
)
def table_answer_coverage(t: Tables):
    q = TableQuery(filters=[Filter("o_orderstatus", "eq", "F"), Filter("o_totalprice", "lt", 250000)], limit=500)
    return tb.answer_coverage(t.orders, q)


@query(
    "table_missing",
    """SELECT count(*) AS checked_rows, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL AND trim(lang) <> '') AS complete_rows,
      count(*) FILTER (trim(lang) = '') AS missing_lang, count(*) FILTER (quality IS NULL) AS missing_quality,
      count(*) FILTER (toxic IS NULL) AS missing_toxic
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def table_missing(t: Tables):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return tb.record_quality(joined, ["lang", "quality", "toxic"])


@query(
    "column_profile",
    """WITH long AS (
      UNPIVOT (SELECT o_orderkey AS r, o_orderstatus::VARCHAR AS o_orderstatus, o_orderpriority::VARCHAR AS o_orderpriority,
               strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_custkey::VARCHAR AS o_custkey FROM orders)
      ON o_orderstatus, o_orderpriority, o_orderdate, o_custkey INTO NAME col VALUE v),
    c AS (SELECT col, v, count(*) AS n, min(r) AS f FROM long GROUP BY ALL),
    p AS (SELECT col, string_agg(substr(v, 1, 100), '|' ORDER BY f, v) AS preview FROM
      (SELECT *, row_number() OVER (PARTITION BY col ORDER BY f, v) AS k FROM c WHERE trim(v) <> '') WHERE k <= 8 GROUP BY col)
    SELECT c.col AS column_name,
      CASE WHEN bool_and(regexp_full_match(trim(v), '[-+]?\\d+(?:\\.\\d+)?')) THEN 'number'
           WHEN bool_and(regexp_full_match(trim(v), '\\d{4}-\\d{2}-\\d{2}(?:[ T].*)?')) THEN 'date' ELSE 'text' END AS type,
      count(*) FILTER (trim(v) <> '') AS distinct_values, coalesce(sum(n) FILTER (trim(v) = ''), 0)::BIGINT AS missing_values,
      any_value(p.preview) AS preview, count(*) FILTER (trim(v) <> '') <= 8 AND max(length(v)) <= 100 AS values_complete
    FROM c JOIN p USING (col) GROUP BY c.col""",
)
def column_profile(t: Tables):
    source = t.orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_custkey",
    )
    profile = tb.column_profile(source, "o_orderkey")
    return profile.select(
        F.col("column").alias("column_name"), "type", "distinct_values", "missing_values",
        F.array_join("preview", "|").alias("preview"), "values_complete",
    )


def register_rows(t: Tables):
    """Four tables as registers of text cells with a header record."""
    shapes = {
        "part": ("p_partkey", ["p_name", "p_brand", "p_type", "p_size"]),
        "supplier": ("s_suppkey", ["s_name", "s_nationkey"]),
        "customer": ("c_custkey", ["c_name", "c_nationkey", "c_mktsegment"]),
        "orders": ("o_orderkey", ["o_custkey", "o_orderstatus", "o_orderdate"]),
    }
    parts = []
    for name, (key, columns) in shapes.items():
        df = getattr(t, name)
        cell = lambda c: (F.date_format(c, "yyyy-MM-dd") if c == "o_orderdate" else F.col(c).cast("string"))
        parts.append(df.select(
            F.lit(name).alias("table_id"), (F.col(key) + 2).alias("row_no"),
            F.array(F.col(key).cast("string"), *[cell(c) for c in columns]).alias("cells"),
        ))
        if name != "orders":  # orders has no header record
            # The header record rides on the row with key 0 of the table.
            parts.append(df.filter(F.col(key) == 0).select(
                F.lit(name).alias("table_id"), F.lit(1).cast("bigint").alias("row_no"),
                F.array(*[F.lit(c) for c in [key, *columns]]).alias("cells"),
            ))
        else:
            parts[-1] = parts[-1].withColumn("row_no", F.col("row_no") - 1)
    return reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "table_schema",
    """WITH cols AS (
      SELECT 'part' AS table_id, unnest(['p_partkey','p_name','p_brand','p_type','p_size']) AS header, generate_subscripts([1,2,3,4,5], 1) - 1 AS position, unnest(['number','text','text','text','number']) AS type, true AS has_header, (SELECT count(*) FROM part) AS n
      UNION ALL SELECT 'supplier', unnest(['s_suppkey','s_name','s_nationkey']), generate_subscripts([1,2,3], 1) - 1, unnest(['number','text','number']), true, (SELECT count(*) FROM supplier)
      UNION ALL SELECT 'customer', unnest(['c_custkey','c_name','c_nationkey','c_mktsegment']), generate_subscripts([1,2,3,4], 1) - 1, unnest(['number','text','number','text']), true, (SELECT count(*) FROM customer)
      UNION ALL SELECT 'orders', unnest(['列1','列2','列3','列4']), generate_subscripts([1,2,3,4], 1) - 1, unnest(['number','number','text','date']), false, (SELECT count(*) FROM orders))
    SELECT table_id, position::INT AS position, header, type, has_header FROM cols WHERE n > 0""",
)
def table_schema(t: Tables):
    return tb.infer_schema(register_rows(t), ["table_id"])


@query(
    "table_completeness",
    """SELECT l_orderkey, count(DISTINCT l_linenumber) AS distinct_rows, sum(1) - count(DISTINCT l_linenumber) AS duplicate_rows,
      max(l_linenumber)::INT AS total_rows,
      NOT (count(DISTINCT l_linenumber) = max(l_linenumber) AND min(l_linenumber) = 1) AS gap,
      (count(DISTINCT l_linenumber) = max(l_linenumber) AND min(l_linenumber) = 1 AND count(*) = count(DISTINCT l_linenumber)
        AND bool_and(l_returnflag <> 'R')) OR
      (count(DISTINCT l_linenumber) = max(l_linenumber) AND min(l_linenumber) = 1 AND bool_and(l_returnflag <> 'R')
        AND count(DISTINCT (l_linenumber, l_partkey, l_quantity)) = count(DISTINCT l_linenumber)) AS complete
    FROM lineitem GROUP BY l_orderkey""",
)
def table_completeness(t: Tables):
    """Order lines as the rows of one small table per order."""
    total = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("total_rows"))
    rows = t.lineitem.join(total, "l_orderkey").select(
        "l_orderkey", F.col("l_linenumber").alias("row_no"),
        F.array(F.col("l_partkey").cast("string"), F.col("l_quantity").cast("string")).alias("cells"),
        F.array(F.lit("part"), F.lit("quantity")).alias("headers"),
        "total_rows", (F.col("l_returnflag") != "R").alias("confirmed"),
    )
    return tb.completeness(rows, ["l_orderkey"]).select(
        "l_orderkey", "distinct_rows", "duplicate_rows", "total_rows", "gap", "complete"
    )


@query(
    "paginate",
    """SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS total, CASE WHEN 60 < (SELECT count(*) FROM orders) THEN 60 END AS next_offset
    FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""",
)
def paginate(t: Tables):
    page = tb.paginate(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 40, 20)
    return page


@query(
    "topk_per_group",
    """SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
)
def topk_per_group(t: Tables):
    from pyspark.sql import Window as W

    order = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query(
    "spreadsheet_values",
    """SELECT p_partkey, strftime(DATE '1899-12-30' + (20000 + p_partkey)::INT, '%Y-%m-%d') AS iso_date,
      strftime(TIMESTAMP '1899-12-30' + to_milliseconds((20000 + p_partkey) * 86400000 + 21600000), '%Y-%m-%d %H:%M:%S') AS iso_time,
      CASE WHEN p_partkey < 26 THEN chr((65 + p_partkey)::INT)
           WHEN p_partkey < 702 THEN chr((64 + p_partkey // 26)::INT) || chr((65 + p_partkey % 26)::INT)
           ELSE chr((65 + (p_partkey - 702) // 676 % 26)::INT) || chr((65 + (p_partkey - 702) // 26 % 26)::INT) || chr((65 + p_partkey % 26)::INT) END AS letters
    FROM part""",
)
def spreadsheet_values(t: Tables):
    days = F.lit(20000) + F.col("p_partkey")
    return t.part.select(
        "p_partkey", tb.serial_date(days).alias("iso_date"),
        tb.serial_date(days + F.lit(0.25)).alias("iso_time"), tb.column_letters(F.col("p_partkey")).alias("letters"),
    )
