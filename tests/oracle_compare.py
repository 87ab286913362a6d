"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def canonical(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(spark, con, folder: str, name: str, fn, sql: str | None) -> str:
    started = time.time()
    df = fn(spark, folder)
    rows = df.collect()
    spark_time = time.time() - started
    if sql is None:
        return f"rows-only {len(rows)} rows {spark_time:.1f}s"
    started = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    sql_time = time.time() - started
    got = canonical(df.columns, rows)
    want = canonical(columns, expected)
    if got[0] != want[0]:
        return f"MISMATCH columns {got[0]} / {want[0]}"
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3] if len(got[1]) < 200000 else []
        missing = [r for r in want[1] if r not in set(got[1])][:3] if len(want[1]) < 200000 else []
        return f"MISMATCH rows {len(got[1])} / {len(want[1])}\n   spark only: {extra}\n   sql only: {missing}"
    return f"ok {len(rows)} rows spark {spark_time:.1f}s sql {sql_time:.1f}s"


def main() -> None:
    root = Path(__file__).resolve().parent.parent
    sys.path.insert(0, str(root))
    import __spark_entry__ as entry

    from loreloom.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("oracle-compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(w == name or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            print(name, compare(spark, con, folder, name, fn, oracles.get(name)), flush=True)
        except Exception as error:  # report and go on with the next query
            print(name, "ERROR", str(error)[:1500], flush=True)


if __name__ == "__main__":
    main()
