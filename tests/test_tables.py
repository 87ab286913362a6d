"""Exact arithmetic, missing cells, dates and schema inference."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loreloom.operators import tables as tb
from loreloom import config
from loreloom.operators.tables import Aggregation, Filter, TableQuery
from loreloom.sources import files


@pytest.fixture(scope="module")
def register(spark):
    rows = [(2, "EQ-001", "A", "0.10", "2026-09-01"), (3, "EQ-002", "A", "0.20", "2026-09-02"), (4, "EQ-003", "B", "", "2026-09-03")]
    return spark.createDataFrame(rows, "row_no int, id string, line string, amount string, date string")


def test_exact_decimal(register):
    q = TableQuery(filters=[Filter("line", "eq", "A")], aggregations=[Aggregation(o, "amount") for o in ("sum", "avg", "count")])
    row = tb.query_table(register, q).first()
    assert (row["sum_amount"], row["avg_amount"], row["count_amount"]) == (Decimal("0.3"), Decimal("0.15"), 2)


def test_missing_cells_are_counted_not_zero(register):
    row = tb.query_table(register, TableQuery(aggregations=[Aggregation("avg", "amount")])).first()
    assert (row["avg_amount"], row["missing_avg_amount"]) == (Decimal("0.15"), 1)


def test_dates_between_and_natural_sort(register):
    q = TableQuery(filters=[Filter("date", "between", ["2026-09-02", "2026-09-03"])], select=["id"], sort=[("id", "desc")])
    assert [r["id"] for r in tb.query_table(register, q, "row_no").collect()] == ["EQ-003", "EQ-002"]


def test_numbers_in_text_sort_as_numbers(spark):
    df = spark.createDataFrame([(1, "EQ-10"), (2, "EQ-2"), (3, "EQ-1")], "row_no int, id string")
    q = TableQuery(select=["id"], sort=[("id", "asc")])
    assert [r["id"] for r in tb.query_table(df, q, "row_no").collect()] == ["EQ-1", "EQ-2", "EQ-10"]


def test_empty_table_gives_one_row(register):
    q = TableQuery(filters=[Filter("line", "eq", "Z")], aggregations=[Aggregation("count"), Aggregation("sum", "amount")])
    rows = tb.query_table(register, q).collect()
    assert len(rows) == 1 and rows[0]["count_rows"] == 0 and rows[0]["sum_amount"] is None


def test_text_in_a_number_column_is_an_error(register):
    q = TableQuery(aggregations=[Aggregation("sum", "id")])
    with pytest.raises(Exception, match="non-numeric"):
        tb.query_table(register, q).collect()
    assert tb.query_table(register, q, lenient=True).first()["sum_id"] is None


def test_limits_of_a_question(register):
    many = TableQuery(filters=[Filter("id", "eq", "x")] * 13)
    many.check(register.columns)
    with pytest.raises(ValueError):
        many.check(register.columns, config.TOOL_LIMITS)
    with pytest.raises(ValueError):
        TableQuery(filters=[Filter("id", "in", ["x"] * 101)]).check(register.columns, config.TOOL_LIMITS)
    with pytest.raises(ValueError):
        TableQuery(select=["nope"]).check(register.columns)


def test_rounding_half_away_from_zero(spark):
    df = spark.createDataFrame([("0.000000000001",), ("0.000000000002",)], "v string")
    up = tb.query_table(df, TableQuery(aggregations=[Aggregation("avg", "v")])).first()["avg_v"]
    down = tb.query_table(df.select(F.concat(F.lit("-"), "v").alias("v")), TableQuery(aggregations=[Aggregation("avg", "v")])).first()["avg_v"]
    assert (up, down) == (Decimal("2E-12"), Decimal("-2E-12"))


def test_over_budget_table_is_incomplete(spark):
    assert tuple(tb.answer_coverage(spark.range(201), TableQuery(limit=200)).first()) == (201, 200, False)
    # The caller's limit holds, whatever it is.
    assert tuple(tb.answer_coverage(spark.range(201), TableQuery(limit=500)).first()) == (201, 201, True)
    assert tuple(tb.answer_coverage(spark.range(201), TableQuery(limit=None)).first()) == (201, 201, True)
    q = lambda n: TableQuery(select=["id"], sort=[("id", "desc")], limit=n)
    for limit, rows, whole in ((200, 200, False), (201, 201, True), (500, 201, True), (None, 201, True)):
        found = tb.query_table(spark.range(201).repartition(3), q(limit), complete="complete").collect()
        assert [r["id"] for r in found] == list(range(200, 200 - rows, -1)) and {r["complete"] for r in found} == {whole}


def long_form(spark, records):
    return spark.createDataFrame([("t", i + 1, r) for i, r in enumerate(records)], "t string, row_no int, cells array<string>")


def test_generated_header(spark):
    rows = tb.infer_schema(long_form(spark, [["001", "12"], ["002", "30"]]), ["t"]).orderBy("position").collect()
    assert [(r["header"], r["type"], r["has_header"]) for r in rows] == [("列1", "number", False), ("列2", "number", False)]


def test_duplicate_headers_get_their_position(spark):
    rows = tb.infer_schema(long_form(spark, [["name", "name", "day"], ["a", "", "2026-01-02"]]), ["t"]).orderBy("position").collect()
    assert [(r["header"], r["type"]) for r in rows] == [("name（列1）", "text"), ("name（列2）", "unknown"), ("day", "date")]


def test_csv_records(spark):
    source = 'a;b;"c, d"\r\n;;\n1;"two\nlines";"say ""hi"""\n2;x'
    df = spark.createDataFrame([("f.csv", source), ("bad.csv", '"open;1\n2'), ("t.tsv", "a,b\tc")], "path string, text string")
    rows = {(r["path"], r["record_no"]): r["cells"] for r in files.csv_records(df).collect()}
    assert rows == {
        ("f.csv", 1): ["a", "b", "c, d"], ("f.csv", 3): ["1", "two lines", 'say "hi"'], ("f.csv", 4): ["2", "x"], ("t.tsv", 1): ["a,b", "c"],
    }
    assert [r["path"] for r in files.broken_csv(df).collect()] == ["bad.csv"]


def test_decoding(spark):
    data = [("检修".encode("utf-8"),), ("检修".encode("gb18030"),), (b"\xff\xfe" + "检".encode("utf-16-le"),), (b"\xef\xbb\xbfx",)]
    rows = spark.createDataFrame(data, "c binary").select(files.decode_bytes("c").alias("d")).select("d.*").collect()
    assert [(r["text"], r["warning"]) for r in rows] == [("检修", None), ("检修", files.GB18030_WARNING), ("检", None), ("x", None)]


def test_folder_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "sub" / "b.csv").write_text("y")
    (tmp_path / "c.bin").write_text("z")
    rows = files.folder_listing(spark, str(tmp_path), [".md", ".csv"]).orderBy("path").collect()
    assert [(r["path"], r["size"]) for r in rows] == [("a.md", 1), ("sub/b.csv", 1)]
