"""How rows are dealt before they widen, and how many reach Python at a time."""

import pytest
from pyspark.sql import functions as F

from loreloom.plans import QUERIES
from loreloom.session import few_rows

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(1, "a b a"), (2, "b"), (2, "b c"), (None, "c c"), (None, "c"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_terms_are_counted_where_their_document_lies(spark, folder):
    found = QUERIES["token_df"](spark, folder)
    exchanges = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]
    assert sorted(map(tuple, found.collect())) == [("a", 1, 2), ("b", 2, 3), ("c", 2, 4)]
    assert len(exchanges) == 2 and "doc_id" in exchanges[1] and "term" not in exchanges[1]


def test_whole_texts_reach_python_in_small_batches(spark, folder):
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, "10000")
        decoded = QUERIES["decoded_bytes"](spark, folder)
        assert spark.conf.get(BATCH) == "500" and decoded.where(F.col("warning") == "").count() == 6
        spark.conf.set(BATCH, "77")
        few_rows(spark)
        assert spark.conf.get(BATCH) == "77"
    finally:
        spark.conf.set(BATCH, before)
