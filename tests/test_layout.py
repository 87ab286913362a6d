"""Word boxes: start columns of words, and pages that are read once."""

from pyspark.sql import functions as F

from loreloom.sources import layout

BOXES = "doc_id long, page int, text string, left double, top double, width double, height double"


def test_word_starts_follow_the_words(spark):
    lines = ["", " ", "a", " a  bc ", "é|日本 x", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    for row in df.select("line", layout.word_starts(F.col("line")).alias("s")).collect():
        if row["line"] is None:
            assert row["s"] is None
            continue
        words = row["line"].split(" ")
        assert row["s"] == [len(" ".join(words[:i])) + (1 if i else 0) for i in range(len(words))]


def test_words_are_made_once_and_rows_without_a_page_drop(spark, tmp_path):
    rows = [(d, 1, f"w{i}{j}", 100.0 * j, 30.0 * i, 20.0, 20.0) for d in (1, 2, None) for i in range(3) for j in range(2)]
    spark.createDataFrame(rows, BOXES).write.parquet(str(tmp_path / "boxes"))
    cells = layout.page_cells(spark.read.parquet(str(tmp_path / "boxes")))
    assert not any("/boxes/" in f for f in cells.inputFiles())
    found = cells.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("table_no").alias("t")).collect()
    assert {tuple(r) for r in found} == {(1, 6, 6), (2, 6, 6)}
