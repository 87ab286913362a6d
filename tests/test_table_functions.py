import random

from pyspark.sql import functions as F

from loreloom.functions import tables
from loreloom.operators import chunks


def test_chunks_from_sql_equal_the_operator(spark):
    tables.register(spark)
    rng = random.Random(1)
    bits = ["word ", "Satz。", "end. ", "\n", "# Title\n", "\n## Part two\n", "\r\n", "\t \n", "\x07", "！", "　", "é😀 ", "x" * 90, "\n\n\n\n\n"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 120)))) for i in range(150)] + [(900, None), (901, ""), (902, " \n "), (903, "a" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size, overlap in ((1200, 120), (60, 12), (25, 0)):
        wanted = chunks.chunk_documents(df, size=size, overlap=overlap).select("doc_id", "ordinal", "heading", "chunk_text")
        got = spark.sql(f"SELECT d.doc_id, c.* FROM {{df}} d, LATERAL chunk_text(d.text, {size}, {overlap}) c", df=df)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_first_rows_of_every_key(spark):
    tables.register(spark)
    df = spark.range(200).select((F.col("id") % 7).alias("k"), (200 - F.col("id")).alias("at"), "id")
    got = spark.sql("SELECT * FROM first_rows(TABLE(SELECT * FROM {df}), 'k', 'at', 2)", df=df).collect()
    assert sorted((r["k"], r["rank"], r["id"]) for r in got) == sorted(
        (k, n + 1, i) for k in range(7) for n, i in enumerate(sorted((i for i in range(200) if i % 7 == k), reverse=True)[:2]))
