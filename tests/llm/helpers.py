"""Small tables with the hard cases: nulls, empty and long texts, repeats, clashing extra columns."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # Names that the operators use themselves.
    T.StructField("size", T.StringType()), T.StructField("component", T.StringType()),
    T.StructField("_part", T.StringType()), T.StructField("shard", T.StringType()),
])


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = []
    for row in rows:
        doc_id, text, lang, source = (*row, "en", "s")[:4] if len(row) == 2 else row
        full.append((doc_id, text, lang, source, len(text) if text else None, "x", None, "y", "z"))
    return spark.createDataFrame(full, DOCS)


def words(rng: random.Random, n: int, vocabulary: int = 2000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
