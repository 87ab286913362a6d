"""Stored indexes against plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.operators import ivf, postings, retrieval, vectors


def chunk_rows(rng, n):
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    for i in range(n):
        tokens = rng.choices(common, k=rng.randint(0, 20)) + rng.choices(rare, k=rng.randint(0, 4))
        yield i // 3, i % 3, tokens, len(tokens)


@pytest.mark.parametrize("shard", [7, 64, 4096])
def test_index_finds_the_rows_of_the_plain_form(spark, monkeypatch, shard):
    monkeypatch.setattr(postings, "SHARD", shard)
    monkeypatch.setattr(postings, "QUERIES", 5)
    rng = random.Random(shard)
    corpus = spark.createDataFrame(list(chunk_rows(rng, 400)), "doc_id long, ordinal int, tokens array<string>, n_tokens int").repartition(3)
    terms = spark.createDataFrame(
        [(q, t) for q in range(17) for t in {f"c{rng.randrange(14)}" for _ in range(4)} | {f"r{rng.randrange(320)}" for _ in range(2)}],
        "query_id long, term string")
    columns = ["query_id", "doc_id", "ordinal", "score", "matched", "rank"]
    for k in (1, 10, 1000):
        plain = retrieval.top_k(retrieval.bm25(corpus, terms).withColumn("score", F.round("score", 6)), k)
        found = postings.index_top_k(postings.build_index(corpus), terms, k)
        assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_index_of_nothing(spark):
    corpus = spark.createDataFrame([], "doc_id long, ordinal int, tokens array<string>, n_tokens int")
    terms = spark.createDataFrame([(1, "a")], "query_id long, term string")
    assert postings.index_top_k(postings.build_index(corpus), terms, 5).count() == 0
    empty = spark.createDataFrame([(1, 0, [], 0)], corpus.schema)
    assert postings.index_top_k(postings.build_index(empty), terms, 5).count() == 0


def clustered(rng, n, size=24):
    centres = rng.normal(size=(n // 40, size))
    points = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, size))
    points[: n // 3] = centres[0] + 0.3 * rng.normal(size=(n // 3, size))  # a third of all in one place
    return points


def test_vector_index_recall_and_fewer_lists(spark):
    rng = np.random.default_rng(4)
    points = clustered(rng, 3000)
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(9000, None), (9001, [0.0] * 24), (9002, [1.0] * 3)]
    corpus = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = corpus.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = ivf.build_index(corpus, 24, min_score=0.6)
    found = {(r["query_id"], r["id"]): r["score"] for r in ivf.index_top_k(index, asked, k=20, min_score=0.6).collect()}
    model = F.lit("m").alias("model")
    exact = vectors.vector_top_k(corpus.where("size(vector) = 24").select("id", model, "vector"), asked.where("size(vector) = 24").select("query_id", model, "vector"), 20, 0.6)
    wanted = {(r["query_id"], r["id"]): r["score"] for r in exact.collect()}
    assert len(wanted.keys() & found.keys()) >= 0.9 * len(wanted)
    assert all(found[p] == pytest.approx(wanted[p]) for p in wanted.keys() & found.keys())
    assert index.probes(0.97) < len(index.centroids) / 2
    held = sum(len(r["ids"]) // 8 for r in index.lists.select("ids").collect())
    assert held == 3000


def test_vector_index_of_nothing(spark):
    none = spark.createDataFrame([], "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    assert ivf.index_top_k(ivf.build_index(none, 2), asked).count() == 0
