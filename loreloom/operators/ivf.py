"""Approximate cosine search: inverted lists around coarse centroids, residuals as product codes.

The centroids and the code books are learned on a bounded sample; every vector is
indexed.  The index is Parquet partitioned by list.  A query reads the lists of its
nearest centroids only, ranks their vectors by codes, and ranks the best again
by the vectors themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreloom import config
from loreloom.operators.vectors import cosine
from loreloom.session import new_path

#: Vectors that centroids and code books are learned on, and rounds of learning.
SAMPLE, ROUNDS = 20_000, 8
#: Numbers in a part of a product code, and values of a part.
PART, VALUES = 2, 256
#: Lists at most, queries that meet a list at a time, and vectors in a block of a list.
LISTS, QUERIES, BLOCK = 16_384, 256, 4096


@dataclass
class VectorIndex:
    """``lists`` (list, ids, codes) and ``vectors`` (id, vector) as stored; ``centroids`` and ``books`` as learned."""

    lists: DataFrame
    vectors: DataFrame
    centroids: np.ndarray
    books: np.ndarray
    ranks: np.ndarray

    def probes(self, target: float) -> int:
        """So many lists that a share ``target`` of the near vectors of the sample lies in them."""
        return int(np.quantile(self.ranks, target, method="higher")) + 1 if len(self.ranks) else len(self.centroids)


def list_ranks(sample: np.ndarray, centroids: np.ndarray, min_score: float, asked: int = 500) -> np.ndarray:
    """For vectors of the sample near one of its first ``asked``: how many lists are nearer to that one than the vector's."""
    queries = sample[:asked]
    scores = queries @ sample.T
    query, hit = np.nonzero(scores > min_score)
    query, hit = query[query != hit], hit[query != hit]
    distance = (centroids**2).sum(axis=1) - 2 * queries @ centroids.T
    order = np.argsort(np.argsort(distance, axis=1, kind="stable"), axis=1, kind="stable")
    return order[query, nearest(sample, centroids)[hit]]


def unit_rows(vectors) -> np.ndarray:
    matrix = np.asarray(list(vectors), dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest of ``centres`` for each point."""
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def learn_centres(points: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """``n`` centres by k-means; an empty one moves to the point that lies farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(n, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(points, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, column, len(centres)) for column in points.T], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        far = np.argsort(-((points - centres[own]) ** 2).sum(axis=1), kind="stable")
        empty = np.flatnonzero(counts == 0)
        centres[empty] = points[far[: len(empty)]]
    return centres


def in_parts(matrix: np.ndarray) -> np.ndarray:
    """(rows, parts, PART) of a matrix, filled up with zeros."""
    short = -matrix.shape[1] % PART
    return np.pad(matrix, ((0, 0), (0, short))).reshape(len(matrix), -1, PART)


def product_codes(residuals: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts = in_parts(residuals)
    return np.stack([nearest(parts[:, i], books[i]) for i in range(parts.shape[1])], axis=1).astype(np.uint8)


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors of one length with a norm; others are near nothing."""
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    return vectors.where((F.size("vector") == size) & (squares > 0) & (squares < float("inf")))


def build_index(vectors: DataFrame, size: int, min_score: float = config.SEMANTIC_MIN_EXTERNAL) -> VectorIndex:
    """The index of ``vectors`` (id, vector) of length ``size``; the number of lists is the root of theirs.

    ``min_score`` is what counts as near when the number of lists to read is measured.
    """
    rows = usable(vectors.select(F.col("id").cast("long"), "vector"), size)
    total = rows.count()
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]
    sample = unit_rows(drawn) if len(drawn) else np.zeros((1, size))
    centroids = learn_centres(sample, min(max(1, math.isqrt(total)), LISTS))
    parts = in_parts(sample - centroids[nearest(sample, centroids)])
    books = np.zeros((parts.shape[1], VALUES, PART))
    for i in range(parts.shape[1]):
        learned = learn_centres(parts[:, i], VALUES, seed=i)
        books[i, : len(learned)] = learned
        books[i, len(learned):] = learned[0]

    def assign(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            matrix = unit_rows(batch["vector"])
            own = nearest(matrix, centroids)
            codes = product_codes(matrix - centroids[own], books)
            yield pd.DataFrame({"list": own, "id": batch["id"], "code": [c.tobytes() for c in codes]})

    def pack(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            for own, part in batch.groupby("list"):
                for at in range(0, len(part), BLOCK):
                    piece = part.iloc[at:at + BLOCK]
                    yield pd.DataFrame({
                        "list": [own], "ids": [piece["id"].to_numpy(np.int64).tobytes()], "codes": [b"".join(piece["code"])]})

    path = new_path(vectors.sparkSession, "lists")
    coded = rows.mapInPandas(assign, "list int, id long, code binary")
    # By list and id: a list that holds a third of all vectors lies in several files.
    coded.repartitionByRange("list", "id").sortWithinPartitions("list", "id").mapInPandas(
        pack, "list int, ids binary, codes binary").write.partitionBy("list").parquet(path)
    lists = vectors.sparkSession.read.schema("ids binary, codes binary, list int").parquet(path)
    return VectorIndex(lists, rows, centroids, books, list_ranks(sample, centroids, min_score))


def index_top_k(
    index: VectorIndex, queries: DataFrame, k: int = config.LIST_LENGTH, target: float = 0.97, again: int = 4,
    min_score: float = config.SEMANTIC_MIN_EXTERNAL,
) -> DataFrame:
    """About the ``k`` nearest vectors above ``min_score`` of every query: query_id, id, score, rank.

    ``queries`` has ``query_id`` and ``vector``.  A query reads so many lists that
    a share ``target`` of the near vectors of the sample lies in them, and ``again * k`` vectors are ranked by their exact cosine, so scores
    are exact and only misses are possible.
    """
    centroids, books, size = index.centroids, index.books, index.centroids.shape[1]
    probes = index.probes(target)

    def probe(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            matrix = unit_rows(batch["vector"])
            distance = (centroids**2).sum(axis=1) - 2 * matrix @ centroids.T
            lists = np.argpartition(distance, probes - 1, axis=1)[:, :probes]
            yield pd.DataFrame({
                "query_id": np.repeat(batch["query_id"].to_numpy(np.int64), probes), "list": lists.ravel(),
                "vector": [row.tobytes() for row in np.repeat(matrix, probes, axis=0)]})

    def rank(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            for row in batch.itertuples():
                ids = np.frombuffer(row.ids, np.int64)
                codes = np.frombuffer(row.codes, np.uint8).reshape(len(ids), -1)
                asked = np.frombuffer(b"".join(row.matrix)).reshape(len(row.query_ids), -1)
                tables = np.einsum("qpx,pvx->qpv", in_parts(asked), books)
                scores = (asked @ centroids[row.list])[:, None] + sum(
                    tables[:, p][:, codes[:, p]] for p in range(codes.shape[1]))
                kept = min(again * k, len(ids))
                best = np.argpartition(-scores, kept - 1, axis=1)[:, :kept]
                yield pd.DataFrame({
                    "query_id": np.repeat(np.asarray(row.query_ids, np.int64), kept), "id": ids[best].ravel(),
                    "near": np.take_along_axis(scores, best, axis=1).ravel()})

    wanted = usable(queries.select(F.col("query_id").cast("long"), "vector"), size)
    parts = max(1, wanted.count() // QUERIES)
    probed = wanted.mapInPandas(probe, "query_id long, list int, vector binary")
    asked = probed.groupBy("list", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).agg(
        F.collect_list("query_id").alias("query_ids"), F.collect_list("vector").alias("matrix"))
    near = index.lists.join(asked.drop("part"), "list").mapInPandas(rank, "query_id long, id long, near double")
    nearest_first = W.partitionBy("query_id").orderBy(F.desc("near"), "id")
    found = near.withColumn("place", F.row_number().over(nearest_first)).where(F.col("place") <= again * k)
    exact = (
        found.select("query_id", "id").join(index.vectors, "id")
        .join(wanted.select("query_id", F.col("vector").alias("asked")), "query_id")
        .select("query_id", "id", cosine(F.col("vector"), F.col("asked")).alias("score")).where(F.col("score") > min_score)
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
