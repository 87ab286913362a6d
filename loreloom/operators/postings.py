"""A stored inverted index: postings in blocks with a maximum each, searched without meeting every chunk.

Chunks are packed where they lie into shards of a fixed number of chunks.  A
block holds the postings of one term in one shard, with the largest weight in
it.  A search reads the maxima first: together they bound what any chunk of a
shard can score for a query.  The shards with the best bounds are scored first;
of the others only those that can still beat the ``k``-th score are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreloom import config
from loreloom.session import cut_lineage

#: Chunks in a shard, and queries that are scored against a shard at a time.
SHARD, QUERIES = 4096, 256
#: Shards that are scored first for each query.
FIRST = 8
#: The term of the row that holds the keys of a shard; no token is empty.
KEYS = ""
BLOCKS = "shard bigint, term string, df bigint, top double, places binary, weights binary"


@dataclass
class Index:
    """``blocks`` as stored and the number of chunks behind them."""

    blocks: DataFrame
    total: int


def pack_shard(shard: int, chunks: pa.Table, average: float, k1: float, b: float) -> pa.RecordBatch:
    """The blocks of one shard: per term the places and saturated weights of its chunks, by place."""
    chunks = chunks.combine_chunks()
    tokens = chunks.column("tokens").combine_chunks()
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    lengths = chunks.column("n_tokens").to_numpy()
    encoded = tokens.flatten().dictionary_encode()
    terms, codes = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    keys, often = np.unique(codes * len(chunks) + np.repeat(np.arange(len(chunks)), sizes), return_counts=True)
    code, place = np.divmod(keys, len(chunks))
    weight = often * (k1 + 1) / (often + k1 * ((1 - b) + b * lengths[place] / average))
    starts = np.searchsorted(code, np.arange(len(terms) + 1))
    cuts = list(zip(starts[:-1], starts[1:]))
    places = place.astype(np.int32)
    ids, ordinals = (chunks.column(c).to_numpy().astype(np.int64).tobytes() for c in ("doc_id", "ordinal"))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(terms) + 1, shard)), pa.array([KEYS, *terms], pa.string()), pa.array([0, *np.diff(starts)], pa.int64()),
        pa.array([0.0, *(np.maximum.reduceat(weight, starts[:-1]) if terms else [])], pa.float64()),
        pa.array([ids, *[places[x:y].tobytes() for x, y in cuts]], pa.binary()),
        pa.array([ordinals, *[weight[x:y].tobytes() for x, y in cuts]], pa.binary()),
    ], names=["shard", "term", "df", "top", "places", "weights"])


def build_index(corpus: DataFrame, k1: float = config.BM25_K1, b: float = config.BM25_B) -> Index:
    """The index of ``corpus`` (doc_id, ordinal, tokens, n_tokens); written once, without a shuffle."""
    total, average = corpus.agg(F.count("*"), F.avg("n_tokens")).first()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= SHARD:
                table = pa.Table.from_batches(held)
                yield pack_shard(shard, table.slice(0, SHARD), average or 1.0, k1, b)
                shard, held = shard + 1, table.slice(SHARD).to_batches()
        if sum(map(len, held)):
            yield pack_shard(shard, pa.Table.from_batches(held), average or 1.0, k1, b)

    rows = corpus.select(F.col("doc_id").cast("long"), F.col("ordinal").cast("long"), "tokens", F.col("n_tokens").cast("double"))
    return Index(cut_lineage(rows.mapInArrow(pack, BLOCKS), "index"), total)


def score_shard(rows: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    """Hits of one shard for one block of queries: of each query the best ``k`` and their ties."""
    keys = rows[rows["term"] == KEYS].iloc[0]
    doc_ids, ordinals = np.frombuffer(keys["places"], np.int64), np.frombuffer(keys["weights"], np.int64)
    blocks = rows[rows["term"] != KEYS].sort_values("term")
    queries, place = np.unique(np.concatenate([np.asarray(q, np.int64) for q in blocks["query_ids"]]), return_inverse=True)
    scores = np.zeros((len(queries), len(doc_ids)))
    matched = np.zeros((len(queries), len(doc_ids)), dtype=np.int64)
    at = 0
    for block in blocks.itertuples():
        asked = place[at:at + len(block.query_ids)]
        at += len(asked)
        here = np.ix_(asked, np.frombuffer(block.places, np.int32))
        scores[here] += np.outer(np.full(len(asked), block.idf), np.frombuffer(block.weights))
        matched[here] += 1
    good = scores > 0
    if len(doc_ids) > k:
        # Scores are rounded and ranked later: ties of the rounded k-th score stay.
        least = np.partition(scores, len(doc_ids) - k, axis=1)[:, len(doc_ids) - k]
        good &= scores >= (least - 10.0 ** -digits)[:, None]
    query, hit = np.nonzero(good)
    return pd.DataFrame({
        "query_id": queries[query], "doc_id": doc_ids[hit], "ordinal": ordinals[hit], "score": scores[query, hit],
        "matched": matched[query, hit],
    })


def index_top_k(index: Index, terms: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Exact BM25 top ``k`` of every query of ``terms`` (query_id, term): query_id, doc_id, ordinal, score, matched, rank.

    Scores are rounded to ``digits``; ties go by (doc_id, ordinal).
    """
    asked = terms.select(F.col("query_id").cast("long"), "term").distinct()
    heads = cut_lineage(
        index.blocks.select("term", "shard", "df", "top").join(asked.select("term").distinct(), "term", "left_semi"), "heads")
    idf = heads.groupBy("term").agg(F.sum("df").alias("df")).select(
        "term", F.log(1 + (index.total - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighed = cut_lineage(asked.join(idf, "term"), "asked")
    parts = max(1, weighed.select("query_id").distinct().count() // QUERIES)
    # One row for a query and a shard; chunks are not met here.
    bounds = weighed.join(heads, "term").groupBy("query_id", "shard").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"))
    best = W.partitionBy("query_id").orderBy(F.desc("bound"), "shard")
    bounds = cut_lineage(bounds.withColumn("place", F.row_number().over(best)), "bounds")

    def scored(pairs: DataFrame) -> DataFrame:
        """Hits of the pairs (query_id, shard)."""
        part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")
        met = pairs.join(weighed, "query_id").groupBy("shard", part, "term").agg(
            F.sort_array(F.collect_list("query_id")).alias("query_ids"), F.first("idf").alias("idf"))
        blocks = index.blocks.select("shard", "term", "places", "weights")
        none = F.array().cast("array<bigint>")
        keys = met.select("shard", "part").distinct().select(
            "shard", "part", F.lit(KEYS).alias("term"), none.alias("query_ids"), F.lit(0.0).alias("idf"))
        rows = met.unionByName(keys).join(blocks, ["shard", "term"])
        return rows.groupBy("shard", "part").applyInPandas(
            lambda group: score_shard(group, k, digits),
            "query_id bigint, doc_id bigint, ordinal bigint, score double, matched bigint")

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "ordinal")

    def ranked(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    first = cut_lineage(scored(bounds.where(F.col("place") <= FIRST)).withColumn("score", F.round("score", digits)), "first")
    floor = ranked(first).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    # A score may rise by half a unit of its last place when it is rounded.
    left = bounds.where(F.col("place") > FIRST).join(floor, "query_id", "left").where(
        F.col("floor").isNull() | (F.col("bound") * (1 + 1e-9) + 10.0 ** -digits >= F.col("floor")))
    rest = scored(left.select("query_id", "shard")).withColumn("score", F.round("score", digits))
    return ranked(first.unionByName(rest)).withColumn("ordinal", F.col("ordinal").cast("int"))
