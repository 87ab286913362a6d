"""Near-duplicate embeddings through binary codes of iterative quantisation.

A rotation of the principal axes is learned on a bounded sample so that the
signs of the rotated coordinates lose little (alternating least squares).  All
vectors get a code; vectors of one label and length whose codes agree in at
least one of the tables' blocks meet, and the cosine of the original vectors
decides in double precision.

Equal vectors are one entry with a count.  A bucket is cut into tiles of at
most two chunks of ``CHUNK`` entries, so that no task holds more; a tile
reports per entry its number of links and one edge towards its component, never
the pairs.  A pair that meets in several blocks counts in the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import components
from loreloom.session import cut_lineage

#: Most vectors that a rotation is learned on, taken in the order of a hash of the id.
SAMPLE_ROWS = 20_000
ROUNDS = 50
LEAST = 0.93
CODE_BITS = 64
BLOCK_BITS = 8
CHUNK = 1024


def learn_rotation(sample: np.ndarray, bits: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (length x bits) of iterative quantisation."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    _, _, axes = np.linalg.svd(unit - mean, full_matrices=len(unit) < unit.shape[1])
    axes = axes[:bits].T
    seen = (unit - mean) @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(ROUNDS):
        codes = np.where(seen @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ seen)
        rotation = (left @ right).T
    return mean, axes @ rotation


def encode(batches: Iterator[pd.DataFrame], models: dict[int, tuple[np.ndarray, np.ndarray]]):
    for batch in batches:
        codes = np.zeros(len(batch), dtype=np.uint64)
        lengths = batch["vector"].map(len).to_numpy()
        for length in np.unique(lengths):
            here = np.flatnonzero(lengths == length)
            vectors = np.stack(batch["vector"].iloc[here].to_list()).astype(np.float64)
            mean, projection = models[int(length)]
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            signs = (unit - mean) @ projection >= 0
            whole = np.zeros((len(here), 64), dtype=bool)
            whole[:, : signs.shape[1]] = signs
            codes[here] = np.packbits(whole, axis=1).view(">u8").ravel()
        yield batch.assign(code=codes.view(np.int64))


def first_common_block(a: np.ndarray, b: np.ndarray, blocks: int) -> np.ndarray:
    """Number of the first block in which codes ``a`` (rows) and ``b`` (columns) agree."""
    first = np.full((len(a), len(b)), blocks, dtype=np.int8)
    for j in range(blocks - 1, -1, -1):
        shift = np.uint64(64 - BLOCK_BITS * (j + 1))
        mask = np.uint64((1 << BLOCK_BITS) - 1)
        first[((a >> shift) & mask)[:, None] == ((b >> shift) & mask)[None, :]] = j
    return first


def tile_links(tile: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one tile: entry, links (copies of partners counted), root (an entry of its component)."""
    tile = tile.sort_values("entry")
    low, high = int(tile["low"].iloc[0]), int(tile["high"].iloc[0])
    chunk = tile["chunk"].to_numpy()
    vectors = np.stack(tile["vector"].to_list()).astype(np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    codes = tile["code"].to_numpy().view(np.uint64)
    blocks = -(-CODE_BITS // BLOCK_BITS)
    near = vectors @ vectors.T >= least
    near &= first_common_block(codes, codes, blocks) == int(tile["block"].iloc[0])
    np.fill_diagonal(near, False)
    if low != high:
        near &= chunk[:, None] != chunk[None, :]
    links = near @ tile["copies"].to_numpy()
    entries = tile["entry"].to_numpy()
    label = np.arange(len(entries))
    while True:
        reached = np.where(near, label[None, :], len(label)).min(axis=1, initial=len(label))
        lower = np.minimum(label, reached)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    some = near.any(axis=1)
    return pd.DataFrame({"entry": entries[some], "links": links[some], "root": entries[label[some]]})


def link_tiles(batches: Iterator[pd.DataFrame], least: float):
    """Tiles lie one after the other; one may go on in the next batch."""
    keys = ["label", "length", "block", "value", "low", "high"]
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        change = np.append(np.flatnonzero((held[keys].to_numpy()[1:] != held[keys].to_numpy()[:-1]).any(axis=1)) + 1, len(held))
        start = 0
        for end in change[:-1]:
            if end - start > 1:
                yield tile_links(held.iloc[start:end], least)
            start = end
        held = held.iloc[start:]
    if held is not None and len(held) > 1:
        yield tile_links(held, least)


def link_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = LEAST, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per row of ``rows``: vec_id, n_links, component_id, kept.

    * Vectors link when their labels are equal and not null, their lengths are
      equal and their cosine is at least ``least``; every reported link holds,
      links are found through the codes.
    * Null, empty, zero vectors and vectors with null or non-finite components
      link with nothing: 0 links, their own component, kept.
    * Repeated rows are vectors of their own and link with each other.
      ``component_id`` is the smallest id reached; a null id has none and is
      kept.  An empty table gives no rows; other columns are not read.  Ids
      are integers.
    """
    read = rows.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
        # Single-precision vectors travel as they are; cosines are computed in double precision.
        (F.col(vector_col) if dict(rows.dtypes)[vector_col] == "array<float>" else F.col(vector_col).cast("array<double>")).alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)
    # Equal vectors of a label are one entry, named by a hash-free key: their smallest id.
    grouped = read.where(usable).groupBy("label", "vector").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies")
    )
    entries = cut_lineage(grouped.withColumn("entry", F.monotonically_increasing_id()), "entries")
    models = {}
    for length in [r[0] for r in entries.select(F.size("vector")).distinct().collect()]:
        own = entries.where(F.size("vector") == length).select("vector", F.xxhash64("first", "vector").alias("h"))
        sample = np.array(own.orderBy("h").limit(sample_rows).toPandas()["vector"].to_list(), dtype=np.float64)
        models[length] = learn_rotation(sample, min(CODE_BITS, length))
    kinds = dict(entries.dtypes)
    coded = cut_lineage(entries.select("entry", "label", "vector", "copies").mapInPandas(
        lambda batches: encode(batches, models),
        f"entry long, label {kinds['label']}, vector {kinds['vector']}, copies long, code long",
    ).withColumn("length", F.size("vector")), "codes")
    blocks = F.array(*[
        F.struct(F.lit(j).alias("block"), F.shiftrightunsigned("code", CODE_BITS - BLOCK_BITS * (j + 1)).bitwiseAND(
            F.lit((1 << BLOCK_BITS) - 1)).alias("value"))
        for j in range(CODE_BITS // BLOCK_BITS)
    ])
    # Codes of short vectors have fewer blocks; the others would be equal for all.
    used = F.filter(blocks, lambda b: b["block"] * BLOCK_BITS < F.col("length"))
    placed = coded.select("entry", "label", "length", F.explode(used).alias("b")).select(
        "entry", "label", "length", "b.block", "b.value"
    )
    bucket = ["label", "length", "block", "value"]
    sizes = placed.groupBy(*bucket).agg(F.count("*").alias("members")).where("members > 1")
    chunks = placed.join(sizes, bucket).withColumn("chunks", F.ceil(F.col("members") / F.lit(CHUNK))).withColumn(
        "chunk", F.pmod(F.xxhash64("entry"), F.col("chunks"))
    )
    tiles = chunks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).withColumns(
        {"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}
    ).select("entry", *bucket, "chunk", "low", "high")
    keys = [*bucket, "low", "high"]
    filled = tiles.join(coded.select("entry", "vector", "copies", "code"), "entry").repartition(*keys).sortWithinPartitions(*keys)
    found = cut_lineage(
        filled.mapInPandas(lambda batches: link_tiles(batches, least), "entry long, links long, root long"), "links"
    )
    degree = found.groupBy("entry").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("entry").alias("a"), F.col("root").alias("b")))
    joined = entries.select("entry", "label", "vector", "first", "copies").join(degree, "entry", "left").join(
        reached, F.col("entry") == F.col("node"), "left"
    ).withColumn("part", F.coalesce("component", "entry"))
    smallest = joined.groupBy("part").agg(F.min("first").alias("component_id"))
    known = joined.join(smallest, "part").select(
        "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    all_rows = read.join(known, ["label", "vector"], "left")
    return all_rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))
