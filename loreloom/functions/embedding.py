"""The embedding hook: the caller brings a function from texts to vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32
Embedder = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, key: list[str], text: str, model: str, dimension: int, load: Callable[[], Embedder]) -> DataFrame:
    """Unit vectors of a text column: key, ``model``, ``vector``.

    ``load`` runs once per task and returns the model; texts go to it in batches
    of 32.  A vector of another dimension is an error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = load()
        for frame in batches:
            parts = []
            texts = frame[text].fillna("").tolist()
            for start in range(0, len(texts), BATCH):
                part = np.asarray(apply(texts[start:start + BATCH]), dtype=np.float64)
                if part.ndim != 2 or part.shape[1] != dimension or not np.isfinite(part).all():
                    raise ValueError(f"model {model} returned vectors of another shape than {dimension}")
                parts.append(part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12))
            out = frame[key].copy()
            out["model"] = model
            out["vector"] = list(np.concatenate(parts).astype(np.float32)) if parts else []
            yield out

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key) + ", model string, vector array<float>"
    return df.select(*key, text).mapInPandas(run, schema)


def hash_embedder(dimension: int = 64) -> Callable[[], Embedder]:
    """A deterministic stand-in for tests: words hashed into signed buckets."""

    def load() -> Embedder:
        def apply(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension))
            for i, value in enumerate(texts):
                for word in value.lower().split():
                    code = zlib.crc32(word.encode())
                    out[i, code % dimension] += 1 if code & 0x10000 else -1
            return out

        return apply

    return load


def letter_embedder(letters: str = "aeiou") -> Callable[[], Embedder]:
    """A model in closed form: how often a text holds each letter, and one."""

    def load() -> Embedder:
        return lambda texts: np.array([[t.count(c) for c in letters] + [1] for t in texts], dtype=np.float64)

    return load


def stored_vectors(vectors: DataFrame, allowed: DataFrame, model: str) -> DataFrame:
    """Vectors of one model for the allowed documents; the semi join comes before any use."""
    return vectors.filter(F.col("model") == model).join(allowed.select("doc_id"), "doc_id", "left_semi")
