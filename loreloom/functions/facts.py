"""Expressions behind duplicate and conflict checks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom import config
from loreloom.functions.text import bind, han_terms, strip


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation; Spark has no built-in for it."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_block(col: Column) -> Column:
    """NFKC, lower case, without blanks and the listed punctuation."""
    lowered = F.regexp_replace(F.lower(nfkc(col)), r"\s", "")
    return F.translate(F.translate(lowered, config.BLANKS, ""), config.DROPPED_PUNCTUATION, "")


def normalize_key(col: Column) -> Column:
    """NFKC, trimmed, lower case, blanks collapsed: the key of an entity."""
    return F.regexp_replace(F.lower(strip(nfkc(col))), r"\s+", " ")


def block_terms(normalized: Column) -> Column:
    """Distinct terms of a normalised block: ASCII words and Han bigrams."""
    words = F.regexp_extract_all(normalized, F.lit("([a-z0-9_-]+)"), F.lit(1))
    pairs = F.filter(han_terms(normalized), lambda g: F.length(g) == 2)
    return F.array_sort(F.array_distinct(F.concat(words, pairs)))


def word_shingles(col: Column, n: int = 3) -> Column:
    """Distinct shingles of ``n`` words, for corpora that separate words by blanks."""
    words = F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))

    def shingles(w: Column) -> Column:
        last = F.greatest(F.size(w) - (n - 1), F.lit(1))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(
            F.array_sort(F.array_distinct(F.transform(
                F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")
            )))
        )

    return bind(words, shingles)


def facts(col: Column, comparators: str = config.FACT_COMPARATORS, units: str = config.FACT_UNITS) -> Column:
    """Quantities with unit, in text order, blanks and punctuation dropped."""
    found = F.regexp_extract_all(
        col, F.lit(rf"((?:{comparators})?\s*\d+(?:\.\d+)?\s*(?:{units}))"), F.lit(1)
    )
    return F.transform(
        found, lambda f: F.translate(F.translate(F.lower(f), config.BLANKS, ""), config.DROPPED_PUNCTUATION, "")
    )


def numbers(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))


def masked(col: Column, words: str = config.REQUIREMENT_WORDS) -> Column:
    """Numbers as ``#`` and modal words as one requirement word."""
    return F.regexp_replace(F.regexp_replace(col, r"\d+(?:\.\d+)?", "#"), words, config.REQUIREMENT_MASK)


def identities(col: Column) -> Column:
    """Sorted distinct equipment codes named in a block."""
    found = F.regexp_extract_all(col, F.lit(config.IDENTITY_PATTERN), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(
        found, lambda f: F.translate(F.translate(F.lower(f), config.BLANKS, ""), config.DROPPED_PUNCTUATION, "")
    )))


def dice(a: Column, b: Column) -> Column:
    """``2 |a n b| / (|a| + |b|)`` of two distinct-term arrays, 0 when one is empty."""
    return F.when(
        (F.size(a) > 0) & (F.size(b) > 0),
        F.lit(2.0) * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)),
    ).otherwise(F.lit(0.0))


def fingerprint(*columns: str) -> Column:
    """Row hash of the given columns, nulls included."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns]), {"ignoreNullFields": "false"}), 256)


def canonical_digest(*columns: str) -> Column:
    """Digest of a JSON object whose keys are in sorted order."""
    return F.sha2(
        F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256
    )
