"""Files as rows: text, CSV, JSON, folder listings and manifests."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.functions.text import clean_text
from loreloom.session import few_rows

GB18030_WARNING = "decoded as GB18030"
CORRUPT = "corrupt"


def read_binary(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """All files under a folder with ``path``, ``length``, ``modificationTime`` and ``content``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def _decode(data: bytes | None) -> tuple[str | None, str | None]:
    if data is None:
        return None, None
    for mark, encoding in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            try:
                return data[2:].decode(encoding), None
            except UnicodeDecodeError:
                return None, CORRUPT
    for encoding, warning in (("utf-8-sig", None), ("gb18030", GB18030_WARNING)):
        try:
            return data.decode(encoding), warning
        except UnicodeDecodeError:
            continue
    return None, CORRUPT


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("warning", T.StringType())]))
def decode_bytes(content: pd.Series) -> pd.DataFrame:
    """BOM, then UTF-8, then GB18030 with a warning; Spark's ``decode`` has no GB18030."""
    return pd.DataFrame([_decode(v) for v in content], columns=["text", "warning"])


def read_texts(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Decoded files: ``path``, ``text``, ``warning``; unreadable ones have no text."""
    few_rows(spark)
    files = read_binary(spark, folder, glob)
    return files.withColumn("_d", decode_bytes("content")).select("path", "length", "_d.text", "_d.warning")


# --- CSV ----------------------------------------------------------------------

_QUOTED = re.compile(r'"(?:[^"]|"")*"')


def _records(text: str | None, tab_only: bool) -> list[tuple[int, list[str]]] | None:
    """Records with their number; blank ones are dropped but counted.  None when broken."""
    if text is None:
        return None
    first = re.split(r"[\r\n]", _QUOTED.sub("", text), maxsplit=1)[0]
    delimiter = "\t" if tab_only else max(",;\t", key=lambda d: (first.count(d), -",;\t".index(d)))
    d = re.escape(delimiter)
    cell = re.compile(rf'(?:[^\S\r\n{d}]*"((?:[^"]|"")*)"[^\S\r\n{d}]*|([^{d}\r\n]*))({d}|\r\n|\n|\r|\Z)')
    records, row, number, at = [], [], 0, 0
    while at < len(text) or row:
        match = cell.match(text, at)
        quoted, plain, end = match.groups()
        if quoted is None and plain.lstrip().startswith('"'):
            return None
        row.append(plain if quoted is None else re.sub(r"[\t\r\n]", " ", quoted.replace('""', '"')))
        at = match.end()
        if end != delimiter:
            number += 1
            if any(value.strip() for value in row):
                records.append((number, row))
            row = []
            if end == "":
                break
    return records


_RECORDS = T.ArrayType(T.StructType([
    T.StructField("record_no", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType())),
]))


@F.pandas_udf(_RECORDS)
def _csv_records(texts: pd.Series, tab_only: pd.Series) -> pd.Series:
    def rows(text: str | None, tabs: bool):
        found = _records(text, tabs)
        return None if found is None else [{"record_no": n, "cells": cells} for n, cells in found]

    return pd.Series([rows(a, b) for a, b in zip(texts, tab_only)])


def csv_records(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Rows of CSV and TSV texts: ``path``, ``record_no``, ``cells``.

    The delimiter is the most frequent of comma, semicolon and tab outside quotes
    in the first record; breaks inside quotes become blanks.  A file is the unit
    of work because a quote can span lines.
    """
    tabs = F.lower(F.col(path)).endswith(".tsv")
    return texts.select(path, F.explode(_csv_records(F.col(text), tabs)).alias("_r")).select(path, "_r.record_no", "_r.cells")


def broken_csv(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Files with an unclosed quote or text after a closing quote."""
    tabs = F.lower(F.col(path)).endswith(".tsv")
    return texts.withColumn("_r", _csv_records(F.col(text), tabs)).filter("_r IS NULL").select(path)


# --- JSON ---------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def pretty_json(texts: pd.Series) -> pd.Series:
    """JSON with two-space indentation and unchanged key order; null when invalid."""

    def layout(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, indent=2)
        except ValueError:
            return None

    return texts.map(layout)


def json_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("pretty", clean_text(pretty_json(F.col(text))))


# --- folders, manifests, records ------------------------------------------------

def folder_listing(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """Relative path, size and content hash of every file of the wanted types."""
    files = read_binary(spark, folder)
    root = folder.rstrip("/") + "/"
    relative = F.regexp_replace("path", r"^(?:file:)?/*", "/")
    listed = files.select(
        F.replace(relative, F.lit(root), F.lit("")).alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash")
    )
    if extensions:
        listed = listed.filter(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(extensions))
    return listed


def manifest_check(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """State of every file: ok, changed, missing or orphan.

    Both sides are ``(path, size, hash)``; one full outer join.
    """
    have = listing.select("path", F.col("size").alias("_size"), F.col("hash").alias("_hash"))
    state = (
        F.when(F.col("_hash").isNull(), "missing").when(F.col("hash").isNull(), "orphan")
        .when((F.col("size") == F.col("_size")) & (F.col("hash") == F.col("_hash")), "ok").otherwise("changed")
    )
    return manifest.join(have, "path", "full").select("path", state.alias("state"))


def map_records(records: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Business records under the declared field mapping (target -> source column)."""
    return records.select(*[F.col(source).alias(target) for target, source in mapping.items()])


def source_type(path: Column) -> Column:
    """Kind of source by extension, and how its pages are counted."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return (
        F.when(ext.isin("csv", "tsv", "xlsx"), "table").when(ext.isin("mp3", "wav", "m4a", "mp4", "mov", "webm"), "media")
        .when(ext.isin("png", "jpg", "jpeg", "webp", "tif", "tiff"), "image").when(ext == "pdf", "physical_pages").otherwise("text")
    )
