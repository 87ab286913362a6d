"""Contiguous shards of nearly equal bytes (law ``bytes``).

Documents lie in the order of their id.  Every row covers a byte range of that
order; its shard is the equal share of all bytes in which the middle of its
range falls.  Offsets come from a distributed prefix sum: totals per range of
ids, a running sum over those totals, and a window inside each range.  Only
(id, size, checksum) are shuffled; texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import running_sums


def byte_size(text: Column, overhead: int = 16) -> Column:
    """UTF-8 bytes of a text (null: none) and a fixed cost per record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long")


def shards(
    docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16
) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    * ``shard`` runs from 0 to ``n_shards`` - 1; a shard is a contiguous range
      of (doc_id, checksum, size) and differs from an equal share by less than
      two documents.  ``slot`` counts from 0 inside a shard without gaps.
    * ``grown_shard`` is null: with one more shard all cuts move.
    * Null ids come first.  A null text counts ``overhead`` bytes and has the
      checksum of the empty text (0).  Repeated rows take a slot each and are
      interchangeable.  Groups of equal texts are spread by their ids like any
      other rows: the law is ``bytes``, and a group of a third of all rows would
      not fit a shard.  With fewer rows than shards some shards stay empty; an
      empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        byte_size(F.col(text_col), overhead).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = running_sums(
        rows, ["doc_id", "text_crc32", "size"], {"_start": F.col("size"), "_row": F.lit(1).cast("long")}
    )
    total = rows.agg(F.sum("size")).first()[0] or 1
    middle = (F.lit(2) * F.col("_start") + F.col("size")) * F.lit(n_shards)
    placed = placed.withColumn(
        "shard", F.least((middle / F.lit(2 * total)).cast("int"), F.lit(n_shards - 1))
    )
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
