"""Table functions for SQL: chunks of a text by ``LATERAL``, ranked rows of a table by ``PARTITION BY``."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from loreloom import config

_CONTROLS, _TRAILING, _GAPS = re.compile(r"[\x00-\x08\x0b\x0e-\x1f]"), re.compile(r"[ \t]+\n"), re.compile(r"\n{4,}")
_BREAK, _LINE = re.compile(config.HEADING_BREAK, re.ASCII), re.compile(config.HEADING_LINE, re.ASCII)


def cleaned(text: str) -> str:
    """``functions.text.clean_text`` of one text."""
    unified = text.replace("\r\n", "\n").replace("\r", "\n")
    return _GAPS.sub("\n\n\n", _TRAILING.sub("\n", _CONTROLS.sub("", unified))).strip(config.BLANKS)


def ends(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks of a section: to the last line or sentence end past half, else ``size`` characters."""
    start = 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            sample = text[start:end]
            sentence = max(sample.rfind(c) for c in "。！？")
            place = max(sample.rfind("\n"), sentence + 1, sample.rfind(". ") + 1)
            end = start + place if place > size / 2 else end
        yield start, end
        if end >= len(text):
            return
        start = max(start + 1, end - overlap)


class ChunkText:
    """``chunk_text(text, size, overlap)``: ordinal, heading, chunk_text; a null text has no rows."""

    @staticmethod
    def analyze(text: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError(f"chunk_text takes a string, not {text.dataType.simpleString()}")
        return AnalyzeResult(StructType().add("ordinal", IntegerType()).add("heading", StringType()).add("chunk_text", StringType()))

    def eval(self, text: str | None, size: int = config.CHUNK_CHARS, overlap: int = config.CHUNK_OVERLAP):
        ordinal = 0
        for part in _BREAK.split(cleaned(text)) if text else []:
            heading = _LINE.search(part)
            section = part.strip(config.BLANKS)
            for start, end in ends(section, size, overlap):
                piece = section[start:end].strip(config.BLANKS)
                if piece:
                    ordinal += 1
                    yield ordinal, heading[1] if heading else "", piece


class FirstRows:
    """``first_rows(TABLE(rows), key, order, n)``: the first ``n`` rows of each value of ``key`` by ``order``, with their rank.

    The table is partitioned and sorted by Spark; rows are counted, not held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        schema = StructType().add("rank", IntegerType())
        for field in rows.dataType.fields:
            schema = schema.add(field.name, field.dataType)
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(order.value)])

    def __init__(self) -> None:
        self.rank = 0

    def eval(self, rows: Row, key: str, order: str, n: int):
        self.rank += 1
        if self.rank <= n:
            yield (self.rank, *rows)


def register(spark: SparkSession) -> None:
    """Make ``chunk_text`` and ``first_rows`` known to SQL in this session."""
    spark.udtf.register("chunk_text", udtf(ChunkText))
    spark.udtf.register("first_rows", udtf(FirstRows))
