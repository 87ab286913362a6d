"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreloom import config
from loreloom.functions.text import bind, clean_text, strip


def sections(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per Markdown section: ``section`` (from 1), ``heading`` and ``section_text``.

    Cleaned text starts with a filled line, so every later heading line opens a
    section and a single split finds them all.
    """
    parts = F.split(clean_text(F.col(text)), config.HEADING_BREAK)
    return (
        df.select("*", F.posexplode(parts).alias("_pos", "_part"))
        .withColumn("section", F.col("_pos") + 1)
        .withColumn("heading", F.regexp_extract("_part", config.HEADING_LINE, 1))
        .withColumn("section_text", strip(F.col("_part")))
        .drop("_pos", "_part")
    )


def _spans(text: Column, size: int, overlap: int) -> Column:
    """Chunk texts of one section as an ordered array.

    Long texts are first cut into blocks of ``4 * size`` so that each step looks
    at two blocks only and the work stays linear in the text.
    """
    block = 4 * size
    step = size // 2 + 1 - overlap

    def window(blocks: Column, start: Column, length: Column) -> Column:
        index = F.floor(start / block).cast("int")
        joined = F.concat(F.get(blocks, index), F.coalesce(F.get(blocks, index + 1), F.lit("")))
        return F.substring(joined, (start - index * block + 1).cast("int"), length.cast("int"))

    def last_break(sample: Column) -> Column:
        def position(backward: Column) -> Column:
            newline = F.instr(backward, "\n")
            sentence = F.instr(F.translate(backward, "！？", "。。"), "。")
            stop = F.instr(backward, " .")
            n = F.length(backward)
            return F.greatest(
                F.when(newline > 0, n - newline).otherwise(F.lit(-1)),
                F.when(sentence > 0, n - sentence + 1).otherwise(F.lit(0)),
                F.when(stop > 0, n - stop).otherwise(F.lit(0)),
            )

        return bind(F.reverse(sample), position)

    def fold(n: Column, blocks: Column) -> Column:
        empty = F.struct(
            F.lit(0).alias("start"),
            F.array().cast("array<struct<s:int,e:int>>").alias("spans"),
        )

        def advance(acc: Column, _: Column) -> Column:
            start = acc["start"]

            def place(cut: Column) -> Column:
                end = F.when((start + size < n) & (cut > size / 2), start + cut).otherwise(
                    F.least(n, start + size)
                )
                following = F.when(end >= n, n).otherwise(F.greatest(start + 1, end - overlap))
                return F.struct(
                    following.cast("int").alias("start"),
                    F.concat(
                        acc["spans"],
                        F.array(F.struct(start.alias("s"), end.cast("int").alias("e"))),
                    ).alias("spans"),
                )

            found = F.when(
                start + size < n, last_break(window(blocks, start, F.lit(size)))
            ).otherwise(F.lit(-1))
            return F.when(start >= n, acc).otherwise(bind(found, place))

        steps = F.sequence(F.lit(1), (F.ceil(n / step) + 1).cast("int"))
        spans = F.aggregate(steps, empty, advance)["spans"]
        return F.transform(spans, lambda p: strip(window(blocks, p["s"], p["e"] - p["s"])))

    # Whole code points, so that characters outside the basic plane count once.
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{block}}}"), F.lit(0))
    folded = bind(F.length(text), lambda n: bind(blocks, lambda b: fold(n, b)))
    return F.when(F.length(text) > 0, folded).otherwise(F.array().cast("array<string>"))


def chunk_documents(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = config.CHUNK_CHARS,
    overlap: int = config.CHUNK_OVERLAP,
) -> DataFrame:
    """Overlapping character chunks within sections, cut at line or sentence ends.

    Columns: the key, ``ordinal`` (running from 1 per document), ``heading`` and
    ``chunk_text``.  No shuffle: a document's chunks come from its own row.
    """
    parts = F.split(clean_text(F.col(text)), config.HEADING_BREAK)
    pieces = F.flatten(
        F.transform(
            parts,
            lambda part: F.transform(
                F.filter(bind(strip(part), lambda t: _spans(t, size, overlap)), lambda c: c != ""),
                lambda c: F.struct(
                    F.regexp_extract(part, config.HEADING_LINE, 1).alias("heading"),
                    c.alias("chunk_text"),
                ),
            ),
        )
    )
    return df.select(key, F.posexplode(pieces).alias("_pos", "_piece")).select(
        key,
        (F.col("_pos") + 1).alias("ordinal"),
        F.col("_piece.heading").alias("heading"),
        F.col("_piece.chunk_text").alias("chunk_text"),
    )


def split_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Form feeds separate the logical pages of a plain text."""
    return df.select(key, F.posexplode(F.split(F.col(text), "\f")).alias("_p", "_t")).select(
        key, (F.col("_p") + 1).alias("page"), clean_text(F.col("_t")).alias("page_text")
    )


def limit_violations(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_pages: int = config.MAX_PAGES,
    max_chars: int = config.MAX_TEXT_CHARS,
) -> DataFrame:
    """Documents beyond the size limits with the rules they break (a quarantine list)."""
    pages = F.size(F.split(F.col(text), "\f"))
    rules = F.array_compact(
        F.array(
            F.when(pages > max_pages, F.lit("too_many_pages")),
            F.when(F.length(F.col(text)) > max_chars, F.lit("text_too_long")),
            F.when(strip(F.col(text)) == "", F.lit("empty_text")),
        )
    )
    return df.select(key, pages.alias("page_count"), rules.alias("rules")).filter(F.size("rules") > 0)


def chunk_tables(
    rows: DataFrame,
    table_key: list[str],
    header: Column,
    label: Column,
    size: int = config.CHUNK_CHARS,
    max_row: int = config.TABLE_ROW_CHARS,
    max_rows: int = config.MAX_TABLE_ROWS,
    max_columns: int = config.MAX_TABLE_COLUMNS,
) -> DataFrame:
    """Whole-row table chunks: rows packed in order until the next would pass ``size``.

    ``rows`` holds the table key, ``row_no`` (from 1), ``source_no`` and ``cells``
    (array of strings); ``header`` and ``label`` are expressions of the key.  Every
    chunk repeats the header and rows never overlap.  A table is packed in ranges of
    ``max_rows`` rows, so no task holds more; within the sources' limit that is the
    whole table.  ``within_limits`` is false for tables of more rows or columns, and
    a row that passes ``max_row`` makes its chunk ``oversized``: both can be rejected.
    """
    part = F.floor((F.col("row_no") - 1) / F.lit(max_rows)).alias("_part")
    totals = rows.groupBy(*table_key).agg(
        F.count("*").cast("int").alias("total_rows"), F.max(F.size("cells")).alias("_columns")
    ).withColumn("within_limits", (F.col("total_rows") <= max_rows) & (F.col("_columns") <= max_columns)).drop("_columns")
    cell = lambda c: F.regexp_replace(c, r"[\t\r\n]+", " ")
    line = F.concat(
        F.lit("[数据行"), F.col("row_no").cast("string"), F.lit("，源记录"),
        F.col("source_no").cast("string"), F.lit("] "),
        F.array_join(F.transform("cells", cell), "\t"),
    )
    grouped = rows.groupBy(*table_key, part).agg(
        F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))).alias("lines")
    )
    base = F.length(header) + F.length(label) + F.lit(80)
    start = F.struct(
        F.lit(0).alias("used"), F.lit(0).alias("chunk"),
        F.array().cast("array<struct<chunk:int,row_no:int,line:string>>").alias("out"),
    )

    def pack(acc: Column, item: Column) -> Column:
        length = F.length(item["line"])
        fits = (acc["chunk"] > 0) & (acc["used"] + length + 1 <= size)
        number = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        used = F.when(fits, acc["used"] + length + 1).otherwise(base + length + 1)
        return F.struct(
            used.alias("used"), number.alias("chunk"),
            F.concat(
                acc["out"],
                F.array(F.struct(number.alias("chunk"), item["row_no"].cast("int").alias("row_no"), item["line"].alias("line"))),
            ).alias("out"),
        )

    packed = grouped.select(
        *table_key, "_part", header.alias("header"), label.alias("label"),
        base.alias("base"), F.explode(F.aggregate("lines", start, pack)["out"]).alias("r"),
    )
    chunked = packed.groupBy(*table_key, "_part", F.col("r.chunk").alias("_chunk")).agg(
        F.first("header").alias("header"),
        F.first("label").alias("label"), F.min("r.row_no").alias("row_start"),
        F.max("r.row_no").alias("row_end"),
        F.max(F.length("r.line") + F.col("base") > max_row).alias("oversized"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r.row_no", "r.line"))), lambda s: s["line"]), "\n").alias("body"),
    )
    # Chunk numbers run on over the ranges: one row per range is numbered.
    before = W.partitionBy(*table_key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = chunked.groupBy(*table_key, "_part").agg(F.max("_chunk").alias("_n")).select(
        *table_key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("int").alias("_offset")
    )
    chunked = chunked.join(offsets, [*table_key, "_part"]).join(totals, table_key).withColumn(
        "chunk", F.col("_chunk") + F.col("_offset")
    )
    text = F.concat(
        F.col("label"), F.lit("；数据行 "), F.col("row_start"), F.lit("–"), F.col("row_end"),
        F.lit(" / "), F.col("total_rows"), F.lit("\n"), F.col("header"), F.lit("\n"), F.col("body"),
    )
    return chunked.select(*table_key, "chunk", "row_start", "row_end", "total_rows", "oversized", "within_limits", text.alias("chunk_text"))


def oversized_tables(rows: DataFrame, table_key: list[str], max_rows: int = config.MAX_TABLE_ROWS, max_columns: int = config.MAX_TABLE_COLUMNS) -> DataFrame:
    """Tables beyond the row or column limit of the sources (a list for review; nothing is dropped)."""
    return rows.groupBy(*table_key).agg(F.count("*").alias("rows"), F.max(F.size("cells")).alias("columns")).filter(
        (F.col("rows") > max_rows) | (F.col("columns") > max_columns)
    )
