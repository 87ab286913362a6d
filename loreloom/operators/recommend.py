"""Recommendations, learned guidance, comparison and combined results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreloom.functions.text import bind


def recommend(
    candidates: DataFrame, contexts: DataFrame, links: DataFrame, preferences: DataFrame, as_of: Column, limit: int = 12
) -> DataFrame:
    """Best documents per context; one per group of equivalents.

    ``candidates``: ``(context_id, doc_id, searchable, group_id, updated_at,
    review_due_at, query_hit)`` from a search or a term join; ``contexts``:
    ``(context_id, keywords, task_words)``; ``links``: approved ``(context_id,
    doc_id)``; ``preferences``: ``(context_id, doc_id, read, dismissed)``.
    """
    scored = (
        candidates.join(contexts, "context_id")
        .join(links.select("context_id", "doc_id", F.lit(True).alias("linked")), ["context_id", "doc_id"], "left")
        .join(preferences, ["context_id", "doc_id"], "left")
    )
    found = lambda words: F.size(F.filter(words, lambda w: F.contains(F.col("searchable"), w)))
    no = lambda c: F.coalesce(c, F.lit(False))
    points = (
        F.when(no("query_hit"), 30).otherwise(0) + F.when(no("linked"), 100).otherwise(0)
        + 12 * found("task_words") + 5 * found("keywords")
        - F.when(no(F.col("review_due_at") <= as_of), 20).otherwise(0) - F.when(no("read"), 3).otherwise(0)
    )
    relevant = no("linked") | (found("task_words") > 0) | (found("keywords") > 0) | no("query_hit")
    ranked = scored.filter(relevant & ~no("dismissed")).withColumn("score", points)
    best = F.struct((-F.col("score")).alias("o"), (-F.unix_timestamp("updated_at")).alias("u"), F.col("doc_id").alias("d"))
    rest = [c for c in ("doc_id", "score", "updated_at")]
    folded = ranked.groupBy("context_id", F.coalesce("group_id", F.col("doc_id").cast("string")).alias("group_id")).agg(
        F.min_by(F.struct(*rest), best).alias("r")
    ).select("context_id", "group_id", "r.*")
    order = W.partitionBy("context_id").orderBy(F.desc("score"), F.desc("updated_at"), "doc_id")
    return folded.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def excerpt_chunks(chunks: DataFrame, words: DataFrame, chars: int | None = None) -> DataFrame:
    """Per document the first chunk with one of its matched words, else the first chunk.

    ``words`` is ``(doc_id, words)``.  With ``chars`` the excerpt ends there and
    ``cut`` tells that it does.
    """
    shown = F.col("chunk_text") if chars is None else F.substring("chunk_text", 1, chars)
    cut = F.lit(False) if chars is None else F.length("chunk_text") > chars
    joined = chunks.join(words, "doc_id", "left")
    hit = F.coalesce(F.exists("words", lambda w: F.contains(F.col("chunk_text"), w)), F.lit(False))
    return joined.groupBy("doc_id").agg(
        F.min_by(F.struct("ordinal", shown.alias("excerpt"), cut.alias("cut")), F.struct((~hit).alias("n"), "ordinal")).alias("c")
    ).select("doc_id", "c.ordinal", "c.excerpt", "c.cut")


def learned_guidance(questions: DataFrame, documents: DataFrame, found: DataFrame, limit: int = 3) -> DataFrame:
    """Confirmed experience for a question: two terms and half of them, or the one term of three characters.

    ``questions``: ``(query_id, terms)``; ``documents``: ``(doc_id, updated_at)``;
    ``found``: ``(term, doc_id)`` for terms literally in a document.
    """
    terms = questions.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    matched = terms.join(found, "term").groupBy("query_id", "doc_id", "n").agg(
        F.count("*").alias("matches"), F.max(F.length("term")).alias("longest")
    )
    share = F.col("matches") / F.col("n")
    relevant = F.when(F.col("n") == 1, F.col("longest") >= 3).otherwise((F.col("matches") >= 2) & (share >= 0.5))
    scored = matched.filter(relevant).withColumn("score", share + F.col("matches") / 100).join(documents, "doc_id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("updated_at"), "doc_id")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select(
        "query_id", "place", "doc_id", "matches", "score"
    )


def compare_clauses(pairs: DataFrame, chunks: DataFrame, terms: Column, limit: int = 4) -> DataFrame:
    """Texts of two documents side by side: the first chunks with one of the terms.

    ``pairs`` is ``(pair_id, left_id, right_id)`` and may carry what ``terms`` (an
    array expression) needs.
    """
    def side(name: str) -> DataFrame:
        matched = (
            pairs.withColumn("_terms", terms).select("pair_id", F.col(f"{name}_id").alias("doc_id"), "_terms")
            .join(chunks, "doc_id")
            .filter((F.size("_terms") == 0) | F.exists("_terms", lambda w: F.contains(F.col("chunk_text"), w)))
        )
        order = W.partitionBy("pair_id").orderBy("ordinal")
        first = matched.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
        return first.groupBy("pair_id").agg(
            F.array_sort(F.collect_list(F.struct("ordinal", "chunk_text"))).alias("_c")
        ).select("pair_id", F.size("_c").alias(f"{name}_chunks"), F.array_join(F.transform("_c", lambda c: c["chunk_text"]), "\n").alias(f"{name}_text"))

    return side("left").join(side("right"), "pair_id").withColumn("identical", F.col("left_text") == F.col("right_text"))


def combine_channels(channels: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Results of several channels in one list, each under its own cap.

    Each part is ``(query_id, item_id, score)``.
    """
    parts = []
    for name, (df, cap) in channels.items():
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
        parts.append(
            df.select("query_id", F.col("item_id").cast("string").alias("item_id"), F.col("score").cast("double").alias("score"))
            .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap).withColumn("channel", F.lit(name))
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def merge_bases(parts: list[DataFrame], limit: int = 20) -> DataFrame:
    """Hits of several bases in one list by score."""
    merged = reduce(lambda a, b: a.unionByName(b), parts)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return merged.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def conflict_pairs(hits: DataFrame, issues: DataFrame) -> DataFrame:
    """Queries whose hits touch an open conflict get both sides of it and no definite answer.

    ``hits`` is ``(query_id, doc_id)``; ``issues`` is ``(issue_id, doc_id, block_id)``.
    """
    touched = hits.join(issues.select("issue_id", "doc_id"), "doc_id").select("query_id", "issue_id").distinct()
    return touched.join(issues, "issue_id").select(
        "query_id", "issue_id", "doc_id", "block_id", F.lit(False).alias("definite")
    )


def coverage_policy(hits: DataFrame, query: Column, whole: str, visual: str) -> DataFrame:
    """Whether partial sources rule out an answer about the whole document.

    ``hits`` has ``query_id``, ``parse_coverage``, ``visual_coverage`` and what
    ``query`` needs.
    """
    partial = F.col("parse_coverage") == "partial"
    sampled = F.col("visual_coverage").isin("sampled", "partial")
    blocked = query.rlike(whole) & (partial | (query.rlike(visual) & sampled))
    return hits.groupBy("query_id").agg(
        F.bool_or(blocked).alias("blocked"), F.bool_or(partial | sampled).alias("limited"), F.count("*").alias("hits")
    )


def extractive_answers(hits: DataFrame, limit: int = 4) -> DataFrame:
    """Numbered excerpts of the first citations of each query.

    ``hits`` is ``(query_id, place, title, page, version, text)``.
    """
    line = F.concat(
        F.lit("["), F.col("place").cast("string"), F.lit("] 《"), F.col("title"), F.lit("》第 "), F.col("page").cast("string"),
        F.lit(" 页（版本 "), F.col("version").cast("string"), F.lit("）\n"), F.col("text"),
    )
    return hits.filter(F.col("place") <= limit).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("_l")
    ).select("query_id", F.size("_l").alias("citations"), F.array_join(F.transform("_l", lambda l: l["line"]), "\n\n").alias("answer"))


def pack_evidence(items: DataFrame, budget: int = 18_000) -> DataFrame:
    """Tool results first, then retrieved references, then ordinary hits, under one budget.

    ``items`` is ``(query_id, source, rank, item_id, chars)`` with source ``tool``,
    ``reference`` or ``hit``; items that do not fit are skipped.
    """
    priority = F.when(F.col("source") == "tool", 0).when(F.col("source") == "reference", 1).otherwise(2)
    unit = F.struct(priority.alias("p"), F.col("rank").cast("int").alias("rank"), F.col("item_id").cast("string").alias("item_id"), F.col("chars").cast("bigint").alias("chars"))
    kind = "array<struct<p:int,rank:int,item_id:string,chars:bigint>>"
    grouped = items.groupBy("query_id").agg(F.array_sort(F.collect_list(unit)).alias("u"))
    empty = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(kind).alias("taken"))

    def step(acc: Column, row: Column) -> Column:
        fits = (acc["used"] + row["chars"] <= budget) & ~F.exists(acc["taken"], lambda t: t["item_id"] == row["item_id"])
        return F.when(fits, F.struct(
            (acc["used"] + row["chars"]).alias("used"), F.array_append(acc["taken"], row).alias("taken")
        )).otherwise(acc)

    taken = bind(F.col("u").cast(kind), lambda u: F.aggregate(u, empty, step))["taken"]
    return grouped.select("query_id", F.posexplode(taken).alias("_p", "t")).select(
        "query_id", (F.col("_p") + 1).alias("place"), "t.item_id", "t.chars"
    )


def choose_tables(chunks: DataFrame, queries: DataFrame, limit: int = 1) -> DataFrame:
    """Best structured tables per question.

    ``chunks`` is one row per (query, table chunk hit): ``query_id``, ``table_key``,
    ``title``, ``headers`` (text) and ``fused`` rank score (null when not ranked);
    ``queries`` is ``(query_id, query, words)``.
    """
    from loreloom.functions.text import common_phrase_length

    per_table = chunks.groupBy("query_id", "table_key").agg(
        F.min("title").alias("title"), F.min("headers").alias("headers"), F.max("fused").alias("best")
    ).join(queries, "query_id")
    count = lambda col: F.size(F.filter("words", lambda w: F.contains(F.col(col), w)))
    scored = (
        per_table.withColumn("phrase", common_phrase_length(F.col("query"), F.col("title")))
        .withColumn("title_hits", count("title")).withColumn("header_hits", count("headers"))
        .withColumn("score", F.col("phrase") * 2 + F.col("title_hits") + F.col("header_hits") * 0.3 + F.coalesce("best", F.lit(0.0)))
    )
    qualified = ((F.col("phrase") >= 3) | (F.col("title_hits") >= 2) | (F.col("header_hits") >= 2)) & F.col("best").isNotNull()
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "table_key")
    return scored.filter(qualified).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select(
        "query_id", "place", "table_key", "score"
    )


def table_evidence(rows: DataFrame, max_rows: int = 200, max_chars: int = 18_000) -> DataFrame:
    """Leading rows of each table that fit the evidence budget, and whether that is all.

    ``rows`` is ``(table_key, row_no, line)``; the text starts with a header of
    ``header_chars``.  Rows are taken in order and the first that does not fit ends
    the table, so a running sum decides; only the first ``max_rows`` rows of a table
    can matter and only those are sorted.
    """
    order = W.partitionBy("table_key").orderBy("row_no")
    total = rows.groupBy("table_key").agg(F.count("*").alias("total_rows"))
    first = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= max_rows)
    used = F.sum(F.length("line") + 1).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.col("header_chars") + 1
    fitted = first.withColumn("_used", used).filter(F.col("_used") <= max_chars)
    kept = fitted.groupBy("table_key").agg(F.count("*").alias("returned_rows"), F.max("_used").alias("chars"))
    return total.join(kept, "table_key", "left").select(
        "table_key", "total_rows", F.coalesce("returned_rows", F.lit(0)).alias("returned_rows"), F.coalesce("chars", F.lit(0)).alias("chars"),
        (F.coalesce("returned_rows", F.lit(0)) == F.col("total_rows")).alias("complete"),
    )
