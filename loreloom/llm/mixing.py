"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a fixed random order; the queue
starts again at its end, up to ``max_epochs`` times.  A copy of a document
finishes at the virtual time (words of its source up to and with it) / (target
of its source).  All copies are range-sorted by finish time and taken until
the total budget is used, so every source advances at the pace of its target.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import running_sums, word_count
from loreloom.session import cut_lineage


def source_targets(sized: DataFrame, weights: Sequence[int], share: str, max_epochs: int) -> DataFrame:
    """Per source: source_rank, source_size, target.

    Weights repeat over the sources by code point, null last.  Targets share
    ``share`` of all sizes by weight; none exceeds ``max_epochs`` times its
    source.  With level L the target is min(weight * L, cap); the level is
    found from prefix sums over the sources by cap / weight.
    """
    whole = Fraction(share)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "_last", F.col("source").isNull()
    )
    ranked = running_sums(totals, ["_last", "source"], {"source_rank": F.lit(1).cast("long")})
    turn = F.expr(f"element_at(array({', '.join(map(str, weights))}), cast(source_rank % {len(weights)} + 1 as int))")
    ranked = ranked.withColumns({"_weight": turn, "_cap": F.lit(max_epochs) * F.col("source_size")})
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    filled = cut_lineage(running_sums(
        ranked, ["_ratio", "source_rank"], {"_capped": F.col("_cap"), "_passed": F.col("_weight").cast("long")}
    ))
    size, weight = filled.agg(F.sum("source_size"), F.sum("_weight")).first()
    budget = (size or 0) * whole.numerator / whole.denominator
    level = (F.lit(float(budget)) - F.col("_capped")) / (F.lit(weight or 1) - F.col("_passed"))
    first = filled.where(F.col("_ratio") >= level).agg(F.min_by(level, F.struct("_ratio", "source_rank"))).first()[0]
    target = F.col("_cap").cast("double")
    if first is not None:
        target = F.least(target, F.col("_weight") * F.lit(first))
    return filled.select("source", "source_rank", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: str = "1.5",
    max_epochs: int = 2,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, copies, row_hash.

    * ``size`` counts words; ``taken`` = size * ``copies`` counts the words the
      mix takes from the row, repeats included, at most ``max_epochs`` times.
    * The order inside a source is a hash of (seed, id), then the id and the
      size, so reruns agree and do not depend on partitions.  Rows equal in
      these are interchangeable.
    * Null or empty texts have size 0 and are in the mix (``copies``) where
      their place in the queue is, with no words.  A null source is a source
      of its own, after all others.  A source without words has target 0 and
      takes nothing.  An empty table gives no rows.
    * Each source ends within one document of its target.
    """
    sized = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"), row_hash(id_col, seed).alias("row_hash"),
    ))
    targets = cut_lineage(source_targets(sized, weights, share, max_epochs))
    queued = running_sums(
        sized.withColumn("_last", F.col("source").isNull()),
        ["_last", "source", "row_hash", "doc_id", "size"], {"_words": F.col("size"), "_row": F.lit(1).cast("long")},
    )
    # Words before a source in the order of all sources, to count from its own start.
    starts = running_sums(targets, ["source_rank"], {"_before": F.col("source_size")})
    rows = cut_lineage(queued.join(starts, queued["source"].eqNullSafe(starts["source"])).select(
        "doc_id", queued["source"], "size", "row_hash", "source_size", "target", "_row",
        (F.col("_words") - F.col("_before") + F.col("size")).alias("_reach"),
    ))
    epochs = list(range(max_epochs))
    finish = (F.col("_reach") + F.col("_epoch") * F.col("source_size")) / F.col("target")
    copies = rows.where(F.col("target") > 0).select(
        "size", "_row", "_reach", "source_size", "target",
        F.explode(F.array(*[F.lit(e) for e in epochs])).alias("_epoch"),
    ).select("size", "_epoch", "_row", finish.alias("_finish"))
    sizes = targets.agg(F.sum("source_size")).first()[0] or 0
    budget = sizes * Fraction(share).numerator // Fraction(share).denominator
    used = running_sums(copies, ["_finish", "_epoch", "_row"], {"_used": F.col("size")})
    cut = used.where(F.col("_used") + F.col("size") <= budget).agg(
        F.max(F.struct("_finish", "_epoch", "_row")).alias("cut")
    ).first()["cut"]
    taken = F.lit(0)
    if cut is not None:
        last = place(F.lit(cut["_finish"]), F.lit(cut["_epoch"]), F.lit(cut["_row"]))
        for epoch in epochs:
            at = (F.col("_reach") + F.lit(epoch) * F.col("source_size")) / F.col("target")
            here = place(at, F.lit(epoch), F.col("_row"))
            taken = taken + F.when((F.col("target") > 0) & (here <= last), 1).otherwise(0)
    return rows.withColumn("copies", taken).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "row_hash",
    )


def place(finish: Column, epoch: Column, row: Column) -> Column:
    """The place of a copy in the global order."""
    return F.struct(finish.cast("double").alias("finish"), epoch.cast("int").alias("epoch"), row.cast("long").alias("row"))


def row_hash(id_col: str, seed: int = 17) -> Column:
    """60 bits of a digest of (seed, id): the random order of a queue."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them, with the columns of ``docs``.

    A source's queue is cut at one place per epoch, so the mix is told by one
    row per source; documents meet those rows and are not shuffled by id.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    epochs = range(1, options.get("max_epochs", 2) + 1)
    here = F.struct("row_hash", "doc_id", "size")
    cuts = cut_lineage(mix(docs, **options).groupBy(F.col("source").alias("of")).agg(
        *[F.max(F.when(F.col("copies") >= e, here)).alias(f"cut{e}") for e in epochs]
    ))
    place_of = F.struct(
        row_hash(id_col, options.get("seed", 17)).alias("row_hash"), F.col(id_col).alias("doc_id"),
        word_count(F.col(text_col)).alias("size"))
    copies = sum((F.when(F.col("place") <= F.col(f"cut{e}"), 1).otherwise(0) for e in epochs), F.lit(0))
    # Columns of any name stand inside ``row``.
    placed = docs.select(F.struct("*").alias("row"), place_of.alias("place"), F.col(source_col).alias("source"))
    return (
        placed.join(cuts, placed["source"].eqNullSafe(cuts["of"]))
        .withColumn("copies", copies).where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("row.*")
    )
