"""Keyed merges, change feeds, versions and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreloom.session import cut_lineage


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate, not a window: a key with very many rows is reduced to one
    candidate per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, "_r.*").select(*df.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str], deleted: str = "deleted") -> DataFrame:
    """Merge changes into a table by key: the latest change wins, tombstones remove.

    ``changes`` has the table's columns and a boolean ``deleted``.
    """
    last = latest(changes, keys, order)
    kept = table.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.filter(~F.col(deleted)).select(*table.columns))


def replace_rows(table: DataFrame, fresh: DataFrame, key: str, replaced: DataFrame) -> DataFrame:
    """Replace all rows of the given keys (for example all chunks of a document)."""
    return table.join(replaced.select(key).distinct(), key, "left_anti").unionByName(fresh.select(*table.columns))


def current_versions(versions: DataFrame, as_of: Column, family: str = "family_id") -> DataFrame:
    """Mark the newest effective published version per family as current, older ones superseded.

    A version that becomes effective later leaves the present one in place.
    """
    effective = (F.col("status") == "published") & (F.col("effective_at").isNull() | (F.col("effective_at") <= as_of))
    newest = versions.groupBy(family).agg(F.max(F.when(effective, F.col("version"))).alias("_current"))
    state = (
        F.when(effective & (F.col("version") == F.col("_current")), "current")
        .when((F.col("status") == "published") & (F.col("version") < F.col("_current")), "superseded")
        .when((F.col("status") == "published") & ~effective, "scheduled")
        .otherwise(F.col("status"))
    )
    return versions.join(newest, family, "left").withColumn("version_state", state).drop("_current")


def next_versions(versions: DataFrame, family: str = "family_id") -> DataFrame:
    return versions.groupBy(family).agg((F.max(F.coalesce("version", F.lit(1))) + 1).alias("next_version"))


def snapshot_diff(listing: DataFrame, stored: DataFrame, keys: list[str], hash_column: str = "hash", complete: bool = True) -> DataFrame:
    """Source listing against stored rows: created, updated, unchanged, archived or skipped.

    ``stored`` may mark rows with ``deleted``; those are local tombstones and stay.
    An incomplete listing archives nothing.
    """
    new = listing.select(*keys, F.col(hash_column).alias("_new"))
    old = stored.select(*keys, F.col(hash_column).alias("_old"), F.coalesce("deleted", F.lit(False)).alias("_gone"))
    status = (
        F.when(F.col("_gone"), "skipped")
        .when(F.col("_old").isNull(), "created")
        .when(F.col("_new").isNull(), F.lit("archived" if complete else "unchanged"))
        .when(F.col("_new") == F.col("_old"), "unchanged")
        .otherwise("updated")
    )
    return new.join(old, keys, "full").select(*keys, status.alias("status"))


def change_actions(state: DataFrame, changes: DataFrame, key: str = "external_id") -> DataFrame:
    """What a batch of source records does to the stored state.

    ``state`` is ``(key, content_hash, source_updated_at, access_state,
    tombstone)``; ``changes`` is ``(key, content_hash, updated_at, deleted,
    allowed)``.  Only the latest record per key counts; local tombstones win,
    older records are skipped, equal content only refreshes.
    """
    last = latest(changes, [key], ["updated_at", "content_hash"])
    known = state.select(
        key, F.col("content_hash").alias("_hash"), F.col("source_updated_at").alias("_at"),
        F.col("access_state").alias("_access"), F.coalesce("tombstone", F.lit(False)).alias("_tombstone"),
        F.lit(True).alias("_known"),
    )
    action = (
        F.when(F.col("_tombstone"), "skipped_tombstone")
        .when(F.col("deleted") | ~F.coalesce("allowed", F.lit(True)), "withdrawn")
        .when(F.col("updated_at") < F.col("_at"), "skipped_older")
        .when((F.col("content_hash") == F.col("_hash")) & ~(F.col("_access").eqNullSafe(F.lit("withdrawn"))), "refreshed")
        .when(F.col("_known"), "updated")
        .otherwise("created")
    )
    return last.join(known, key, "left").withColumn("action", action).drop("_hash", "_at", "_access", "_tombstone", "_known")


def apply_changes(state: DataFrame, changes: DataFrame, key: str = "external_id") -> DataFrame:
    """The stored state after :func:`change_actions`."""
    acted = change_actions(state, changes, key)
    touched = acted.filter(~F.startswith("action", F.lit("skipped")))
    fresh = touched.join(
        state.select(key, F.col("content_hash").alias("_hash"), F.col("version").alias("_version")), key, "left"
    ).select(
        key,
        F.when(F.col("action") == "withdrawn", F.col("_hash")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.col("updated_at").alias("source_updated_at"),
        F.when(F.col("action") == "withdrawn", "withdrawn").otherwise("active").alias("access_state"),
        F.lit(False).alias("tombstone"),
        (F.coalesce("_version", F.lit(0)) + F.when(F.col("action").isin("created", "updated"), 1).otherwise(0)).alias("version"),
    )
    return replace_rows(state, fresh, key, fresh)


def version_chains(documents: DataFrame, depth: int | None = None) -> DataFrame:
    """Root and length of every version's chain of predecessors, of any length.

    Pointer doubling: each round joins every row to its ancestor's ancestor until
    nothing moves, which takes as many rounds as the longest chain has binary
    digits.  ``documents`` is ``(doc_id, previous_id)``.  ``complete`` is false,
    and ``root_id`` null, when a predecessor is missing or the chain runs in a
    circle; with ``depth`` also for longer chains, which keep their root.
    """
    known = documents.select(F.col("doc_id").alias("ancestor"), F.lit(True).alias("_known"))
    jump = cut_lineage(
        documents.select("doc_id", F.col("previous_id").alias("ancestor"))
        .join(known, "ancestor", "left")
        .select(
            "doc_id", F.coalesce(F.when(F.col("_known"), F.col("ancestor")), F.col("doc_id")).alias("ancestor"),
            F.when(F.col("_known"), 1).otherwise(0).cast("long").alias("steps"),
            (F.col("ancestor").isNotNull() & F.col("_known").isNull()).alias("broken"),
            F.coalesce("_known", F.lit(False)).alias("moved"),
        )
    )
    for _ in range(jump.count().bit_length() + 1):
        if not jump.filter("moved").limit(1).count():
            break
        up = jump.select(
            F.col("doc_id").alias("ancestor"), F.col("ancestor").alias("_next"), F.col("steps").alias("_steps"),
            F.col("broken").alias("_broken"))
        jump = cut_lineage(jump.join(up, "ancestor").select(
            "doc_id", F.col("_next").alias("ancestor"), (F.col("steps") + F.col("_steps")).alias("steps"),
            (F.col("broken") | F.col("_broken")).alias("broken"), (F.col("_steps") > 0).alias("moved"),
        ))
    # What still moves after as many doublings as there are rows runs in a circle.
    whole = ~F.col("broken") & ~F.col("moved")
    deep = F.lit(True) if depth is None else F.col("steps") < depth
    return jump.select(
        "doc_id", F.when(whole, F.col("ancestor")).alias("root_id"),
        F.when(whole, F.col("steps") + 1).alias("length"), (whole & deep).alias("complete"),
    )


def revision_history(before: DataFrame, after: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Chunks whose block revision changed, with both texts and the cause.

    Both sides are ``(doc_id, chunk_id, block_revision, text)``; ``reviewed`` lists
    the chunk ids edited by hand, other changes were propagated.
    """
    old = before.select("chunk_id", F.col("block_revision").alias("old_revision"), F.col("text").alias("old_text"))
    new = after.select("doc_id", "chunk_id", F.col("block_revision").alias("new_revision"), F.col("text").alias("new_text"))
    hand = reviewed.select("chunk_id").distinct().withColumn("_hand", F.lit(True))
    return (
        new.join(old, "chunk_id").filter(F.col("new_revision") != F.col("old_revision"))
        .join(hand, "chunk_id", "left")
        .withColumn("cause", F.when(F.col("_hand"), "manual_review").otherwise("header_propagation"))
        .drop("_hand")
    )


def history_complete(blocks: DataFrame, records: DataFrame, depth: int | None = None) -> DataFrame:
    """Whether each block's history leads back to revision 1 without a gap.

    ``blocks`` is ``(block, revision)``; ``records`` links ``(block, revision)`` to
    ``(source_block, source_revision)``.  Walks all chains at once by pointer doubling.
    """
    node = lambda b, r: F.concat_ws("@", F.col(b), F.col(r).cast("string"))
    links = records.select(node("block", "revision").alias("doc_id"), node("source_block", "source_revision").alias("previous_id"))
    heads = blocks.select(node("block", "revision").alias("doc_id")).join(links.select("doc_id"), "doc_id", "left_anti").withColumn(
        "previous_id", F.lit(None).cast("string")
    )
    first = links.select(F.col("previous_id").alias("doc_id")).join(links.select("doc_id"), "doc_id", "left_anti").withColumn(
        "previous_id", F.lit(None).cast("string")
    )
    chains = version_chains(links.unionByName(heads).unionByName(first).dropDuplicates(["doc_id"]), depth)
    ends_at_one = F.element_at(F.split("root_id", "@"), -1) == "1"
    return (
        blocks.withColumn("doc_id", node("block", "revision"))
        .join(chains, "doc_id", "left")
        .select("block", "revision", (F.coalesce("complete", F.lit(False)) & F.coalesce(ends_at_one, F.lit(False))).alias("complete"))
    )


def overlay_corrections(cells: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmed edits replace cells; the rest stays as parsed."""
    edits = latest(corrections.filter("confirmed"), keys, ["revision"]).select(*keys, F.col("value").alias("_edit"))
    return cells.join(edits, keys, "left").withColumn("corrected", F.col("_edit").isNotNull()).withColumn(
        "value", F.coalesce("_edit", "value")
    ).drop("_edit")


def propagate_headers(chunks: DataFrame, edited: DataFrame) -> DataFrame:
    """A header edited in one chunk moves to all chunks of its table and reopens their review.

    ``edited`` is ``(chunk_id, table_id, headers)``; ``chunks`` has ``chunk_id``,
    ``table_id``, ``headers``, ``block_revision``, ``review_state``.
    """
    by_table = edited.groupBy("table_id").agg(F.max_by("headers", "chunk_id").alias("_headers"))
    by_hand = edited.select("chunk_id").distinct().withColumn("_hand", F.lit(True))
    changed = F.col("_headers").isNotNull() & (F.col("_headers") != F.col("headers"))
    return (
        chunks.join(by_table, "table_id", "left").join(by_hand, "chunk_id", "left")
        .withColumn("_changed", F.coalesce(changed, F.lit(False)))
        .withColumn("block_revision", F.col("block_revision") + F.col("_changed").cast("int"))
        .withColumn(
            "review_state",
            F.when(F.col("_hand"), "confirmed").when(F.col("_changed"), "unreviewed").otherwise(F.col("review_state")),
        )
        .withColumn("headers", F.coalesce("_headers", "headers"))
        .drop("_headers", "_hand", "_changed")
    )


def merge_dimension(dimension: DataFrame, changes: DataFrame) -> DataFrame:
    """Names by immutable id: a rename keeps the former names in order of change.

    ``dimension`` is ``(id, name, previous_names)``; ``changes`` is ``(id, name, changed_at)``.
    """
    last = latest(changes, ["id"], ["changed_at", "name"]).select("id", F.col("name").alias("_new"))
    renamed = F.col("_new").isNotNull() & F.col("name").isNotNull() & (F.col("_new") != F.col("name"))
    return dimension.join(last, "id", "full").select(
        "id", F.coalesce("_new", "name").alias("name"),
        F.when(
            renamed, F.array_union(F.coalesce("previous_names", F.array().cast("array<string>")), F.array("name"))
        ).otherwise(F.coalesce("previous_names", F.array().cast("array<string>"))).alias("previous_names"),
    )


def learning_versions(feedback: DataFrame, learned: DataFrame, signature: Column) -> DataFrame:
    """Confirmed feedback whose signature is new gets the next version; the rest is a no-op."""
    signed = feedback.filter("status = 'resolved'").withColumn("signature", signature)
    seen = learned.groupBy("feedback_id").agg(
        F.max_by("signature", "version").alias("_last"), F.max("version").alias("_version")
    )
    return signed.join(seen, "feedback_id", "left").filter(~(F.col("_last").eqNullSafe(F.col("signature")))).select(
        "feedback_id", "signature", (F.coalesce("_version", F.lit(0)) + 1).alias("version")
    )


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], keys: DataFrame) -> dict[str, DataFrame]:
    """Remove the rows of the given keys from every table (name -> (table, key column))."""
    return {
        name: df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_anti")
        for name, (df, column) in tables.items()
    }


def index_backlog(documents: DataFrame, coverage: DataFrame, retries: DataFrame, as_of: Column) -> DataFrame:
    """Reviewed or published documents whose vectors do not cover their chunks and that may be tried now.

    ``retries`` is ``(doc_id, retryable, exhausted, next_attempt_at)`` of the present input.
    """
    allowed = F.col("failures").isNull() | (
        F.col("retryable") & ~F.col("exhausted") & (F.col("next_attempt_at") <= as_of)
    )
    return (
        documents.filter(F.col("status").isin("review", "published"))
        .join(coverage, "doc_id")
        .filter(F.col("vector_count") != F.col("chunk_count"))
        .join(retries, "doc_id", "left")
        .filter(allowed)
        .select("doc_id", "chunk_count", "vector_count", F.coalesce("failures", F.lit(0)).alias("failures"))
    )


def keep_recent(df: DataFrame, key: str, at: str, tie: str, count: int, oldest: Column, always: Column | None = None) -> DataFrame:
    """Retention: the newest ``count`` rows per key that are not older than ``oldest``.

    Rows for which ``always`` holds (still running) stay.  The rank limit is
    applied before the shuffle, so a key of any size sends ``count`` rows per task.
    """
    order = W.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    always = F.lit(False) if always is None else always
    newest = df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= count).drop("_n")
    kept = newest.filter(always | (F.col(at) >= oldest))
    running = df.filter(always).join(kept.select(tie), tie, "left_anti")
    return kept.unionByName(running)
