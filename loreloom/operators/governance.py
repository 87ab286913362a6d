"""Rule checks on documents, work queues, attributes and cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom import config
from loreloom.functions.text import is_blank


def split_messages(warnings: Column, notes: Column, known: tuple[str, ...] = config.NOTE_MESSAGES) -> tuple[Column, Column]:
    """Purely informational parser messages move from warnings to notes; both without repeats."""
    empty = F.array().cast("array<string>")
    said, noted = F.coalesce(warnings, empty), F.coalesce(notes, empty)
    informational = F.array(*[F.lit(m) for m in known])
    moved = F.filter(said, lambda m: F.array_contains(informational, m))
    return (
        F.array_distinct(F.filter(said, lambda m: ~F.array_contains(informational, m))),
        F.array_distinct(F.concat(noted, moved)),
    )


def acknowledge(acknowledgements: Column, issue_type: str, fingerprint: Column) -> Column:
    """The acknowledgement map with the entry of one issue type replaced."""
    others = F.map_filter(
        F.coalesce(acknowledgements, F.create_map().cast("map<string,string>")), lambda k, _: k != issue_type
    )
    return F.map_concat(others, F.create_map(F.lit(issue_type), fingerprint))


def document_issues(documents: DataFrame, as_of: Column, soon_days: int = 30) -> DataFrame:
    """Open issues of each document: one row per (document, type) with severity and state.

    ``documents`` has ``doc_id``, ``status``, ``expires_at``, ``review_due_at``,
    ``warnings`` (array), ``warning_fingerprint`` and ``acknowledgements`` (map).
    """
    published = F.col("status") == "published"
    expired = F.coalesce(F.col("expires_at") <= as_of, F.lit(False))
    left = F.unix_timestamp("expires_at") - F.unix_timestamp(as_of)
    acknowledged = F.coalesce(
        F.try_element_at("acknowledgements", F.lit("parse_warning")) == F.col("warning_fingerprint"), F.lit(False)
    )

    def issue(condition: Column, kind: str, severity: str, state: Column | str = "open") -> Column:
        state = F.lit(state) if isinstance(state, str) else state
        return F.when(condition, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), state.alias("issue_status")))

    live = published & ~expired
    rules = F.array_compact(F.array(
        issue(F.col("status") == "failed", "parse_failed", "high"),
        issue(F.col("status") == "review", "pending_review", "medium"),
        issue(published & expired, "expired", "high"),
        issue(live & F.coalesce(left < soon_days * 86400, F.lit(False)), "expiring", "medium"),
        issue(live & F.col("review_due_at").isNull(), "no_review_date", "low"),
        issue(live & F.coalesce(F.col("review_due_at") <= as_of, F.lit(False)), "review_due", "medium"),
        issue(
            (F.size(F.coalesce("warnings", F.array().cast("array<string>"))) > 0) & ~F.col("status").isin("archived", "superseded"),
            "parse_warning", "medium", F.when(acknowledged, "acknowledged").otherwise("open"),
        ),
    ))
    return documents.select("doc_id", "status", F.explode(rules).alias("i")).select(
        F.concat_ws(":", "doc_id", "i.type").alias("issue_id"), "doc_id", "status", "i.type", "i.severity", "i.issue_status"
    )


def severity_rank(col: Column) -> Column:
    """0 for the most severe; unknown severities last."""
    order = F.array(*[F.lit(s) for s in config.SEVERITY_ORDER])
    place = F.array_position(order, col)
    return F.when(place > 0, place - 1).otherwise(F.lit(len(config.SEVERITY_ORDER))).cast("int")


def work_queue(
    issues: DataFrame, conflicts: DataFrame, relations: DataFrame, blocks: DataFrame, tasks: DataFrame, feedback: DataFrame
) -> DataFrame:
    """Everything that waits for a person in one schema: kind, id, document, status, severity, count.

    Open document issues, open conflict candidates (``issue_id, doc_id, status``),
    candidate or stale relations and unconfirmed blocks counted per document,
    tasks (``task_id, doc_id, status, kind``) and unresolved feedback
    (``feedback_id, doc_id, status``).
    """
    kind = (
        F.when(F.col("type") == "pending_review", "review").when(F.col("type") == "parse_failed", "processing")
        .when(F.col("type") == "parse_warning", "evidence").otherwise("review_due")
    )
    text = lambda c: F.col(c).cast("string").alias("id")
    parts = [
        issues.filter("issue_status = 'open'").select(kind.alias("kind"), text("issue_id"), "doc_id", "status", "severity"),
        conflicts.filter("status IN ('open', 'in_review', 'stale')").select(F.lit("conflict").alias("kind"), text("issue_id"), "doc_id", "status"),
        relations.filter("status = 'candidate' OR stale").groupBy("doc_id").agg(F.count("*").alias("items")).select(
            F.lit("evidence").alias("kind"), F.concat(F.lit("relations:"), F.col("doc_id")).alias("id"), "doc_id", "items"
        ),
        blocks.filter("review_required AND review_state <> 'confirmed'").groupBy("doc_id").agg(F.count("*").alias("items")).select(
            F.lit("evidence").alias("kind"), F.concat(F.lit("blocks:"), F.col("doc_id")).alias("id"), "doc_id", "items"
        ),
        tasks.filter("status IN ('queued', 'processing')").select(F.lit("processing").alias("kind"), text("task_id"), "doc_id", "status", F.lit("low").alias("severity")),
        tasks.filter("status = 'failed' AND kind = 'index'").select(F.lit("processing").alias("kind"), text("task_id"), "doc_id", "status", F.lit("high").alias("severity")),
        feedback.filter("status <> 'resolved'").select(F.lit("feedback").alias("kind"), text("feedback_id"), "doc_id", "status"),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.select(
        "kind", "id", "doc_id", F.coalesce("status", F.lit("open")).alias("status"),
        F.coalesce("severity", F.lit("medium")).alias("severity"), F.coalesce("items", F.lit(1)).alias("items"),
    )


def suggest_attributes(hints: DataFrame, template: DataFrame) -> DataFrame:
    """Template fields of each document with the hinted value; missing required ones stay blank.

    ``hints`` is ``(doc_id, key, value, source)``; ``template`` is ``(key, label, required)``.
    Optional fields without a hint produce no row, and nothing is invented.
    """
    hinted = hints.filter(~is_blank(F.col("value"))).join(template, "key").select(
        "doc_id", "key", "label", "value", "source"
    )
    found = hinted.groupBy("doc_id").agg(F.collect_set("key").alias("_have"))
    required = template.filter("required").agg(F.collect_list(F.struct("key", "label")).alias("f")).select("f").scalar()
    every = hints.select("doc_id").distinct().join(found, "doc_id", "left")
    have = F.coalesce("_have", F.array().cast("array<string>"))
    missing = every.withColumn("_f", required).select(
        "doc_id", F.explode(F.filter("_f", lambda f: ~F.array_contains(have, f["key"]))).alias("f")
    ).select("doc_id", "f.key", "f.label", F.lit("").alias("value"), F.lit("inferred").alias("source"))
    return hinted.unionByName(missing)


def card_drafts(members: DataFrame, chunks: DataFrame, chars: int | None = None) -> DataFrame:
    """Draft per card: the first chunk of each member document, in member order.

    ``members`` is ``(card_id, position, doc_id)``, a handful of documents per
    card; only their chunks are gathered.  With ``chars`` each excerpt ends there.
    """
    shown = F.col("chunk_text") if chars is None else F.substring("chunk_text", 1, chars)
    wanted = chunks.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
    first = wanted.groupBy("doc_id").agg(F.min_by(shown, "ordinal").alias("excerpt"))
    return members.join(first, "doc_id").groupBy("card_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "doc_id", "excerpt"))).alias("sources")
    ).select("card_id", F.size("sources").alias("documents"), F.array_join(F.transform("sources", lambda s: s["excerpt"]), "\n\n").alias("body"))
