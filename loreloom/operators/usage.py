"""Summaries of event logs: usage, latency, errors, traces, deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom import config
from loreloom.operators.ordered import running_sum


def usage_rollup(calls: DataFrame, feature: str = "feature") -> DataFrame:
    """Calls and tokens in total (null feature) and by feature; unknown usage counts as calls only.

    ``calls`` has the feature, ``known``, ``input_tokens`` and ``output_tokens``.
    """
    return calls.rollup(feature).agg(
        F.count("*").alias("calls"),
        F.count_if("known").alias("known_calls"),
        F.count_if(~F.col("known")).alias("unknown_calls"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("input_tokens"))), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("output_tokens"))), F.lit(0)).alias("output_tokens"),
        F.grouping(feature).cast("int").alias("is_total"),
    )


def nearest_rank(df: DataFrame, value: str, quantiles: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Exact nearest-rank percentiles: the element at ``ceil(n p)`` in order.

    Distinct values are counted first and ranks are running sums over value
    buckets, so neither a hot key nor a long list is gathered in one task.
    """
    keys = keys or []
    present = df.filter(F.col(value).isNotNull())
    counted = present.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    # Buckets follow the order of magnitude of the value, then its leading digits.
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(F.abs("_v"), F.lit(1e-9)))) - 2)
    bucket = F.floor(F.col("_v") / scale) * scale
    if not keys:
        counted, keys = counted.withColumn("_all", F.lit(1)), ["_all"]
    ranked = running_sum(counted, keys, [F.col("_v")], F.col("_c"), bucket, "_rank")
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    wanted = ranked.join(totals, keys).groupBy(*keys).agg(
        F.max("_n").alias("n"),
        *[F.min(F.when(F.col("_rank") >= F.ceil(F.col("_n") * p), F.col("_v"))).alias(name) for name, p in quantiles.items()],
    )
    return wanted.drop("_all")


def histogram(df: DataFrame, column: str, missing: str = "unspecified") -> DataFrame:
    """Count by value; null counts as ``unspecified``."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def conditional_counts(df: DataFrame, conditions: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """One row (or one per key) with the number of rows meeting each condition."""
    return df.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"), *[F.count_if(c).alias(name) for name, c in conditions.items()]
    )


def mean_latency(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.sum(value) / F.count(value), 1).alias("mean"), F.count(value).alias("n"))


def interrupted(starts: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Status of each started piece of work; without an end it was interrupted."""
    return starts.join(ends.select(key, "status"), key, "left").withColumn(
        "status", F.coalesce("status", F.lit("interrupted"))
    )


def latest_attempts(steps: DataFrame) -> DataFrame:
    """The last attempt of every step of a trace.

    ``steps`` is ``(trace_id, step, attempt, started_at, status, duration_ms)``.
    """
    return steps.groupBy("trace_id", "step").agg(
        F.max_by(F.struct("started_at", "status", "duration_ms"), "attempt").alias("s"), F.max("attempt").alias("attempts")
    ).select("trace_id", "step", "attempts", "s.*")


def trace_summary(steps: DataFrame) -> DataFrame:
    """Per trace: steps, failures, whole time span; the ordered steps stay a table."""
    return latest_attempts(steps).groupBy("trace_id").agg(
        F.count("*").alias("steps"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.min("started_at").alias("started_at"), F.max("started_at").alias("last_step_at"),
        F.sum("duration_ms").alias("duration_ms"),
    )


def reusable_steps(steps: DataFrame, earlier: DataFrame) -> DataFrame:
    """Steps whose input equals that of an earlier successful attempt, with that attempt.

    Both are ``(run_id, step, attempt, input_hash, status)``.
    """
    good = earlier.filter("status = 'succeeded'").groupBy("run_id", "step", "input_hash").agg(F.max("attempt").alias("reused_attempt"))
    return steps.join(good, ["run_id", "step", "input_hash"], "left").withColumn("reused", F.col("reused_attempt").isNotNull())


def retry_schedule(
    attempts: DataFrame, key: list[str], at: str, tie: str, bucket: Column,
    delays: tuple[int, ...] = config.RETRY_DELAYS_SECONDS, limit: int = config.RETRY_ATTEMPTS,
    permanent: tuple[str, ...] = config.PERMANENT_ERRORS,
) -> DataFrame:
    """State after every failed attempt: failures so far, next time, exhausted or not.

    ``attempts`` has the key (document, signature, content revision), ``ok`` and
    ``error_code``.  A success starts a fresh budget; permanent errors are not retried.
    """
    order = [F.col(at), F.col(tie)]
    epochs = running_sum(attempts, key, order, F.col("ok").cast("int"), bucket, "epoch")
    failed = epochs.filter(~F.col("ok"))
    counted = running_sum(failed, [*key, "epoch"], order, F.lit(1), bucket, "failures")
    retryable = ~F.coalesce(F.col("error_code").isin(*permanent), F.lit(False)) if permanent else F.lit(True)
    exhausted = F.col("failures") >= limit
    delay = F.element_at(F.array(*[F.lit(d) for d in delays]), F.least("failures", F.lit(len(delays))).cast("int"))
    return counted.select(
        *key, at, tie, "error_code", "failures", retryable.alias("retryable"), exhausted.alias("exhausted"),
        F.when(retryable & ~exhausted, F.col(at) + F.make_dt_interval(secs=delay)).alias("next_attempt_at"),
    )


def delivery_schedule(attempts: DataFrame, key: list[str], at: str, tie: str, bucket: Column, limit: int = 3) -> DataFrame:
    """Delivery retries: up to three attempts, each waiting 60 seconds times the attempts so far."""
    return retry_schedule(attempts, key, at, tie, bucket, tuple(60 * n for n in range(1, limit + 1)), limit, ())


def idempotent_requests(requests: DataFrame, key: str, fingerprint: str, at: str) -> DataFrame:
    """First request per id is accepted, equal ones repeat it, others conflict with it."""
    first = requests.groupBy(key).agg(F.min_by(F.struct(at, "request_no", fingerprint), F.struct(at, "request_no")).alias("_f"))
    joined = requests.join(first, key)
    outcome = (
        F.when(F.col("request_no") == F.col("_f.request_no"), "accepted")
        .when(F.col(fingerprint) == F.col(f"_f.{fingerprint}"), "repeat")
        .otherwise("conflict")
    )
    return joined.withColumn("outcome", outcome).drop("_f")


def once(events: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The first event per key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(at, tie)).alias("_r")).select(*keys, "_r.*")


def preference_state(events: DataFrame, keys: list[str], kind: str, at: str, tie: str) -> DataFrame:
    """Read, dismissed and helpful flags after all events (restored clears dismissed)."""
    order = F.struct(at, tie)
    dismiss = F.col(kind).isin("dismissed", "restored")
    return events.groupBy(*keys).agg(
        F.bool_or(F.col(kind).isin("read", "opened")).alias("read"),
        F.coalesce(F.max_by(F.when(dismiss, F.col(kind) == "dismissed"), F.when(dismiss, order)), F.lit(False)).alias("dismissed"),
        F.bool_or(F.col(kind) == "helpful").alias("helpful"),
    )


def deliveries(audit: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One delivery per (subscriber, event) for subscribed actions after the subscriber's cursor.

    ``audit`` is ``(sequence, event_id, action)``; ``subscriptions`` is
    ``(hook_id, action, cursor)``, one row per subscribed action.  Repeats are
    removed from the two inputs, where they are few: an event that stands once in
    the audit meets a subscriber once, so the deliveries, one per pair, need no
    shuffle.  Only events logged more than once and rows without a key, which can
    give one id twice, are compared by delivery.
    """
    hooks = subscriptions.groupBy("hook_id", "action").agg(F.min("cursor").alias("cursor"))
    logged = audit.groupBy("event_id").agg(F.count("*").alias("_n"), F.first(F.struct("sequence", "action")).alias("_r"))
    once = logged.filter("_n = 1 AND event_id IS NOT NULL").select("event_id", "_r.*")
    again = audit.join(logged.filter("_n > 1 AND event_id IS NOT NULL").select("event_id"), "event_id", "left_semi").unionByName(
        audit.filter("event_id IS NULL"))
    named, nameless = hooks.filter("hook_id IS NOT NULL"), hooks.filter("hook_id IS NULL")
    compared = _due(again, hooks).unionByName(_due(once, nameless)).dropDuplicates(["delivery_id"])
    return _due(once, named).unionByName(compared)


def delivery_id() -> Column:
    return F.sha2(F.concat_ws(":", "hook_id", "event_id"), 256)


def _due(audit: DataFrame, hooks: DataFrame) -> DataFrame:
    due = audit.join(hooks, "action").filter(F.col("sequence") > F.col("cursor"))
    return due.select(delivery_id().alias("delivery_id"), "hook_id", "event_id", "sequence", "action")


def event_feed(events: DataFrame, cursors: DataFrame) -> DataFrame:
    """Events of each run after the sequence number its reader has seen.

    ``events`` has ``run_id`` and ``sequence``; ``cursors`` is ``(run_id, after)``.
    """
    return events.join(cursors, "run_id").filter(F.col("sequence") > F.col("after")).drop("after")


def expire(df: DataFrame, at: str, seconds: int, as_of: Column) -> DataFrame:
    """Rows younger than their time to live."""
    return df.filter(F.unix_timestamp(as_of) - F.unix_timestamp(at) <= seconds)
