"""Event-log summaries: the events table as model calls, runs, requests and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.operators import usage
from loreloom.operators.versions import keep_recent
from loreloom.plans.registry import Tables, query


def calls(t: Tables) -> DataFrame:
    """Each event as a model call; errors report no usage."""
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select(
        F.col("event_type").alias("feature"), (F.col("event_type") != "error").alias("known"),
        k.alias("input_tokens"), (k * 2).alias("output_tokens"), "value", "user_id", "event_id", "ts",
    )


K = "json_extract_string(props, '$.k')::BIGINT"


@query(
    "usage_rollup",
    f"""SELECT event_type AS feature, count(*) AS calls, count(*) FILTER (event_type <> 'error') AS known_calls, count(*) FILTER (event_type = 'error') AS unknown_calls,
      coalesce(sum({K}) FILTER (event_type <> 'error'), 0)::BIGINT AS input_tokens, coalesce(sum(2 * {K}) FILTER (event_type <> 'error'), 0)::BIGINT AS output_tokens,
      grouping(event_type)::INT AS is_total FROM events GROUP BY ROLLUP (event_type)""",
)
def usage_rollup(t: Tables):
    return usage.usage_rollup(calls(t))


@query(
    "latency_quantiles",
    """SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type""",
)
def latency_quantiles(t: Tables):
    return usage.nearest_rank(t.events, "value", {"p50": 0.5, "p95": 0.95}, ["event_type"])


@query("mean_latency", "SELECT event_type, round(sum(value) / count(value), 1) AS mean, count(value) AS n FROM events GROUP BY event_type")
def mean_latency(t: Tables):
    return usage.mean_latency(t.events, "value", ["event_type"])


@query(
    "error_histogram",
    f"SELECT ({K} % 7)::VARCHAR AS code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
)
def error_histogram(t: Tables):
    errors = t.events.filter("event_type = 'error'").select((F.get_json_object("props", "$.k").cast("long") % 7).alias("code"))
    return usage.histogram(errors, "code")


@query("status_counts", "SELECT coalesce(quality::VARCHAR, 'unspecified') AS quality, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def status_counts(t: Tables):
    return usage.histogram(t.documents.select("doc_id").join(t.labels, "doc_id", "left"), "quality")


@query(
    "run_dashboard",
    """SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
      count(*) FILTER (event_type = 'view' AND value < 5) AS waiting FROM events""",
)
def run_dashboard(t: Tables):
    kind = F.col("event_type")
    return usage.conditional_counts(t.events, {
        "succeeded": kind == "purchase", "failed": kind == "error", "waiting": (kind == "view") & (F.col("value") < 5),
    })


@query(
    "interrupted_work",
    """WITH s AS (SELECT event_id, user_id FROM events WHERE event_type = 'signup'), e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 95)
    SELECT event_id, CASE WHEN e.user_id IS NULL THEN 'interrupted' ELSE 'succeeded' END AS status FROM s LEFT JOIN e USING (user_id)""",
)
def interrupted_work(t: Tables):
    starts = t.events.filter("event_type = 'signup'").select("event_id", "user_id")
    ends = t.events.filter((F.col("event_type") == "purchase") & (F.col("value") > 95)).select("user_id", F.lit("succeeded").alias("status")).distinct()
    return usage.interrupted(starts, ends, "user_id").select("event_id", "status")


def steps(t: Tables) -> DataFrame:
    """A user's day is a trace, the event type its step, repeated events its attempts."""
    from loreloom.operators.ordered import number_rows

    day = F.date_format("ts", "yyyy-MM-dd")
    keyed = t.events.withColumn("trace_id", F.concat_ws("/", "user_id", day)).withColumnRenamed("event_type", "step")
    return number_rows(keyed, ["trace_id", "step"], [F.col("ts"), F.col("event_id")], F.date_trunc("minute", "ts"), "attempt").select(
        "trace_id", "step", "attempt", F.col("ts").alias("started_at"),
        F.when(F.col("value") < 10, "failed").otherwise("succeeded").alias("status"),
        F.floor(F.col("value") * 100).cast("long").alias("duration_ms"), "event_id",
    )


@query(
    "trace_summary",
    """WITH l AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS trace_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS at FROM events GROUP BY ALL)
    SELECT trace_id, count(*) AS steps, count(*) FILTER (value < 10) AS failed, sum(floor(value * 100))::BIGINT AS duration_ms FROM l GROUP BY trace_id""",
)
def trace_summary(t: Tables):
    return usage.trace_summary(steps(t)).select("trace_id", "steps", "failed", "duration_ms")


@query(
    "step_reuse",
    f"""WITH s AS (SELECT event_id, user_id AS run_id, event_type AS step, {K} AS h, ts, value FROM events),
    g AS (SELECT run_id, step, h, max(event_id) AS reused FROM s WHERE ts < TIMESTAMP '2024-01-20' AND value >= 10 GROUP BY ALL)
    SELECT event_id, reused AS reused_attempt, reused IS NOT NULL AS reused FROM s LEFT JOIN g USING (run_id, step, h) WHERE ts >= TIMESTAMP '2024-01-20'""",
)
def step_reuse(t: Tables):
    s = t.events.select(
        "event_id", F.col("user_id").alias("run_id"), F.col("event_type").alias("step"), F.col("event_id").alias("attempt"),
        F.get_json_object("props", "$.k").alias("input_hash"), F.when(F.col("value") < 10, "failed").otherwise("succeeded").alias("status"), "ts",
    )
    now = s.filter(F.col("ts") >= "2024-01-20")
    return usage.reusable_steps(now, s.filter(F.col("ts") < "2024-01-20")).select("event_id", "reused_attempt", "reused")


@query(
    "retry_schedule",
    """WITH a AS (SELECT user_id, event_id, ts, event_type = 'purchase' AS ok, CASE WHEN event_type = 'signup' THEN 'MODEL_AUTH_FAILED' ELSE 'TIMEOUT' END AS code FROM events WHERE event_type <> 'view'),
    e AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM a),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS failures FROM e WHERE NOT ok)
    SELECT event_id, failures, code <> 'MODEL_AUTH_FAILED' AS retryable, failures >= 3 AS exhausted,
      CASE WHEN code <> 'MODEL_AUTH_FAILED' AND failures < 3 THEN ts + to_seconds(CASE failures WHEN 1 THEN 30 ELSE 120 END) END AS next_attempt_at FROM f""",
)
def retry_schedule(t: Tables):
    kind = F.col("event_type")
    attempts = t.events.filter(kind != "view").select(
        "user_id", "event_id", "ts", (kind == "purchase").alias("ok"),
        F.when(kind == "signup", "MODEL_AUTH_FAILED").otherwise("TIMEOUT").alias("error_code"),
    )
    done = usage.retry_schedule(attempts, ["user_id"], "ts", "event_id", F.date_trunc("minute", "ts"))
    return done.select("event_id", "failures", "retryable", "exhausted", "next_attempt_at")


@query(
    "delivery_retries",
    """WITH a AS (SELECT user_id, event_id, ts, event_type = 'click' AS ok FROM events WHERE event_type IN ('click', 'error')),
    e AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM a),
    f AS (SELECT *, row_number() OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id) AS failures FROM e WHERE NOT ok)
    SELECT event_id, failures, failures >= 3 AS exhausted, CASE WHEN failures < 3 THEN ts + to_seconds(60 * failures) END AS next_attempt_at FROM f""",
)
def delivery_retries(t: Tables):
    kind = F.col("event_type")
    attempts = t.events.filter(kind.isin("click", "error")).select(
        "user_id", "event_id", "ts", (kind == "click").alias("ok"), F.lit("HTTP_500").alias("error_code")
    )
    done = usage.delivery_schedule(attempts, ["user_id"], "ts", "event_id", F.date_trunc("minute", "ts"))
    return done.select("event_id", "failures", "exhausted", "next_attempt_at")


@query(
    "idempotent_requests",
    f"""WITH r AS (SELECT event_id, user_id || ':' || {K} AS rid, event_type AS fp, ts FROM events),
    f AS (SELECT rid, arg_min(event_id, (ts, event_id)) AS first_id, arg_min(fp, (ts, event_id)) AS first_fp FROM r GROUP BY rid)
    SELECT event_id, CASE WHEN event_id = first_id THEN 'accepted' WHEN fp = first_fp THEN 'repeat' ELSE 'conflict' END AS outcome FROM r JOIN f USING (rid)""",
)
def idempotent_requests(t: Tables):
    requests = t.events.select(
        F.concat_ws(":", "user_id", F.get_json_object("props", "$.k")).alias("client_request_id"),
        F.col("event_type").alias("fingerprint"), "ts", F.col("event_id").alias("request_no"),
    )
    found = usage.idempotent_requests(requests, "client_request_id", "fingerprint", "ts")
    return found.select(F.col("request_no").alias("event_id"), "outcome")


@query(
    "dedupe_once",
    f"""SELECT arg_min(event_id, (ts, event_id)) AS event_id, user_id, event_type, {K} % 20 AS item FROM events GROUP BY user_id, event_type, item""",
)
def dedupe_once(t: Tables):
    shown = t.events.select("user_id", "event_type", (F.get_json_object("props", "$.k").cast("long") % 20).alias("item"), "ts", "event_id")
    return usage.once(shown, ["user_id", "event_type", "item"], "ts", "event_id").select("event_id", "user_id", "event_type", "item")


@query(
    "preference_state",
    f"""WITH e AS (SELECT user_id, {K} % 20 AS item, event_id, ts, CASE event_type WHEN 'view' THEN 'read' WHEN 'error' THEN 'dismissed' WHEN 'signup' THEN 'restored' WHEN 'purchase' THEN 'helpful' ELSE 'opened' END AS kind FROM events)
    SELECT user_id, item, bool_or(kind IN ('read', 'opened')) AS read,
      coalesce(arg_max(kind = 'dismissed', (ts, event_id)) FILTER (kind IN ('dismissed', 'restored')), false) AS dismissed, bool_or(kind = 'helpful') AS helpful
    FROM e GROUP BY user_id, item""",
)
def preference_state(t: Tables):
    kinds = F.create_map(*[F.lit(x) for x in ("view", "read", "error", "dismissed", "signup", "restored", "purchase", "helpful", "click", "opened")])
    e = t.events.select(
        "user_id", (F.get_json_object("props", "$.k").cast("long") % 20).alias("item"), "event_id", "ts", F.element_at(kinds, F.col("event_type")).alias("kind")
    )
    return usage.preference_state(e, ["user_id", "item"], "kind", "ts", "event_id")


@query(
    "outbox",
    """WITH h AS (SELECT s_suppkey AS hook_id, unnest(['purchase', CASE WHEN s_nationkey < 10 THEN 'error' ELSE 'signup' END]) AS action, s_suppkey * 50 AS cur FROM supplier)
    SELECT sha256(hook_id || ':' || event_id) AS delivery_id, hook_id, event_id FROM events JOIN h ON action = event_type WHERE event_id > cur""",
)
def outbox(t: Tables):
    audit = t.events.select(F.col("event_id").alias("sequence"), "event_id", F.col("event_type").alias("action"))
    hooks = t.supplier.select(
        F.col("s_suppkey").alias("hook_id"), (F.col("s_suppkey") * 50).alias("cursor"),
        F.explode(F.array(F.lit("purchase"), F.when(F.col("s_nationkey") < 10, "error").otherwise("signup"))).alias("action"),
    )
    return usage.deliveries(audit, hooks).select("delivery_id", "hook_id", "event_id")


@query(
    "newest_requests",
    """SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100 AND ts >= TIMESTAMP '2024-01-25'""",
)
def newest_requests(t: Tables):
    return keep_recent(t.events, "user_id", "ts", "event_id", 100, F.to_timestamp(F.lit("2024-01-25"))).select("event_id")


@query("unexpired", "SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-29 12:00:00') - floor(epoch(ts)) <= 86400")
def unexpired(t: Tables):
    return usage.expire(t.events, "ts", 86_400, F.to_timestamp(F.lit("2024-01-29 12:00:00"))).select("event_id")


@query(
    "event_feed",
    """WITH c AS (SELECT conv_id, min(turn) AS after FROM conversations WHERE role = 'user' GROUP BY conv_id)
    SELECT conv_id AS run_id, turn AS sequence, role FROM conversations JOIN c USING (conv_id) WHERE turn > after""",
)
def event_feed(t: Tables):
    """Every reader has seen up to the first question of the run."""
    events = t.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("sequence"), "role")
    cursors = events.filter("role = 'user'").groupBy("run_id").agg(F.min("sequence").alias("after"))
    return usage.event_feed(events, cursors).select("run_id", "sequence", "role")


@query("newest_events", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def newest_events(t: Tables):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "ts")
