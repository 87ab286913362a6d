"""Access, validity, versions, change feeds and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import facts as fx
from loreloom.operators import access, ordered, versions
from loreloom.plans.registry import Tables, query

AS_OF = "2024-01-15 00:00:00"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


# The documents table with the attributes a catalogue keeps, derived row by row:
# base from source, status from the labels, times from the document number.
CATALOG = """
docs AS (
  SELECT doc_id, source AS base_id, lang, n_chars AS owner_id, split_part(text, chr(10), 1) AS title,
    CASE WHEN toxic = 1 THEN 'archived' WHEN quality = 0 THEN 'review' ELSE 'published' END AS status,
    CASE WHEN lang = 'de' THEN 'confidential' ELSE 'internal' END AS sensitivity,
    CASE WHEN n_chars < 200 THEN TIMESTAMP '2024-01-02' END AS deleted_at,
    CASE WHEN lang = 'es' AND n_chars > 3000 THEN 'withdrawn' ELSE 'active' END AS access_state,
    CASE WHEN lang = 'es' THEN TIMESTAMP '2024-01-10' + to_minutes(doc_id * 10) END AS fresh_until,
    CASE WHEN lang = 'fr' THEN TIMESTAMP '2024-01-12' + to_minutes(doc_id * 10) END AS effective_at,
    CASE WHEN n_chars > 2000 THEN TIMESTAMP '2024-01-20' + to_minutes(n_chars) END AS expires_at,
    CASE WHEN n_chars > 1000 THEN TIMESTAMP '2024-01-01' + to_minutes(n_chars * 4) END AS review_due_at
  FROM documents LEFT JOIN labels USING (doc_id)),
src AS (SELECT source, CAST(regexp_extract(source, '[0-9]+') AS INT) AS n, min(doc_id) AS owner_id FROM documents GROUP BY source),
bases AS (SELECT source AS base_id, owner_id, n, CASE n % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'department' ELSE 'private' END AS visibility,
  ['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'][(n % 5) + 1] AS department FROM src),
users AS (SELECT c_custkey AS user_id, c_mktsegment AS department, c_nationkey,
  CASE WHEN c_acctbal > 9900 THEN 'admin' WHEN c_acctbal > 5000 THEN 'editor' ELSE 'reader' END AS role FROM customer),
members AS (SELECT base_id, owner_id AS user_id FROM bases UNION SELECT base_id, user_id FROM bases JOIN users ON c_nationkey = n)
"""
AVAILABLE = "(access_state <> 'withdrawn' AND (fresh_until IS NULL OR fresh_until > TIMESTAMP '2024-01-15'))"


def minutes(start: str, count: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.to_timestamp(F.lit(start))) + count * 60)


def catalog(t: Tables) -> DataFrame:
    d = t.documents.join(t.labels, "doc_id", "left")
    n, doc = F.col("n_chars"), F.col("doc_id")
    return d.select(
        "doc_id", F.col("source").alias("base_id"), "lang", n.alias("owner_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(F.col("toxic") == 1, "archived").when(F.col("quality") == 0, "review").otherwise("published").alias("status"),
        F.when(F.col("lang") == "de", "confidential").otherwise("internal").alias("sensitivity"),
        F.when(n < 200, F.to_timestamp(F.lit("2024-01-02"))).alias("deleted_at"),
        F.when((F.col("lang") == "es") & (n > 3000), "withdrawn").otherwise("active").alias("access_state"),
        F.when(F.col("lang") == "es", minutes("2024-01-10", doc * 10)).alias("fresh_until"),
        F.when(F.col("lang") == "fr", minutes("2024-01-12", doc * 10)).alias("effective_at"),
        F.when(n > 2000, minutes("2024-01-20", n)).alias("expires_at"),
        F.when(n > 1000, minutes("2024-01-01", n * 4)).alias("review_due_at"),
    )


def users(t: Tables) -> DataFrame:
    balance = F.col("c_acctbal")
    return t.customer.select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("department"), "c_nationkey",
        F.when(balance > 9900, "admin").when(balance > 5000, "editor").otherwise("reader").alias("role"),
    )


def bases(t: Tables) -> DataFrame:
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    src = t.documents.groupBy("source").agg(F.min("doc_id").alias("owner_id")).withColumn("n", number)
    segments = F.array(*[F.lit(s) for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return src.select(
        F.col("source").alias("base_id"), "owner_id", "n",
        F.when(F.col("n") % 3 == 0, "company").when(F.col("n") % 3 == 1, "department").otherwise("private").alias("visibility"),
        F.get(segments, F.col("n") % 5).alias("department"),
    )


def members(t: Tables) -> DataFrame:
    """Base owners and the customers of the nation with the base's number."""
    places = bases(t)
    nation = places.join(t.customer, F.col("n") == F.col("c_nationkey")).select("base_id", F.col("c_custkey").alias("user_id"))
    return places.select("base_id", F.col("owner_id").alias("user_id")).unionByName(nation).distinct()


@query(
    "retrievable_docs",
    f"""WITH {CATALOG} SELECT doc_id, base_id FROM docs WHERE deleted_at IS NULL AND {AVAILABLE} AND status = 'published'
      AND (effective_at IS NULL OR effective_at <= TIMESTAMP '2024-01-15') AND (expires_at IS NULL OR expires_at > TIMESTAMP '2024-01-15')""",
)
def retrievable_docs(t: Tables):
    return catalog(t).filter(access.retrievable(as_of())).select("doc_id", "base_id")


ACL = f"""WITH {CATALOG},
d AS (SELECT docs.*, b.owner_id AS base_owner, u.department AS owner_dept, m.user_id IS NOT NULL AS owner_member,
    CASE b.visibility WHEN 'company' THEN 'everyone' WHEN 'department' THEN 'dept:' || b.department END AS wide, {AVAILABLE} AS available
  FROM docs JOIN bases b USING (base_id) LEFT JOIN users u ON u.user_id = docs.owner_id
  LEFT JOIN members m ON m.base_id = docs.base_id AND m.user_id = docs.owner_id WHERE deleted_at IS NULL),
i AS (SELECT *, owner_member OR coalesce(wide = 'everyone' OR wide = 'dept:' || owner_dept, false) AS inside FROM d),
g AS (
  SELECT doc_id, 'role:admin' AS principal, true AS w FROM i
  UNION ALL SELECT doc_id, 'member:' || base_id, false FROM i WHERE status = 'published' AND available
  UNION ALL SELECT doc_id, wide, false FROM i WHERE status = 'published' AND available AND sensitivity <> 'confidential' AND wide IS NOT NULL
  UNION ALL SELECT doc_id, 'user:' || owner_id, false FROM i WHERE available AND inside
  UNION ALL SELECT doc_id, 'editor:' || owner_id, true FROM i WHERE inside
  UNION ALL SELECT doc_id, 'editor:' || base_owner, true FROM i),
acl AS (SELECT doc_id, principal, bool_or(w) AS can_write FROM g GROUP BY ALL)
"""


@query("document_acl", ACL + "SELECT doc_id, principal, can_write FROM acl")
def document_acl(t: Tables):
    return access.document_acl(catalog(t), bases(t), members(t), users(t), as_of())


@query(
    "visible_docs",
    ACL + """, p AS (SELECT user_id, unnest(['user:' || user_id, 'everyone', 'dept:' || department, CASE role WHEN 'admin' THEN 'role:admin' END,
        CASE WHEN role IN ('admin', 'editor') THEN 'editor:' || user_id END]) AS principal FROM users
      UNION SELECT user_id, 'member:' || base_id FROM members JOIN users USING (user_id))
    SELECT user_id, count(DISTINCT doc_id) AS readable, count(DISTINCT CASE WHEN can_write THEN doc_id END) AS writable
    FROM p JOIN acl USING (principal) WHERE user_id IN (SELECT owner_id FROM bases) GROUP BY user_id""",
)
def visible_docs(t: Tables):
    """What each base owner may see."""
    places = bases(t)
    principals = access.user_principals(users(t), members(t))
    acl = access.document_acl(catalog(t), places, members(t), users(t), as_of())
    seen = access.visible_documents(acl, principals, places.select(F.col("owner_id").alias("user_id")).distinct())
    return seen.groupBy("user_id").agg(F.count("*").alias("readable"), F.count_if("can_write").alias("writable"))


@query(
    "catalog_listing",
    f"""WITH {CATALOG} SELECT doc_id, title FROM docs WHERE deleted_at IS NULL AND status = 'published'
      AND contains(lower(title || ' ' || lang), 'the')""",
)
def catalog_listing(t: Tables):
    docs = catalog(t).withColumn("file_name", F.col("lang")).withColumn("tags", F.array("lang"))
    return access.catalog_filter(docs, None, "published", "the").select("doc_id", "title")


@query(
    "reference_currency",
    """WITH refs AS (SELECT conv_id, turn, item_id AS doc_id FROM conversations JOIN benchmark ON item_id = conv_id WHERE role = 'assistant'
        UNION ALL SELECT conv_id, turn, conv_id FROM conversations WHERE role = 'assistant'),
      live AS (SELECT doc_id FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id))
    SELECT conv_id, bool_and(live.doc_id IS NOT NULL) AS current FROM refs LEFT JOIN live USING (doc_id) GROUP BY conv_id""",
)
def reference_currency(t: Tables):
    """Answers cite documents by hash; those without a good label are gone."""
    said = t.conversations.filter("role = 'assistant'")
    own = said.select("conv_id", F.col("conv_id").alias("doc_id"))
    more = said.join(t.benchmark, F.col("item_id") == F.col("conv_id")).select("conv_id", F.col("item_id").alias("doc_id"))
    hashed = t.documents.select("doc_id", F.lit(1).alias("version"), F.sha2("text", 256).alias("fingerprint"))
    refs = own.unionByName(more).join(hashed, "doc_id", "left")
    live = hashed.join(t.labels.filter("quality = 1"), "doc_id", "left_semi")
    return access.references_current(refs, "conv_id", live)


@query(
    "row_fingerprint",
    """SELECT o_orderkey, sha256('["' || o_orderkey || '","' || o_orderstatus || '","' || o_orderpriority || '"]') AS fingerprint,
      sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS digest FROM orders""",
)
def row_fingerprint(t: Tables):
    named = t.orders.withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"})
    return named.select(
        "o_orderkey", fx.fingerprint("o_orderkey", "status", "priority").alias("fingerprint"),
        fx.canonical_digest("status", "priority").alias("digest"),
    )


@query(
    "latest_version",
    """SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts
    FROM events GROUP BY user_id""",
)
def latest_version(t: Tables):
    return versions.latest(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@query(
    "version_states",
    """WITH v AS (SELECT user_id AS family_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, ts AS effective_at,
        CASE WHEN event_type = 'error' THEN 'review' ELSE 'published' END AS status FROM events),
      c AS (SELECT family_id, max(version) FILTER (status = 'published' AND effective_at <= TIMESTAMP '2024-01-15') AS cur FROM v GROUP BY family_id)
    SELECT event_id, version, CASE WHEN status = 'published' AND version = cur THEN 'current'
      WHEN status = 'published' AND version < cur THEN 'superseded' WHEN status = 'published' AND effective_at > TIMESTAMP '2024-01-15' THEN 'scheduled' ELSE status END AS version_state
    FROM v JOIN c USING (family_id)""",
)
def version_states(t: Tables):
    numbered = ordered.number_rows(
        t.events, ["user_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("minute", "ts"), "version"
    )
    rows = numbered.select(
        F.col("user_id").alias("family_id"), "event_id", "version", F.col("ts").alias("effective_at"),
        F.when(F.col("event_type") == "error", "review").otherwise("published").alias("status"),
    )
    return versions.current_versions(rows, as_of()).select("event_id", "version", "version_state")


@query(
    "next_sequence",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events""",
)
def next_sequence(t: Tables):
    return ordered.number_rows(
        t.events, ["user_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("minute", "ts"), "sequence"
    ).select("event_id", "sequence")


HALVES = """old AS (SELECT user_id AS external_id, arg_max(md5(event_type || value), (ts, event_id)) AS hash, max(ts) AS at FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
new AS (SELECT user_id AS external_id, arg_max(md5(event_type || value), (ts, event_id)) AS hash, max(ts) AS at FROM events WHERE ts >= TIMESTAMP '2024-01-14' AND event_type <> 'view' GROUP BY user_id)"""


def halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two overlapping halves of the events as stored state and source listing."""
    hashed = t.events.select(
        F.col("user_id").alias("external_id"), F.md5(F.concat("event_type", F.col("value").cast("string"))).alias("hash"), "ts", "event_id", "event_type"
    )
    cut = lambda df: versions.latest(df, ["external_id"], ["ts", "event_id"])
    old = cut(hashed.filter(F.col("ts") < "2024-01-16"))
    new = cut(hashed.filter((F.col("ts") >= "2024-01-14") & (F.col("event_type") != "view")))
    return old, new


@query(
    "snapshot_diff",
    f"""WITH {HALVES} SELECT coalesce(old.external_id, new.external_id) AS external_id,
      CASE WHEN old.external_id IS NULL THEN 'created' WHEN new.external_id IS NULL THEN 'archived' WHEN old.hash = new.hash THEN 'unchanged' ELSE 'updated' END AS status
    FROM old FULL JOIN new ON old.external_id = new.external_id""",
)
def snapshot_diff(t: Tables):
    old, new = halves(t)
    return versions.snapshot_diff(new, old.withColumn("deleted", F.lit(False)), ["external_id"])


CDC = """WITH st AS (SELECT user_id AS external_id, arg_max(event_type, (ts, event_id)) AS h, max(ts) AS at FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
ch AS (SELECT user_id AS external_id, arg_max(event_type, (ts, event_type)) AS h, max(ts) AS at FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' GROUP BY user_id),
a AS (SELECT ch.external_id, ch.h, ch.at, st.h AS oh, st.at AS oat, CASE WHEN st.h = 'signup' THEN 'skipped_tombstone' WHEN ch.h = 'error' THEN 'withdrawn' WHEN ch.at < st.at THEN 'skipped_older'
  WHEN ch.h = st.h THEN 'refreshed' WHEN st.external_id IS NOT NULL THEN 'updated' ELSE 'created' END AS action FROM ch LEFT JOIN st USING (external_id))
"""


def cdc_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.events.select(F.col("user_id").alias("external_id"), F.col("event_type").alias("content_hash"), "ts", "event_id")
    state = versions.latest(e.filter(F.col("ts") < "2024-01-16"), ["external_id"], ["ts", "event_id"]).select(
        "external_id", "content_hash", F.col("ts").alias("source_updated_at"), F.lit("active").alias("access_state"),
        (F.col("content_hash") == "signup").alias("tombstone"), F.lit(1).alias("version"),
    )
    changes = e.filter(F.col("ts") >= "2024-01-15 12:00:00").select(
        "external_id", "content_hash", F.col("ts").alias("updated_at"),
        (F.col("content_hash") == "error").alias("deleted"), F.lit(True).alias("allowed"),
    )
    return state, changes


@query("cdc_actions", CDC + "SELECT external_id, h AS content_hash, action FROM a")
def cdc_actions(t: Tables):
    state, changes = cdc_inputs(t)
    return versions.change_actions(state, changes).select("external_id", "content_hash", "action")


@query(
    "cdc_apply",
    CDC + """SELECT coalesce(a.external_id, st.external_id) AS external_id,
      CASE WHEN a.action IS NULL OR a.action LIKE 'skipped%' THEN st.h WHEN a.action = 'withdrawn' THEN st.h ELSE a.h END AS content_hash,
      CASE WHEN a.action = 'withdrawn' THEN 'withdrawn' ELSE 'active' END AS access_state,
      (CASE WHEN st.external_id IS NULL THEN 0 ELSE 1 END + CASE WHEN a.action IN ('created', 'updated') THEN 1 ELSE 0 END)::INT AS version
    FROM st FULL JOIN a ON st.external_id = a.external_id""",
)
def cdc_apply(t: Tables):
    state, changes = cdc_inputs(t)
    return versions.apply_changes(state, changes).select("external_id", "content_hash", "access_state", "version")


@query(
    "upsert",
    """WITH ch AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id),
    st AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id)
    SELECT * FROM st ANTI JOIN ch USING (user_id) UNION ALL SELECT * FROM ch WHERE event_type <> 'error'""",
)
def upsert(t: Tables):
    e = t.events.select("user_id", "event_id", "event_type", "ts")
    state = versions.latest(e.filter(F.col("ts") < "2024-01-16"), ["user_id"], ["ts", "event_id"])
    changes = e.filter(F.col("ts") >= "2024-01-16").withColumn("deleted", F.col("event_type") == "error")
    return versions.upsert(state, changes, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query(
    "version_chain",
    """WITH RECURSIVE l AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    w AS (SELECT event_id, event_id AS root, 1 AS n FROM l WHERE prev IS NULL UNION ALL SELECT l.event_id, w.root, w.n + 1 FROM l JOIN w ON l.prev = w.event_id)
    SELECT event_id, root AS root_id, n::BIGINT AS length FROM w""",
)
def version_chain(t: Tables):
    """Each event follows the user's previous one."""
    from pyspark.sql import Window as W

    numbered = ordered.number_rows(t.events, ["user_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("minute", "ts"))
    before = numbered.select("user_id", (F.col("number") + 1).alias("number"), F.col("event_id").alias("previous_id"))
    linked = numbered.join(before, ["user_id", "number"], "left").select(F.col("event_id").alias("doc_id"), "previous_id")
    return versions.version_chains(linked).select(F.col("doc_id").alias("event_id"), "root_id", "length")


RULES = {
    ("new", "signup"): "member", ("new", "view"): "visitor", ("visitor", "view"): "visitor", ("visitor", "signup"): "member",
    ("visitor", "click"): "engaged", ("engaged", "signup"): "member", ("engaged", "error"): "visitor",
    ("member", "view"): "member", ("member", "click"): "active", ("active", "purchase"): "buyer", ("buyer", "view"): "member",
    ("active", "error"): "member", ("buyer", "error"): "new",
}


def _rules_sql() -> str:
    rows = ", ".join(f"('{s}', '{a}', '{to}')" for (s, a), to in RULES.items())
    return f"rules(s, a, nx) AS (VALUES {rows})"


@query(
    "transition_replay",
    f"""WITH RECURSIVE {_rules_sql()},
    e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    w AS (SELECT user_id, event_id, event_type, k, 'new' AS f, coalesce(nx, 'new') AS t, nx IS NOT NULL AS ok FROM e LEFT JOIN rules ON s = 'new' AND a = event_type WHERE k = 1
      UNION ALL SELECT e.user_id, e.event_id, e.event_type, e.k, w.t, coalesce(nx, w.t), nx IS NOT NULL
      FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1 LEFT JOIN rules ON s = w.t AND a = e.event_type)
    SELECT user_id, event_id, f AS from_state, t AS to_state, ok AS accepted FROM w""",
)
def transition_replay(t: Tables):
    done = ordered.replay(t.events, "user_id", ["ts", "event_id"], "event_type", F.date_trunc("second", "ts"), F.date_trunc("hour", "ts"), RULES, "new")
    return done.select("user_id", "event_id", "from_state", "to_state", "accepted")


@query(
    "retention",
    """SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events)
    WHERE event_type = 'error' OR (k <= 500 AND ts >= TIMESTAMP '2024-01-10')""",
)
def retention(t: Tables):
    """Newest 500 per type, not before January 10; errors count as running."""
    kept = versions.keep_recent(
        t.events, "event_type", "ts", "event_id", 500, F.to_timestamp(F.lit("2024-01-10")), F.col("event_type") == "error"
    )
    return kept.select("event_id")


@query(
    "dimension_renames",
    """WITH d AS (SELECT c_nationkey AS id, arg_max(c_name, c_custkey) AS name FROM customer WHERE c_custkey < (SELECT count(*) // 2 FROM customer) GROUP BY c_nationkey),
    ch AS (SELECT c_nationkey AS id, arg_max(c_name, (c_acctbal, c_name)) AS name FROM customer GROUP BY c_nationkey)
    SELECT ch.id::INT AS id, ch.name, CASE WHEN d.name <> ch.name THEN d.name ELSE '' END AS previous FROM ch LEFT JOIN d USING (id)""",
)
def dimension_renames(t: Tables):
    half = t.customer.select((F.count("*") / 2).cast("long")).scalar()
    old = t.customer.filter(F.col("c_custkey") < half).groupBy(F.col("c_nationkey").alias("id")).agg(
        F.max_by("c_name", "c_custkey").alias("name")
    ).withColumn("previous_names", F.array().cast("array<string>"))
    changes = t.customer.select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("changed_at"))
    return versions.merge_dimension(old, changes).select("id", "name", F.array_join("previous_names", ",").alias("previous"))


@query(
    "cascade_delete",
    """SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def cascade_delete(t: Tables):
    gone = t.conversations.filter("role = 'system'").select("conv_id")
    left = versions.cascade_delete({"messages": (t.conversations, "conv_id")}, gone)
    return left["messages"].select("conv_id", "turn")


@query(
    "index_backlog",
    f"""WITH {CATALOG}, c AS (SELECT doc_id, (n_chars // 1200 + 1) AS chunk_count FROM documents), v AS (SELECT vec_id AS doc_id, 1 AS vector_count FROM embeddings),
    r AS (SELECT user_id AS doc_id, count(*) AS failures, max(ts) AS last_at FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT doc_id, chunk_count, coalesce(vector_count, 0)::BIGINT AS vector_count, coalesce(failures, 0) AS failures FROM docs JOIN c USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN r USING (doc_id)
    WHERE status IN ('review', 'published') AND coalesce(vector_count, 0) <> chunk_count AND (failures IS NULL OR (failures < 3 AND last_at <= TIMESTAMP '2024-01-15'))""",
)
def index_backlog(t: Tables):
    cover = t.documents.select("doc_id", (F.floor(F.col("n_chars") / 1200) + 1).alias("chunk_count")).join(
        t.embeddings.select(F.col("vec_id").alias("doc_id"), F.lit(1).cast("long").alias("vector_count")), "doc_id", "left"
    ).fillna(0, ["vector_count"])
    failed = t.events.filter(F.col("event_type") == "error").groupBy(F.col("user_id").alias("doc_id")).agg(
        F.count("*").alias("failures"), F.lit(True).alias("retryable"), (F.count("*") >= 3).alias("exhausted"),
        F.max("ts").alias("next_attempt_at"),
    )
    return versions.index_backlog(catalog(t), cover, failed, as_of())


@query(
    "learning_versions",
    """WITH f AS (SELECT doc_id AS feedback_id, md5(quality || '-' || toxic) AS sig FROM labels WHERE quality = 1),
    l AS (SELECT item_id AS feedback_id, md5('1-0') AS sig, 3 AS version FROM benchmark)
    SELECT feedback_id, f.sig AS signature, (coalesce(version, 0) + 1)::INT AS version FROM f LEFT JOIN l USING (feedback_id) WHERE l.sig IS DISTINCT FROM f.sig""",
)
def learning_versions(t: Tables):
    signature = F.md5(F.concat_ws("-", F.col("quality").cast("string"), F.col("toxic").cast("string")))
    feedback = t.labels.select(F.col("doc_id").alias("feedback_id"), F.when(F.col("quality") == 1, "resolved").otherwise("open").alias("status"), "quality", "toxic")
    learned = t.benchmark.select(F.col("item_id").alias("feedback_id"), F.md5(F.lit("1-0")).alias("signature"), F.lit(3).alias("version"))
    return versions.learning_versions(feedback, learned, signature)


@query(
    "base_counts",
    f"""WITH {CATALOG} SELECT b.base_id, count(d.doc_id) AS documents FROM bases b LEFT JOIN (SELECT * FROM docs WHERE deleted_at IS NULL) d USING (base_id) GROUP BY b.base_id""",
)
def base_counts(t: Tables):
    counts = catalog(t).filter("deleted_at IS NULL").groupBy("base_id").agg(F.count("*").alias("documents"))
    return bases(t).select("base_id").join(counts, "base_id", "left").fillna(0, ["documents"])
