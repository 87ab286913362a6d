"""Who may see which document, as principals and grants.

A user holds a few principals (``user:7``, ``dept:X``, ``member:b`` ...) and a
document at most six grants, whatever the number of users, so that access is an
equi-join and stays linear in users and documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_available(as_of: Column) -> Column:
    return ~(F.col("access_state").eqNullSafe(F.lit("withdrawn"))) & (F.col("fresh_until").isNull() | (F.col("fresh_until") > as_of))


def retrievable(as_of: Column) -> Column:
    """Published, not deleted, source available, inside the validity interval."""
    return (
        F.col("deleted_at").isNull()
        & source_available(as_of)
        & (F.col("status") == "published")
        & (F.col("effective_at").isNull() | (F.col("effective_at") <= as_of))
        & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    )


def _tag(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value.cast("string"))


def base_members(bases: DataFrame) -> DataFrame:
    """``(base_id, user_id)``: owner and named members of each base.

    ``bases`` has ``base_id``, ``owner_id``, ``members`` (array), ``visibility``, ``department``.
    """
    named = F.concat(F.array("owner_id"), F.coalesce("members", F.array().cast("array<bigint>")))
    return bases.select("base_id", F.explode(F.array_distinct(named)).alias("user_id"))


def user_principals(users: DataFrame, members: DataFrame) -> DataFrame:
    """``(user_id, principal)``: own identity plus one principal per membership.

    ``users`` has ``user_id``, ``role``, ``department``.  Bases open to everyone
    or to a department add nothing here; documents name those principals.
    """
    own = users.select("user_id", F.explode(F.array_compact(F.array(
        _tag("user", F.col("user_id")), F.lit("everyone"),
        F.when(F.coalesce("department", F.lit("")) != "", _tag("dept", F.col("department"))),
        F.when(F.col("role") == "admin", F.lit("role:admin")),
        F.when(F.col("role").isin("admin", "editor"), _tag("editor", F.col("user_id"))),
    ))).alias("principal"))
    joined = members.join(users.select("user_id"), "user_id", "left_semi").select(
        "user_id", _tag("member", F.col("base_id")).alias("principal")
    )
    return own.unionByName(joined)


def document_acl(documents: DataFrame, bases: DataFrame, members: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """``(doc_id, principal, can_write)`` grants of every document that is not deleted.

    ``documents`` has ``doc_id``, ``base_id``, ``owner_id``, ``status``,
    ``sensitivity``, ``access_state``, ``fresh_until`` and ``deleted_at``;
    ``members`` is ``(base_id, user_id)`` with owners included.
    Published and available documents open to whoever may enter the base (to
    members only when confidential); owners see every status while they may enter
    the base; editors who own the document or base may write, also when the
    source is gone.
    """
    wide = (
        F.when(F.col("visibility") == "company", F.lit("everyone"))
        .when((F.col("visibility") == "department") & (F.coalesce("department", F.lit("")) != ""), _tag("dept", F.col("department")))
    )
    held = bases.select("base_id", F.col("owner_id").alias("base_owner"), wide.alias("wide"))
    owners = users.select(F.col("user_id").alias("owner_id"), F.col("department").alias("owner_dept"))
    membership = members.select("base_id", F.col("user_id").alias("owner_id"), F.lit(True).alias("owner_member"))
    docs = (
        documents.filter("deleted_at IS NULL").join(held, "base_id")
        .join(owners, "owner_id", "left").join(membership, ["base_id", "owner_id"], "left")
    )
    inside = F.coalesce("owner_member", F.lit(False)) | F.coalesce(
        (F.col("wide") == "everyone") | (F.col("wide") == _tag("dept", F.col("owner_dept"))), F.lit(False)
    )
    available = source_available(as_of)
    open_now = (F.col("status") == "published") & available
    confidential = F.col("sensitivity").eqNullSafe(F.lit("confidential"))
    grant = lambda who, write: F.struct(who.alias("principal"), F.lit(write).alias("can_write"))
    rows = F.array_compact(F.array(
        grant(F.lit("role:admin"), True),
        F.when(open_now, grant(_tag("member", F.col("base_id")), False)),
        F.when(open_now & ~confidential & F.col("wide").isNotNull(), grant(F.col("wide"), False)),
        F.when(available & inside, grant(_tag("user", F.col("owner_id")), False)),
        F.when(inside, grant(_tag("editor", F.col("owner_id")), True)),
        grant(_tag("editor", F.col("base_owner")), True),
    ))
    # At most six grants per document, so equal principals are merged in the row.
    writable = lambda who: F.exists(rows, lambda g: (g["principal"] == who) & g["can_write"])
    names = F.array_distinct(F.transform(rows, lambda g: g["principal"]))
    merged = F.transform(names, lambda n: F.struct(n.alias("principal"), writable(n).alias("can_write")))
    return docs.select("doc_id", F.explode(merged).alias("g")).select("doc_id", "g.principal", "g.can_write")


def visible_documents(acl: DataFrame, principals: DataFrame, users: DataFrame) -> DataFrame:
    """Documents each of the given users may read, and whether they may write."""
    wanted = principals.join(users.select("user_id"), "user_id", "left_semi")
    return acl.join(wanted, "principal").groupBy("user_id", "doc_id").agg(F.max("can_write").alias("can_write"))


def within_scope(base_id: str | None = None, doc_id: int | str | None = None, version: int | None = None) -> Column:
    """Scope filter: a base, a document, or a document at a pinned version."""
    condition = F.lit(True)
    if base_id is not None:
        condition = condition & (F.col("base_id") == base_id)
    if doc_id is not None:
        condition = condition & (F.col("doc_id") == doc_id)
        if version is not None:
            condition = condition & (F.col("version") == version)
    elif version is not None:
        raise ValueError("a version needs a document")
    return condition


def evidence_within_scope(bundles: DataFrame, key: str, refs: str, scopes: DataFrame) -> DataFrame:
    """Whether every reference of a bundle points at the scoped document and version.

    ``refs`` is ``array<struct<doc_id, version>>``; ``scopes`` is ``(key, doc_id, version)``.
    """
    exploded = bundles.select(key, F.explode_outer(refs).alias("r")).join(
        scopes.select(key, F.col("doc_id").alias("_doc"), F.col("version").alias("_version")), key, "left"
    )
    accepted = (
        F.col("_doc").isNull() | F.col("r").isNull()
        | ((F.col("r.doc_id") == F.col("_doc")) & (F.col("r.version").isNull() | (F.col("r.version") == F.col("_version"))))
    )
    return exploded.groupBy(key).agg(F.bool_and(accepted).alias("in_scope"))


def references_current(refs: DataFrame, key: str, documents: DataFrame) -> DataFrame:
    """Whether all references of an answer still match a live document, version and fingerprint.

    ``refs`` is ``(key, doc_id, version, fingerprint)``; ``documents`` holds what the
    caller may retrieve now.
    """
    live = documents.select("doc_id", F.col("version").alias("_v"), F.col("fingerprint").alias("_f"))
    ok = (
        F.col("_f").isNotNull()
        & (F.col("version").isNull() | (F.col("version") == F.col("_v")))
        & (F.col("fingerprint").isNull() | (F.col("fingerprint") == F.col("_f")))
    )
    return refs.join(live, "doc_id", "left").groupBy(key).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("current"))


def trash_state(documents: DataFrame, actions: DataFrame) -> DataFrame:
    """Documents after trash and restore actions: the latest action per document decides ``deleted_at``.

    ``actions`` is ``(doc_id, action, at)`` with action ``trash`` or ``restore``;
    of equal times the greater action wins.  Documents without an action keep
    their state.
    """
    last = actions.groupBy("doc_id").agg(F.max(F.struct("at", "action")).alias("_last"))
    state = (
        F.when(F.col("_last.action") == "trash", F.col("_last.at")).when(F.col("_last").isNull(), F.col("deleted_at"))
    )
    return documents.join(last, "doc_id", "left").withColumn("deleted_at", state).select(documents.columns)


def learning_current(snapshots: DataFrame, documents: DataFrame) -> DataFrame:
    """Whether every source snapshot of a learned document still matches the live document.

    ``snapshots`` is ``(learned_id, doc_id, version, fingerprint)``; ``documents`` is
    ``(doc_id, version, fingerprint)`` of what may be retrieved now.
    """
    live = documents.select("doc_id", F.col("version").alias("_v"), F.col("fingerprint").alias("_f"))
    same = F.coalesce((F.col("version") == F.col("_v")) & (F.col("fingerprint") == F.col("_f")), F.lit(False))
    return snapshots.join(live, "doc_id", "left").groupBy("learned_id").agg(
        F.bool_and(same).alias("current"), F.count_if(~same).alias("changed_sources")
    )


def catalog_filter(documents: DataFrame, base_id: str | None = None, status: str | None = None, text: str = "") -> DataFrame:
    """Listing filter: base, status and free text over title, file name and tags."""
    found = documents.filter("deleted_at IS NULL")
    if base_id:
        found = found.filter(F.col("base_id") == base_id)
    if status:
        found = found.filter(F.col("status") == status)
    if text:
        found = found.filter(text_search(text, ["title", "file_name"], ["tags"]))
    return found


def text_search(text: str, columns: list[str], arrays: list[str] | None = None) -> Column:
    """Case-insensitive containment in any of the columns or array elements."""
    needle = F.lit(text.strip().lower())
    joined = F.lower(F.concat_ws(" ", *[F.col(c) for c in columns], *[F.array_join(c, " ") for c in arrays or []]))
    return F.contains(joined, needle)
