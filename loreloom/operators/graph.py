"""Relations from registers and bounded paths over them.

Nodes are ``(node_id, type, name, code)``; edges are stored once with
``relation_id``, both ends, ``predicate``, ``doc_id``, ``block_id``, ``row_no``,
``revision`` and ``status`` and are walked both ways.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from loreloom import config
from loreloom.functions.facts import normalize_key
from loreloom.functions.text import is_blank, strip
from loreloom.operators.ordered import number_rows
from loreloom.session import by_key, cut_lineage

SEPARATOR = "\u001f"
#: Rows of a block that are dealt together.
PLACE_ROWS = 4096


def detect_roles(headers: list[str], roles: dict[str, str] | None = None) -> dict[str, str]:
    """Header -> role by the register patterns; the first matching header wins."""
    found: dict[str, str] = {}
    for role, pattern in (roles or config.COLUMN_ROLES).items():
        for header in headers:
            if re.match(pattern, header.strip()):
                found[role] = header
                break
    return found


def digest_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(SEPARATOR, *parts), 256), 1, 24))


def _node_id(node: Column) -> Column:
    return digest_id("entity_", F.col("base_id"), node["type"], node["scope"], node["key"])


def _node(cell, kind: Column, code: str, name: str, scope: Column | None, coded: bool = False) -> Column:
    """A node as struct(type, scope, key, name, code); null without a key.

    ``cell(prefix, role)`` is the value (``v``) or key (``k``) of a role.  A code is
    the key where there is one; an empty scope falls back to the one of the code.
    """
    has_code = cell("v", code) != ""
    key = cell("k", code) if coded else F.when(has_code, cell("k", code)).otherwise(cell("k", name))
    own = F.when(has_code, "base-identifier").otherwise(F.concat(F.lit("source:"), F.col("source")))
    where = own if scope is None else F.coalesce(F.nullif(scope, F.lit("")), own)
    shown = F.coalesce(F.nullif(cell("v", name), F.lit("")), cell("v", code))
    return F.when(key != "", F.struct(
        kind.alias("type"), where.alias("scope"), key.alias("key"), shown.alias("name"), cell("v", code).alias("code")))


def _register_nodes(cell, roles: set[str], table) -> dict[str, Column]:
    """The nodes that a register with these roles can name, built from the rows of ``table``."""
    nodes: dict[str, Column] = {}

    def inside(prefix: str, node: str, otherwise: Column) -> Column:
        if node not in nodes:
            return otherwise
        return F.when(nodes[node].isNotNull(), F.concat(F.lit(prefix), _node_id(nodes[node]))).otherwise(otherwise)

    organization = cell("k", "organization")
    scopes = {
        "shared": lambda code: None,
        "coded": lambda code: None,
        "organization": lambda code: F.when(organization != "", F.concat(F.lit("organization:"), organization)).otherwise("base-line"),
        "line": lambda code: inside("line:", "line", F.concat(F.lit("source:"), F.col("source"), F.lit(":organization:"), organization)),
        "event": lambda code: F.when(cell("v", code) != "", "").otherwise(
            inside("order:", "order", F.concat_ws(":", F.lit("row"), F.col("doc_id"), F.col("block_id"), F.col("row_no")))),
    }
    for node, kind, code, name, holds in table:
        if roles & ({code} if holds == "coded" else {code, name}):
            nodes[node] = _node(cell, F.lit(kind), code, name, scopes[holds](code), holds == "coded")
    return nodes


def _edge(subjects: list[str], target: str, predicate: Column) -> Column:
    """struct(s, o, p) between the first present subject and the target; null if either lacks or both are one node."""
    s, o = F.coalesce(*[F.col(n) for n in subjects]), F.col(target)
    same = F.struct(s["type"].alias("type"), s["scope"].alias("scope"), s["key"].alias("key")) == F.struct(o["type"].alias("type"), o["scope"].alias("scope"), o["key"].alias("key"))
    return F.when(s.isNotNull() & o.isNotNull() & ~same, F.struct(s.alias("s"), o.alias("o"), predicate.alias("p")))


def extract_relations(
    rows: DataFrame, roles: dict[str, str], unicode_keys: bool = True, confirmed: bool = False
) -> DataFrame:
    """Edges stated by the rows of a register.

    ``rows`` has ``base_id``, ``doc_id``, ``block_id``, ``row_no``, ``source``
    and ``fingerprint`` beside the register columns named in ``roles``.  Codes
    are shared within a base; stations live within their line, lines within their
    organisation, faults and issues without a code within their order or row.
    Everything happens within the row.  Rows are dealt by their place before
    nodes and ids make them wide: repeats of a relation lie in one place, so they
    are removed without another shuffle.
    """
    norm = normalize_key if unicode_keys else (lambda c: F.regexp_replace(F.lower(strip(c)), r"\s+", " "))

    # Cell values and their keys become columns first, so that the expressions
    # below only combine plain columns.
    provenance = ["base_id", "doc_id", "block_id", "row_no", "fingerprint", "source"]
    cells = rows.select(
        *provenance,
        *[F.coalesce(strip(F.col(h).cast("string")), F.lit("")).alias(f"v_{r}") for r, h in roles.items()],
    )
    # A large block is several places; the lines of a small one stay together.
    home = F.xxhash64("doc_id", "block_id", F.floor(F.col("row_no").try_cast("bigint") / PLACE_ROWS))
    cells = cells.select("*", home.alias("_home"))
    provenance.append("_home")
    keyed = lambda df: df.select("*", *[norm(F.col(f"v_{r}")).alias(f"k_{r}") for r in roles])
    # Spark forgets how rows are dealt where Python is called, so that comes first.
    rows = by_key(keyed(cells), "_home") if unicode_keys else keyed(by_key(cells, "_home"))
    cell = lambda prefix, role: F.col(f"{prefix}_{role}") if role in roles else F.lit("")
    nodes = _register_nodes(cell, set(roles), config.GRAPH_NODES)
    stated = {"subject_type", "object_type", "explicit_relation"} <= set(roles)
    if stated:
        told = (cell("v", "subject_type") != "") & (cell("v", "object_type") != "") & (cell("v", "explicit_relation") != "")
        for end in ("subject", "object"):
            nodes[end] = F.when(told, _node(cell, cell("v", f"{end}_type"), f"{end}_id", f"{end}_name", None))
    # A second barrier: each node is built once per row.
    rows = rows.select(
        *provenance, *([F.col("v_explicit_relation")] if stated else []), *[n.alias(f"n_{name}") for name, n in nodes.items()]
    )
    stated_edges = [
        _edge([f"n_{n}" for n in subjects if n in nodes], f"n_{target}", F.lit(predicate))
        for predicate, subjects, target in config.GRAPH_RELATIONS if target in nodes and set(subjects) & set(nodes)
    ]
    if stated:
        stated_edges.append(_edge(["n_subject"], "n_object", F.concat(F.lit("explicit:"), F.col("v_explicit_relation"))))
    c = F.col
    if not stated_edges:
        raise ValueError("the register names no roles that state a relation")
    found = rows.select(
        "base_id", "doc_id", "block_id", "row_no", "fingerprint", "_home", F.explode(F.array_compact(F.array(*stated_edges))).alias("e")
    )
    # Ids are computed after the explode, once per edge and end.
    return found.select(
        "*", _node_id(c("e.s")).alias("subject_id"), _node_id(c("e.o")).alias("object_id")
    ).select(
        digest_id(
            "relation_", c("doc_id"), c("block_id"), c("row_no").cast("string"), c("subject_id"), c("object_id"), c("e.p"), c("fingerprint")
        ).alias("relation_id"),
        "subject_id", c("e.s.type").alias("subject_type"), c("e.s.name").alias("subject_name"), c("e.s.code").alias("subject_code"),
        c("e.p").alias("predicate"),
        "object_id", c("e.o.type").alias("object_type"), c("e.o.name").alias("object_name"), c("e.o.code").alias("object_code"),
        "base_id", "doc_id", "block_id", "row_no", "fingerprint",
        F.lit("confirmed" if confirmed else "candidate").alias("status"), F.lit(1).alias("revision"), "_home",
    # The id holds the document; as a key of its own it lets a filter on documents reach the register.
    ).dropDuplicates(["_home", "relation_id", "doc_id"]).drop("_home")


def ends(edges: DataFrame) -> DataFrame:
    """Each edge once per end: ``node`` struct, ``relation_id``, ``predicate``, ``doc_id``."""
    side = lambda p: F.struct(
        F.col(f"{p}_id").alias("node_id"), F.col(f"{p}_type").alias("type"),
        F.col(f"{p}_name").alias("name"), F.col(f"{p}_code").alias("code"),
    )
    return edges.select(
        "relation_id", "predicate", "doc_id", "row_no", "status",
        F.explode(F.array(side("subject"), side("object"))).alias("node"),
    )


def entities(edges: DataFrame) -> DataFrame:
    """Nodes resolved from the given edges only, with evidence and degree counts.

    Names and counts come from visible edges, so a shared entity shows nothing of
    another document.  Hubs cost one row per task: everything combines map-side,
    first per document, so that documents are counted and not estimated.
    """
    named = F.struct("doc_id", "row_no", "node.name")
    per_document = ends(edges).groupBy(
        F.col("node.node_id").alias("node_id"), F.col("node.type").alias("type"), "doc_id"
    ).agg(F.max(named).alias("named"), F.max("node.code").alias("code"), F.count("*").alias("degree"))
    return per_document.groupBy("node_id", "type").agg(
        F.max("named")["name"].alias("name"), F.max("code").alias("code"), F.sum("degree").alias("degree"),
        F.count("*").alias("documents"),
    )


def visible_edges(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """Confirmed edges whose document is readable, retrievable and unchanged.

    ``documents`` is ``(doc_id, fingerprint)`` of what the caller may retrieve now.
    """
    return edges.filter("status = 'confirmed'").join(documents, ["doc_id", "fingerprint"], "left_semi")


def neighbourhood(
    edges: DataFrame, seeds: DataFrame, hops: int = 1, status: list[str] | None = None, types: list[str] | None = None
) -> DataFrame:
    """``(query_id, node_id, hops)``: nodes at most ``hops`` edges from the seeds, with the least distance.

    Only edges of the given ``status`` are walked and only nodes of the given
    ``types`` entered.  Each level is the distinct new nodes, so a hub is reached
    once however many paths lead to it, and reads the edges at its own nodes only.
    ``seeds`` is ``(query_id, node_id)``.
    """
    used = edges if status is None else edges.filter(F.col("status").isin(status))
    steps = adjacency(used)
    if types is not None:
        steps = steps.filter(F.col("to_type").isin(types))
    seen = seeds.select("query_id", "node_id", F.lit(0).alias("hops")).distinct()
    level = seen
    for hop in range(1, hops + 1):
        near = steps.join(level.select(F.col("node_id").alias("at")).distinct(), "at", "left_semi").select("at", "to").distinct()
        reached = level.join(near, F.col("node_id") == F.col("at")).select("query_id", F.col("to").alias("node_id")).distinct()
        level = cut_lineage(reached.join(seen, ["query_id", "node_id"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(level)
    return seen


def relations_of(edges: DataFrame, doc_id: str | None = None, node_id: str | None = None) -> DataFrame:
    wanted = edges
    if doc_id is not None:
        wanted = wanted.filter(F.col("doc_id") == doc_id)
    if node_id is not None:
        wanted = wanted.filter((F.col("subject_id") == node_id) | (F.col("object_id") == node_id))
    return wanted


def type_rollup(edges: DataFrame) -> DataFrame:
    """Links between node types: edge count and the distinct predicates."""
    return edges.groupBy("subject_type", "object_type").agg(
        F.count("*").alias("links"), F.array_sort(F.collect_set("predicate")).alias("predicates")
    )


def construction_progress(documents: DataFrame, edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Phase of each document on its way into the graph.

    ``documents`` has ``doc_id``, ``status``, ``fingerprint`` and ``chunk_count``;
    ``objects`` counts extracted entities, ``(doc_id, entity_count)``.
    """
    live = documents.select("doc_id", F.col("fingerprint").alias("_now"))
    # Counted before the join: a document of many relations is a few rows there, not all in one task.
    counted = edges.filter("status <> 'rejected'").groupBy("doc_id", "fingerprint", "status").agg(F.count("*").alias("n"))
    per_doc = (
        counted.join(live, "doc_id", "left")
        .withColumn("_stale", ~F.coalesce(F.col("fingerprint") == F.col("_now"), F.lit(False)))
        .groupBy("doc_id").agg(*_progress_counts())
    )
    joined = documents.join(per_doc, "doc_id", "left").join(objects, "doc_id", "left").fillna(
        0, ["relations", "candidates", "stale", "entity_count"]
    )
    phase = (
        F.when(F.col("status").isin("queued", "processing"), "parsing")
        .when(F.col("status") == "failed", "parse_failed")
        .when(F.col("chunk_count") == 0, "awaiting_parse")
        .when(F.col("stale") > 0, "source_changed")
        .when(F.col("candidates") > 0, "awaiting_review")
        .when(F.col("relations") > 0, "connected")
        .when(F.col("entity_count") > 0, "objects_found")
        .otherwise("awaiting_extraction")
    )
    return joined.select("doc_id", phase.alias("phase"), "relations", "candidates", "stale", "entity_count")


def progress_detail(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """``(doc_id, subject_type, predicate, object_type, relations, candidates, stale)`` of edges not rejected.

    ``documents`` is ``(doc_id, fingerprint)`` of today.
    """
    live = documents.select("doc_id", F.col("fingerprint").alias("_now"))
    stale = ~F.coalesce(F.col("fingerprint") == F.col("_now"), F.lit(False))
    kind = ["doc_id", "subject_type", "predicate", "object_type"]
    counted = edges.filter("status <> 'rejected'").groupBy(*kind, "fingerprint", "status").agg(F.count("*").alias("n"))
    return counted.join(live, "doc_id", "left").withColumn("_stale", stale).groupBy(*kind).agg(*_progress_counts())


def _progress_counts() -> list[Column]:
    """Relations, candidates and stale ones from ``n`` equal edges a row."""
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return [
        total(~F.col("_stale")).alias("relations"),
        total(~F.col("_stale") & (F.col("status") == "candidate")).alias("candidates"),
        total(F.col("_stale")).alias("stale"),
    ]


# --- seeds and paths ----------------------------------------------------------

_GRAM = 3


def _grams(col: Column, size: int = _GRAM) -> Column:
    sizes = F.sequence(F.lit(2), F.least(F.greatest(F.length(col), F.lit(2)), F.lit(size)))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(col) - n + 1, F.lit(1))), lambda i: F.substring(col, i, n)
    ))))


def _mentions(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, node_id)`` where the query names the term.

    A code must stand between other characters, so it equals a whole run of code
    characters of the query: an equi-join.  Other names meet the query on their
    first characters and are then compared.
    """
    is_code = F.col("term").rlike(r"^[a-z0-9_.-]+$")
    usable = terms.filter(F.length("term") >= 2)
    runs = queries.select(
        "query_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([a-z0-9_.-]+)"), F.lit(1)))).alias("term")
    )
    by_code = runs.join(usable.filter(is_code), "term").select("query_id", "node_id")
    names = usable.filter(~is_code)
    parts = queries.filter(F.length("text") >= 2).select("query_id", "text", F.explode(_grams(F.col("text"))).alias("gram"))
    inside = (
        parts.join(names.withColumn("gram", F.substring("term", 1, _GRAM)), "gram")
        .filter(F.contains("text", "term")).select("query_id", "node_id")
    )
    # The other way round: a short query that is part of a longer name.
    whole = queries.filter(F.length("text") >= 2).withColumn("gram", F.substring("text", 1, _GRAM))
    # Only names at least as long as the shortest query can hold one.
    shortest = queries.select(F.coalesce(F.min(F.length("text")), F.lit(0))).scalar()
    around = (
        names.filter(F.length("term") >= shortest).select("node_id", "term", F.explode(_grams(F.col("term"))).alias("gram"))
        .join(whole, "gram").filter(F.contains("term", "text")).select("query_id", "node_id")
    )
    return by_code.unionByName(inside).unionByName(around).distinct()


def match_seeds(nodes: DataFrame, queries: DataFrame, unicode_keys: bool = True) -> DataFrame:
    """Nodes named in each query: by code where any code matches, else by name."""
    norm = normalize_key if unicode_keys else (lambda c: F.regexp_replace(F.lower(strip(c)), r"\s+", " "))
    asked = queries.select("query_id", norm(F.col("query")).alias("text"))
    # Codes and names are matched in several ways; the nodes are resolved once.
    nodes = cut_lineage(nodes.select("node_id", "code", "name"))
    codes = nodes.filter(~is_blank(F.col("code"))).select("node_id", norm(F.col("code")).alias("term"))
    names = nodes.select("node_id", norm(F.col("name")).alias("term"))
    explicit = _mentions(asked, codes)
    named = _mentions(asked, names).join(explicit.select("query_id").distinct(), "query_id", "left_anti")
    return explicit.unionByName(named)


def target_types(query: Column) -> Column:
    """Node types a question asks for, in priority order."""
    return F.array_compact(F.array(*[F.when(query.rlike(p), F.lit(t)) for t, p in config.TARGET_TYPES]))


def adjacency(edges: DataFrame) -> DataFrame:
    """Edges walkable both ways: ``at`` -> ``to``."""
    step = lambda a, b: F.struct(
        F.col(f"{a}_id").alias("at"), F.col(f"{b}_id").alias("to"),
        F.col(f"{b}_type").alias("to_type"), F.col(f"{b}_name").alias("to_name"),
    )
    return edges.select(
        F.explode(F.array(step("subject", "object"), step("object", "subject"))).alias("s"), "relation_id", "revision", "doc_id", "block_id",
    ).select("s.*", "relation_id", "revision", "doc_id", "block_id")


def simple_paths(
    edges: DataFrame, seeds: DataFrame, hops: int = config.GRAPH_MAX_HOPS, ends: Callable[[DataFrame], DataFrame] | None = None,
    judge: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All paths of 1..``hops`` edges from the seeds without a repeated node.

    ``seeds`` is ``(query_id, node_id)``.  Chains of nodes are found first, parallel
    edges taken as one step, so a chain is stored once however many paths run along
    it.  The edges are then joined from the last step back to the first, and paths
    are neither stored nor shuffled after that.  With ``ends`` only paths to some nodes
    are listed: it is given the distinct ``(query_id, node_id, name)`` that chains end
    at and returns those wanted.  With ``judge`` (:func:`live_steps`,
    :func:`cited_steps`) the edges of a path have a verdict ``ok``: it is given each
    step of a query once, ``(query_id, at, to, ...)`` with its edge, however many
    paths run along it, and returns it with ``ok``.
    """
    every = adjacency(edges)
    # Read by every level and every chain.
    steps = cut_lineage(every.select("at", "to").distinct(), "steps")
    level = seeds.select("query_id", F.array("node_id").alias("node_ids"), F.col("node_id").alias("at"))
    chains = []
    for _ in range(hops):
        level = cut_lineage(
            level.join(steps, "at")
            .filter(~F.array_contains("node_ids", F.col("to")))
            .select("query_id", F.array_append("node_ids", F.col("to")).alias("node_ids"), F.col("to").alias("at")),
            "chains",
        )
        chains.append(level)
    if ends is not None:
        reached = reduce(lambda a, b: a.unionByName(b), chains).select("query_id", F.col("at").alias("node_id")).distinct()
        names = every.select(F.col("to").alias("node_id"), F.col("to_name").alias("name")).distinct()
        wanted = cut_lineage(ends(reached.join(names, "node_id")).select("query_id", F.col("node_id").alias("at")).distinct(), "ends")
        chains = [c.join(wanted, ["query_id", "at"], "left_semi") for c in chains]
    edge = [F.col("relation_id"), F.col("revision"), F.col("doc_id").cast("string").alias("doc_id"), F.col("block_id").cast("string").alias("block_id")]
    if judge is not None:
        # Every part of a chain is a chain of its own, so the last steps of all are all steps.
        walked = reduce(lambda a, b: a.unionByName(b), [
            c.select("query_id", F.get("node_ids", F.size("node_ids") - 2).alias("at"), F.col("at").alias("to")) for c in chains]).distinct()
        every = cut_lineage(judge(walked.join(every, ["at", "to"])), "steps")
        edge.append(F.col("ok"))
    return reduce(lambda a, b: a.unionByName(b), [_along(c, every, F.struct(*edge), hop + 1) for hop, c in enumerate(chains)])


def _along(chains: DataFrame, steps: DataFrame, edge: Column, hops: int) -> DataFrame:
    """The paths along chains of ``hops`` steps: one for every choice of an edge for each step, of those of the query where steps have one."""
    paths, judged = chains, "query_id" in steps.columns
    for i in reversed(range(hops)):
        parts = steps.select(
            F.col("at").alias("_at"), F.col("to").alias("_to"), F.col("to_name").alias(f"_name{i}"),
            F.col("to_type").alias(f"_type{i}"), edge.alias(f"_edge{i}"), *[F.col("query_id").alias("_query")] * judged)
        met = (F.get("node_ids", F.lit(i)) == F.col("_at")) & (F.get("node_ids", F.lit(i + 1)) == F.col("_to"))
        paths = paths.join(parts, met & F.col("query_id").eqNullSafe(F.col("_query")) if judged else met).drop("_at", "_to", "_query")
    edge_ids = [F.concat_ws(":", F.col(f"_edge{i}.relation_id"), F.col(f"_edge{i}.revision").cast("string")) for i in range(hops)]
    return paths.select(
        "query_id", digest_id("path_", F.array_join("node_ids", "|"), F.concat_ws("|", *edge_ids)).alias("path_id"),
        F.lit(hops).alias("hops"), "node_ids", F.array(*[F.col(f"_name{i}") for i in range(hops)]).alias("names"),
        F.array(*[F.col(f"_edge{i}") for i in range(hops)]).alias("path"), F.col(f"_type{hops - 1}").alias("end_type"),
    )


def count_paths(edges: DataFrame, seeds: DataFrame, hops: int = config.GRAPH_MAX_HOPS) -> DataFrame:
    """Paths of :func:`simple_paths` counted per query, length and end type, without listing them.

    Parallel edges between two nodes are one step with a count; counts multiply
    along a path.  Each level reads the edges at its own nodes only, and chains
    carry nodes, not edges.  ``paths`` is the sum, ``ends`` the number of end nodes,
    ``first_path`` the path with the first nodes and edges, whose edges are looked up
    at the end.
    """
    every = adjacency(edges)
    kind = ["query_id", "hops", "end_type"]
    level = seeds.select("query_id", F.array("node_id").alias("node_ids"), F.col("node_id").alias("at"), F.lit(1).cast("long").alias("n"))
    levels = []
    for hop in range(hops):
        steps = every.join(level.select("at").distinct(), "at", "left_semi").groupBy("at", "to", "to_type").agg(F.count("*").alias("edges"))
        level = level.join(steps, "at").filter(~F.array_contains("node_ids", F.col("to"))).select(
            "query_id", F.lit(hop + 1).alias("hops"), F.col("to_type").alias("end_type"),
            F.array_append("node_ids", F.col("to")).alias("node_ids"), F.col("to").alias("at"), (F.col("n") * F.col("edges")).alias("n"),
        )
        if hop < hops - 1:
            level = cut_lineage(level, "chains")
        levels.append(level.groupBy(*kind, "at").agg(F.sum("n").alias("n"), F.min("node_ids").alias("first")))
    found = cut_lineage(reduce(lambda a, b: a.unionByName(b), levels).groupBy(*kind).agg(
        F.sum("n").alias("paths"), F.count("*").alias("ends"), F.min("first").alias("first")).withColumn("_no", F.monotonically_increasing_id()), "counts")
    # A row has ``hops`` steps; of the last one only edges of the end type count.
    walked = found.select("_no", "end_type", "hops", "first", F.explode(F.sequence(F.lit(0), F.col("hops") - 1)).alias("_i")).select(
        "_no", "end_type", "_i", F.get("first", F.col("_i")).alias("at"), F.get("first", F.col("_i") + 1).alias("to"), (F.col("_i") == F.col("hops") - 1).alias("_last"))
    edge = F.struct("relation_id", F.col("revision").cast("string").alias("revision"))
    chosen = walked.join(every, ["at", "to"]).filter(~F.col("_last") | F.col("to_type").eqNullSafe(F.col("end_type"))).groupBy("_no", "_i").agg(
        F.min(edge).alias("_edge"))
    path = chosen.groupBy("_no").agg(F.array_sort(F.collect_list(F.struct("_i", "_edge"))).alias("_path"))
    edge_ids = F.transform("_path", lambda e: F.concat_ws(":", e["_edge"]["relation_id"], e["_edge"]["revision"]))
    path_id = digest_id("path_", F.array_join("first", "|"), F.array_join(edge_ids, "|"))
    return found.join(path, "_no").select("query_id", "hops", "end_type", "paths", "ends", path_id.alias("first_path"))


def rank_paths(paths: DataFrame, queries: DataFrame, keep: int | None = None) -> DataFrame:
    """Paths per query in order: asked-for end types first, by their priority, then short ones.

    With ``keep`` only the first ones of each query: tasks hold that many and sort
    nothing.  Without it all are numbered in buckets of their ids.
    """
    asked = queries.select("query_id", target_types(F.col("query")).alias("targets"))
    place = F.array_position("targets", F.col("end_type"))
    key = F.when(place > 0, place).otherwise(F.lit(1_000))
    keyed = paths.join(asked, "query_id").withColumn("_key", key.cast("int")).drop("targets")
    order = ["_key", "hops", "path_id"]
    if keep is None:
        bucket = F.struct("_key", "hops", F.substring("path_id", 1, len("path_") + 3))
        return number_rows(keyed, ["query_id"], [F.col(c) for c in order], bucket, "rank").withColumn("rank", F.col("rank").cast("int")).drop("_key")
    others = [c for c in paths.columns if c not in ("query_id", *order)]
    first = InternalFunction.collect_top_k(F.struct(*order, *others), keep, True)
    ranked = keyed.groupBy("query_id").agg(first.alias("_first")).select("query_id", F.posexplode("_first").alias("_place", "_path"))
    return ranked.select(*[F.col(c) if c == "query_id" else F.col(f"_path.{c}") for c in paths.columns], (F.col("_place") + 1).alias("rank"))


def select_paths(
    ranked: DataFrame, max_paths: int | None = None, max_nodes: int | None = None, max_edges: int | None = None,
) -> DataFrame:
    """Ranked paths that fit the given budgets together; others are skipped.

    ``truncated`` tells whether any of the query's ranked paths was.
    """
    folded = _folded(ranked, None, max_paths, max_nodes, max_edges)
    taken = folded.select("query_id", (F.size("taken") < F.col("read")).alias("truncated"), F.explode("taken").alias("t"))
    return ranked.join(taken.select("query_id", F.col("t.rank").alias("rank"), "truncated"), ["query_id", "rank"])


def _edge_ids(path: str) -> Column:
    return F.transform(path, lambda e: e["relation_id"])


def _fits(nodes: Column, edges: Column, max_nodes: int | None, max_edges: int | None) -> Column:
    none = 2**31 - 1
    return (F.size(nodes) <= (none if max_nodes is None else max_nodes)) & (F.size(edges) <= (none if max_edges is None else max_edges))


def _folded(
    ranked: DataFrame, state: DataFrame | None, max_paths: int | None, max_nodes: int | None, max_edges: int | None,
) -> DataFrame:
    """``(query_id, nodes, edges, taken, read, last)`` after the ranked paths have been offered in order.

    ``state`` is what an earlier call returned for the paths before them, whose
    queries it returns; ``read`` counts the paths offered, ``last`` is the last rank.
    """
    unit = F.struct("rank", "path_id", "node_ids", _edge_ids("path").alias("edge_ids"))
    grouped = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(unit)).alias("units"))
    empty = {"nodes": "array<string>", "edges": "array<string>", "taken": "array<struct<rank:int,path_id:string>>"}
    if state is None:
        start = F.struct(*[F.array().cast(kind).alias(name) for name, kind in empty.items()])
        before, rank = F.lit(0), F.lit(0)
    else:
        grouped = state.join(grouped, "query_id", "left")
        start, before, rank = F.struct(*empty), F.col("read"), F.col("last")

    def step(acc: Column, p: Column) -> Column:
        nodes = F.array_union(acc["nodes"], p["node_ids"])
        edges = F.array_union(acc["edges"], p["edge_ids"])
        fits = _fits(nodes, edges, max_nodes, max_edges)
        if max_paths is not None:
            fits = (F.size(acc["taken"]) < max_paths) & fits
        return F.when(fits, F.struct(
            nodes.alias("nodes"), edges.alias("edges"),
            F.array_append(acc["taken"], F.struct(p["rank"].alias("rank"), p["path_id"].alias("path_id"))).alias("taken"),
        )).otherwise(acc)

    units = F.coalesce("units", F.array())
    return grouped.select(
        "query_id", F.aggregate(units, start, step).alias("_acc"), (before + F.size(units)).alias("read"),
        F.coalesce(F.get(units, F.size(units) - 1)["rank"], rank).alias("last"),
    ).select("query_id", "_acc.*", "read", "last")


def rank_and_select(
    paths: DataFrame, queries: DataFrame, max_paths: int | None = None, max_nodes: int | None = None, max_edges: int | None = None,
    portion: int = 1000,
) -> DataFrame:
    """:func:`select_paths` from all paths of each query in the order of :func:`rank_paths`.

    Paths are offered in portions.  What does not fit now never will, as the chosen
    nodes and edges only grow, so a next portion is the first of the paths that still
    fit; most queries end with the first one, and then nothing else is ranked.
    """
    budgets = (max_paths, max_nodes, max_edges)
    if budgets == (None, None, None):
        return rank_paths(paths, queries).withColumn("truncated", F.lit(False))
    # One more than can be taken shows whether any is left.
    portion = max(portion, (max_paths or 0) + 1)
    offered = cut_lineage(rank_paths(paths, queries, portion), "ranked")
    state = cut_lineage(_folded(offered, None, *budgets), "chosen")
    open_ = F.col("read") == portion
    if max_paths is not None:
        open_ &= F.size("taken") < max_paths
    ended = state.filter(~open_).withColumn("truncated", F.size("taken") < F.col("read"))
    state = cut_lineage(state.filter(open_), "chosen")
    if not state.isEmpty():
        rest = rank_paths(paths.join(state.select("query_id"), "query_id", "left_semi"), queries)
        totals = rest.groupBy("query_id").agg(F.count("*").alias("_all"))

        def fitting(later: DataFrame) -> DataFrame:
            now = state.select("query_id", "nodes", "edges", "last")
            fits = _fits(F.array_union("nodes", "node_ids"), F.array_union("edges", _edge_ids("path")), max_nodes, max_edges)
            return later.join(now, "query_id").filter((F.col("rank") > F.col("last")) & fits).select(later.columns)

        rest = cut_lineage(fitting(rest), "rest")
        offered = offered.unionByName(rest)
        order = W.partitionBy("query_id").orderBy("rank")
        going = rest
        while not going.isEmpty():
            following = going.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= portion).drop("_place")
            state = cut_lineage(_folded(following, state, *budgets), "chosen")
            going = fitting(rest)
            if max_paths is not None:
                going = going.join(state.filter(F.size("taken") < max_paths).select("query_id"), "query_id", "left_semi")
        ended = ended.unionByName(state.join(totals, "query_id").withColumn("truncated", F.size("taken") < F.col("_all")).drop("_all"))
    taken = ended.select("query_id", "truncated", F.explode("taken").alias("t"))
    return offered.join(taken.select("query_id", F.col("t.rank").alias("rank"), "truncated"), ["query_id", "rank"])


def edges_in_document(edges: DataFrame, doc_id: Column) -> DataFrame:
    """The edges whose evidence lies in the document: paths over them stay inside it, so others are never built."""
    return edges.filter(F.col("doc_id") == doc_id)


def paths_within_document(paths: DataFrame, doc_id: Column) -> DataFrame:
    return paths.filter(F.forall("path", lambda e: e["doc_id"] == doc_id))


def live_steps(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Steps with ``ok``: the live edges have the step's edge, in the same revision and document, between its two nodes."""
    live = edges.groupBy(F.col("relation_id").alias("_id")).agg(F.collect_set(F.struct(
        F.col("revision").alias("rev"), F.col("doc_id").cast("string").alias("doc"), F.col("block_id").cast("string").alias("block"),
        F.array("subject_id", "object_id").alias("ends"))).alias("_live"))
    holds = lambda e: F.coalesce(
        (e["rev"] == F.col("revision")) & (e["doc"] == F.col("doc_id").cast("string")) & (e["block"] == F.col("block_id").cast("string"))
        & F.array_contains(e["ends"], F.col("at")) & F.array_contains(e["ends"], F.col("to")), F.lit(False))
    return steps.join(live, F.col("relation_id") == F.col("_id"), "left").withColumn(
        "ok", F.col("_live").isNotNull() & F.forall("_live", holds)).drop("_id", "_live")


def cited_steps(steps: DataFrame, citations: DataFrame) -> DataFrame:
    """Steps with ``ok``: their query cites the block of their edge. ``citations`` is ``(query_id, doc_id, block_id)``."""
    return _with_cited(
        steps.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("block_id", F.col("block_id").cast("string")), citations, "ok")


def _with_cited(blocks: DataFrame, citations: DataFrame, name: str) -> DataFrame:
    cited = citations.select(
        "query_id", F.col("doc_id").cast("string").alias("doc_id"), F.col("block_id").cast("string").alias("block_id")
    ).distinct().withColumn("_cited", F.lit(True))
    return blocks.join(cited, ["query_id", "doc_id", "block_id"], "left").withColumn(name, F.coalesce("_cited", F.lit(False))).drop("_cited")


def _judged(paths: DataFrame) -> bool:
    return "ok" in paths.schema["path"].dataType.elementType.names


def _all_ok(name: str) -> Column:
    return F.forall("path", lambda e: e["ok"]).alias(name)


def validate_paths(paths: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Stored paths against the live edges: same revision and document, and the chain still holds.

    Paths whose steps were judged by :func:`live_steps` as they were listed carry the
    answer: each is a row with its ``query_id``, and no edge is looked up again.
    """
    if _judged(paths):
        return paths.select("query_id", "path_id", _all_ok("valid"))
    walked = paths.select("path_id", "node_ids", F.posexplode("path").alias("i", "e"))
    live = edges.select(
        F.col("relation_id").alias("_id"), F.col("revision").alias("_rev"),
        F.col("doc_id").cast("string").alias("_doc"), F.col("block_id").cast("string").alias("_block"),
        F.array("subject_id", "object_id").alias("_ends"),
    )
    here, there = F.get("node_ids", F.col("i")), F.get("node_ids", F.col("i") + 1)
    holds = (
        F.col("_id").isNotNull() & (F.col("_rev") == F.col("e.revision")) & (F.col("_doc") == F.col("e.doc_id"))
        & (F.col("_block") == F.col("e.block_id"))
        & F.array_contains("_ends", here) & F.array_contains("_ends", there)
    )
    return (
        walked.join(live, F.col("e.relation_id") == F.col("_id"), "left")
        .groupBy("path_id")
        .agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("valid"))
    )


def fully_cited(paths: DataFrame, citations: DataFrame | None = None) -> DataFrame:
    """Whether each path has a cited block for every edge.

    ``citations`` is ``(query_id, doc_id, block_id)``; paths whose steps were judged by
    :func:`cited_steps` as they were listed need none.
    """
    if _judged(paths):
        return paths.select("query_id", "path_id", _all_ok("complete"))
    walked = paths.select("query_id", "path_id", F.explode("path").alias("e")).select(
        "query_id", "path_id", F.col("e.doc_id").alias("doc_id"), F.col("e.block_id").alias("block_id")
    )
    return _with_cited(walked, citations, "cited").groupBy("query_id", "path_id").agg(F.bool_and("cited").alias("complete"))


def named_ends(ends: DataFrame, answers: DataFrame) -> DataFrame:
    """Of ``(query_id, node_id, name)`` the nodes that the query's answer names."""
    from loreloom.functions.text import mentions_code

    return ends.join(answers.select("query_id", "answer"), "query_id").filter(mentions_code(F.col("answer"), F.col("name"))).drop("answer")


def answer_consistency(paths: DataFrame, cited: DataFrame, answers: DataFrame) -> DataFrame:
    """Per endpoint pair named in an answer: is some path between them fully cited?

    ``answers`` is ``(query_id, question, answer)``; ``paths`` has ``first_name``
    and ``last_name`` of its ends.
    """
    from loreloom.functions.text import mentions_code

    named = (
        paths.join(answers, "query_id")
        .filter(
            (mentions_code(F.col("answer"), F.col("first_name")) | mentions_code(F.col("question"), F.col("first_name")))
            & mentions_code(F.col("answer"), F.col("last_name"))
        )
        .join(cited, ["query_id", "path_id"], "left")
    )
    return named.groupBy("query_id", "first_name", "last_name").agg(
        F.bool_or(F.coalesce("complete", F.lit(False))).alias("supported")
    )
