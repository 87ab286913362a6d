"""States and checks that follow documents around: trash, scope, currency, transitions, evidence of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom import config
from loreloom.functions import text as tx
from loreloom.operators import access, answers, graph, neardup, ordered, retrieval, selection, tables, vectors, versions
from loreloom.operators.tables import Filter, TableQuery
from loreloom.plans.graph import EDGES, PATHS, edges, line_edges, line_questions
from loreloom.plans.lifecycle import CATALOG, catalog
from loreloom.plans.registry import Tables, query
from loreloom.session import cut_lineage
from loreloom.sources import files


@query(
    "trash_listing",
    f"""WITH {CATALOG}, a AS (SELECT user_id AS doc_id, CASE event_type WHEN 'error' THEN 'trash' ELSE 'restore' END AS action, ts AS moment FROM events WHERE event_type IN ('error', 'view')),
    l AS (SELECT doc_id, max({{'moment': moment, 'action': action}}) AS last FROM a GROUP BY doc_id)
    SELECT doc_id, base_id, CASE WHEN last.action = 'trash' THEN last.moment WHEN last IS NULL THEN deleted_at END AS deleted_at FROM docs LEFT JOIN l USING (doc_id)
    WHERE last.action = 'trash' OR (last IS NULL AND deleted_at IS NOT NULL)""",
)
def trash_listing(t: Tables):
    """What lies in the trash after all trash and restore actions."""
    kind = F.col("event_type")
    actions = t.events.filter(kind.isin("error", "view")).select(
        F.col("user_id").alias("doc_id"), F.when(kind == "error", "trash").otherwise("restore").alias("action"), F.col("ts").cast("timestamp").alias("at"))
    now = access.trash_state(catalog(t), actions)
    return now.filter("deleted_at IS NOT NULL").select("doc_id", "base_id", "deleted_at")


@query(
    "scoped_documents",
    f"""WITH {CATALOG} SELECT base_id, count(*) AS documents, count(*) FILTER (doc_id = 30) AS pinned FROM docs WHERE base_id = 'src10' GROUP BY base_id""",
)
def scoped_documents(t: Tables):
    """Documents of one base, and the one of them a scope pins."""
    pinned = access.within_scope("src10", 30)
    return catalog(t).filter(access.within_scope("src10")).groupBy("base_id").agg(
        F.count("*").alias("documents"), F.count_if(pinned).alias("pinned"))


@query(
    "replaced_chunks",
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    f AS (SELECT doc_id FROM labels WHERE quality = 0)
    SELECT doc_id, n::INT AS n, md5(line) AS line_md5 FROM p WHERE doc_id NOT IN (SELECT doc_id FROM f)
    UNION ALL SELECT doc_id, n::INT, md5(reverse(line)) FROM p WHERE doc_id IN (SELECT doc_id FROM f) AND n = 1""",
)
def replaced_chunks(t: Tables):
    """All lines of a document as its rows; those of poor documents are replaced by one."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select(
        "doc_id", (F.col("p") + 1).alias("n"), "line")
    poor = t.labels.filter("quality = 0").select("doc_id")
    fresh = lines.filter("n = 1").join(poor, "doc_id", "left_semi").withColumn("line", F.reverse("line"))
    done = versions.replace_rows(lines.withColumn("line_md5", F.md5("line")), fresh.withColumn("line_md5", F.md5("line")), "doc_id", fresh)
    return done.select("doc_id", "n", "line_md5")


@query(
    "learning_currency",
    """WITH s AS (SELECT l.doc_id % 50 AS learned_id, d.doc_id, 1 AS version, CASE WHEN quality = 1 THEN md5(text) ELSE 'old' END AS fingerprint FROM labels l JOIN documents d USING (doc_id)),
    live AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 2 ELSE 1 END AS v, md5(text) AS f FROM documents WHERE lang <> 'es')
    SELECT learned_id, bool_and(coalesce(version = v AND fingerprint = f, false)) AS current, count(*) FILTER (NOT coalesce(version = v AND fingerprint = f, false)) AS changed_sources
    FROM s LEFT JOIN live USING (doc_id) GROUP BY learned_id""",
)
def learning_currency(t: Tables):
    """Learned documents against their sources: one language was revised, one withdrawn, some were never in sync."""
    print_ = F.md5("text")
    snapshots = t.labels.join(t.documents, "doc_id").select(
        (F.col("doc_id") % 50).alias("learned_id"), "doc_id", F.lit(1).alias("version"), F.when(F.col("quality") == 1, print_).otherwise("old").alias("fingerprint"))
    live = t.documents.filter("lang <> 'es'").select("doc_id", F.when(F.col("lang") == "fr", 2).otherwise(1).alias("version"), print_.alias("fingerprint"))
    return access.learning_current(snapshots, live)


def _transition_sql() -> str:
    """All five tables at once; an event type means another action in each of them."""
    rules = ", ".join(f"('{kind}', '{s}', '{a}', '{to}')" for kind, table in config.TRANSITIONS.items() for (s, a), to in table.items())
    starts = ", ".join(f"('{kind}', '{STARTS[kind]}')" for kind in config.TRANSITIONS)
    acts = ", ".join(f"('{kind}', '{event}', '{a}')" for kind, events in ACTIONS.items() for event, a in events.items())
    return f"""WITH RECURSIVE rules(kind, s, a, nx) AS (VALUES {rules}), starts(kind, s0) AS (VALUES {starts}), acts(kind, event_type, a) AS (VALUES {acts}),
    e AS (SELECT kind, user_id, event_id, a, row_number() OVER (PARTITION BY kind, user_id ORDER BY ts, event_id) AS k FROM events JOIN acts USING (event_type)),
    w AS (SELECT e.kind, user_id, event_id, k, s0 AS f, coalesce(nx, s0) AS t, nx IS NOT NULL AS ok FROM e JOIN starts USING (kind) LEFT JOIN rules r ON r.kind = e.kind AND r.s = s0 AND r.a = e.a WHERE k = 1
      UNION ALL SELECT e.kind, e.user_id, e.event_id, e.k, w.t, coalesce(nx, w.t), nx IS NOT NULL
      FROM w JOIN e ON e.kind = w.kind AND e.user_id = w.user_id AND e.k = w.k + 1 LEFT JOIN rules r ON r.kind = e.kind AND r.s = w.t AND r.a = e.a)
    SELECT kind, user_id, event_id, f AS from_state, t AS to_state, ok AS accepted FROM w"""


STARTS = {"document": "review", "card": "draft", "demand": "pending_confirm", "case": "open", "issue": "open"}
ACTIONS = {
    "document": {"signup": "publish", "purchase": "archive", "error": "reject", "view": "restore", "click": "retry"},
    "card": {"signup": "submit", "purchase": "publish", "error": "disable", "view": "reopen", "click": "recheck"},
    "demand": {"signup": "assign", "purchase": "submit_review", "error": "return", "view": "confirm", "click": "start"},
    "case": {"signup": "start", "purchase": "verify", "error": "dismiss", "view": "reopen", "click": "start"},
    "issue": {"signup": "start", "purchase": "resolve", "error": "dismiss", "view": "reopen", "click": "start"},
}


@query("business_transitions", _transition_sql())
def business_transitions(t: Tables):
    """The events of each user replayed through the tables of documents, cards, demands, cases and issues."""
    done = None
    for kind, rules in config.TRANSITIONS.items():
        action = F.element_at(F.create_map(*[F.lit(x) for pair in ACTIONS[kind].items() for x in pair]), F.col("event_type"))
        acted = t.events.select("user_id", "event_id", "ts", action.alias("act"))
        part = ordered.replay(
            acted, "user_id", ["ts", "event_id"], "act", F.date_trunc("second", "ts"), F.date_trunc("hour", "ts"), rules, STARTS[kind]
        ).select(F.lit(kind).alias("kind"), "user_id", "event_id", "from_state", "to_state", "accepted")
        done = part if done is None else done.unionByName(part)
    return done


@query(
    "near_vectors",
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def near_vectors(t: Tables):
    """The cosine of each vector and the next one."""
    left = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x"))
    right = t.embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return left.join(right, "a").select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(
    "common_phrases",
    """WITH p AS (SELECT p_partkey, p_brand, ['设备检修', '线路故障处理', '票务'][p_size % 3 + 1] AS title, ['线路故障', '检修规程', '设备检修记录', '客流'][p_partkey % 4 + 1] AS q FROM part)
    SELECT p_partkey, coalesce(max(n), 0)::INT AS phrase FROM p LEFT JOIN (SELECT p_partkey AS k, i, n FROM p, range(1, 7) a(i), range(1, 7) b(n)) x
      ON k = p_partkey AND i + n - 1 <= length(title) AND contains(q, substr(title, i, n)) GROUP BY p_partkey""",
)
def common_phrases(t: Tables):
    title = F.element_at(F.array(*[F.lit(x) for x in ("设备检修", "线路故障处理", "票务")]), F.col("p_size") % 3 + 1)
    asked = F.element_at(F.array(*[F.lit(x) for x in ("线路故障", "检修规程", "设备检修记录", "客流")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", tx.common_phrase_length(asked, title).alias("phrase"))


@query(
    "text_dates",
    """SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-08-15' AND o_orderdate >= TIMESTAMP '1996-04-01'""",
)
def text_dates(t: Tables):
    """Dates kept as text are compared as dates."""
    rows = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    q = TableQuery(filters=[Filter("day", "between", ["1996-03-01", "1996-08-15"]), Filter("day", "gte", "1996-04-01")], select=["o_orderkey"], limit=None)
    return tables.query_table(rows, q)


@query(
    "source_types",
    """WITH p AS (SELECT p_partkey, p_name || ['.csv', '.PDF', '.mp4', '.webp', '.md', ''][(p_partkey % 6 + 1)::INT] AS path FROM part)
    SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'table' WHEN 1 THEN 'physical_pages' WHEN 2 THEN 'media' WHEN 3 THEN 'image' ELSE 'text' END AS kind FROM p""",
)
def source_types(t: Tables):
    ending = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".PDF", ".mp4", ".webp", ".md", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return t.part.select("p_partkey", files.source_type(F.concat("p_name", ending)).alias("kind"))


@query(
    "condition_texts",
    """SELECT p_partkey, '查 ' || ' ' || ' 中 ' || ' ' || ' 的数量' || (p_size % 4) AS rest FROM part""",
)
def condition_texts(t: Tables):
    """Questions without quoted titles and known titles; the condition stays."""
    question = F.concat(F.lit("查 《"), F.col("p_type"), F.lit("》 中 "), F.col("p_name"), F.lit(" 的数量"), (F.col("p_size") % 4).cast("string"))
    return t.part.select("p_partkey", tx.condition_text(question, F.array("p_name")).alias("rest"))


@query(
    "visible_relations",
    f"""WITH {EDGES} SELECT relation_id FROM edges WHERE p IN ('located_at', 'has_work_order') AND doc = 'assets'""",
)
def visible_relations(t: Tables):
    """Confirmed relations of the documents that may be read and are unchanged."""
    some = edges(t).withColumn("status", F.when(F.col("predicate").isin("located_at", "has_work_order"), "confirmed").otherwise("candidate"))
    live = some.filter("doc_id = 'assets'").select("doc_id", "fingerprint").distinct()
    return graph.visible_edges(some, live).select("relation_id")


@query(
    "relations_by_document",
    f"""WITH {EDGES} SELECT relation_id, p AS predicate FROM edges WHERE doc = 'assets' AND (s = (SELECT min(line) FROM rb) OR o = (SELECT min(line) FROM rb))""",
)
def relations_by_document(t: Tables):
    """The relations of one line in one document."""
    every = edges(t)
    line = every.filter("object_type = 'line'").agg(F.min("object_id")).scalar()
    found = every.filter((F.col("subject_id") == line) | (F.col("object_id") == line))
    return graph.relations_of(found, doc_id="assets").select("relation_id", "predicate")


@query(
    "graph_neighbourhood",
    PATHS + """, near AS (SELECT query_id, line AS node_id, 0 AS hops FROM seeds UNION ALL SELECT query_id, e, len(rels) FROM paths WHERE bt IN ('station', 'asset', 'line') AND
      len(list_filter(names, lambda x: x IS NULL)) = 0)
    SELECT query_id, node_id, min(hops)::INT AS hops FROM near GROUP BY query_id, node_id HAVING min(hops) <= 2""",
)
def graph_neighbourhood(t: Tables):
    """Stations, assets and lines within two steps of each line."""
    every = line_edges(t)
    seeds = graph.match_seeds(graph.entities(every), line_questions(t), unicode_keys=False)
    return graph.neighbourhood(every, seeds, 2, types=["station", "asset", "line"])


# Only edges of the document are walked.
PATHS_IN_DOCUMENT = PATHS.replace("doc, block FROM edges UNION ALL", "doc, block FROM edges WHERE doc = 'assets' UNION ALL").replace(
    "doc, block FROM edges),", "doc, block FROM edges WHERE doc = 'assets'),")


@query("paths_in_one_document", PATHS_IN_DOCUMENT + "SELECT query_id, path_id FROM paths")
def paths_in_one_document(t: Tables):
    every = edges(t)
    seeds = graph.match_seeds(graph.entities(every), line_questions(t), unicode_keys=False)
    return graph.simple_paths(cut_lineage(graph.edges_in_document(every, F.lit("assets"))), seeds).select("query_id", "path_id")


@query(
    "answer_consistency",
    """SELECT r_regionkey::BIGINT AS query_id, r_name AS first_name, n_name AS last_name, bool_or((s_suppkey // 100) % 2 = 0) AS supported
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 1 GROUP BY ALL""",
)
def answer_consistency(t: Tables):
    """Answers name every other station of a line; of the register's blocks only the even ones are cited.

    Paths that end at a node no answer names are of no verdict, so they are not listed.
    """
    every = edges(t)
    seeds = graph.match_seeds(graph.entities(every), line_questions(t), unicode_keys=False)
    lines = t.region.select(F.col("r_regionkey").cast("bigint").alias("query_id"), F.col("r_name").alias("first_name"))
    stations = t.nation.where("n_nationkey % 2 = 1").groupBy(F.col("n_regionkey").cast("bigint").alias("query_id")).agg(
        F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("names"))
    answers = lines.join(stations, "query_id").select(
        "query_id", F.concat(F.lit("Stations of "), F.col("first_name")).alias("question"), F.concat(F.lit("These: "), F.col("names")).alias("answer"))
    found = cut_lineage(graph.simple_paths(
        cut_lineage(graph.edges_in_document(every, F.lit("assets"))), seeds, ends=lambda ends: graph.named_ends(ends, answers)))
    ends = found.join(lines, "query_id").withColumn("last_name", F.element_at("names", -1))
    walked = found.select("query_id", F.explode("path").alias("e")).select("query_id", "e.doc_id", "e.block_id").distinct()
    complete = graph.fully_cited(found, walked.where(F.col("block_id").cast("long") % 2 == 0))
    return graph.answer_consistency(ends, complete, answers)


@query(
    "carried_issues",
    """WITH f AS (SELECT doc_id, 'issue_' || substr(sha256(to_json({'type': lang, 'col2': list_sort([doc_id::VARCHAR, (doc_id + 1)::VARCHAR]), 'col3': [md5(source)]})), 1, 32) AS issue_id FROM documents)
    SELECT doc_id, CASE WHEN quality IS NULL THEN 'open' WHEN quality = 1 THEN 'resolved' ELSE 'in_review' END AS status, coalesce(toxic + 2, 1)::INT AS revision FROM f LEFT JOIN labels USING (doc_id)""",
)
def carried_issues(t: Tables):
    """Issues found again keep the decision made on them, by their stable id."""
    found = t.documents.select("doc_id", (F.col("doc_id") + 1).alias("other"), F.col("lang").alias("type"), F.md5("source").alias("state"))
    marked = found.withColumn("issue_id", neardup.issue_id("type", "doc_id", "other", [F.col("state")]))
    # The ends in the other order give the same id.
    swapped = found.withColumn("issue_id", neardup.issue_id("type", "other", "doc_id", [F.col("state")]))
    prior = swapped.join(t.labels, "doc_id").select(
        "issue_id", F.when(F.col("quality") == 1, "resolved").otherwise("in_review").alias("status"),
        F.lit("equivalent").alias("decision"), (F.col("toxic") + 2).alias("revision"))
    return neardup.carry_decisions(marked, prior).select("doc_id", "status", "revision")


@query(
    "complete_histories",
    """SELECT user_id AS block, max(k) AS revision, min(gap) = 1 AND max(gap) = 1 OR max(k) = 1 AS complete FROM (
      SELECT user_id, k, CASE WHEN k > 1 AND event_id % 50 = 0 THEN 0 WHEN k > 1 THEN 1 END AS gap FROM (
        SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)) GROUP BY user_id""",
)
def complete_histories(t: Tables):
    """Each event revises the block of its user; the records of some revisions are lost."""
    numbered = ordered.number_rows(
        t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("hour", "ts"), "k")
    blocks = numbered.groupBy(F.col("user_id").alias("block")).agg(F.max("k").alias("revision"))
    records = numbered.filter("k > 1 AND event_id % 50 <> 0").select(
        F.col("user_id").alias("block"), F.col("k").alias("revision"), F.col("user_id").alias("source_block"), (F.col("k") - 1).alias("source_revision"))
    return versions.history_complete(blocks, records)


@query(
    "moved_headers",
    """WITH c AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders), e AS (SELECT o_custkey, max(o_orderkey) AS last FROM c WHERE o_orderkey % 7 = 0 GROUP BY o_custkey)
    SELECT o_orderkey AS chunk_id, CASE WHEN e.last IS NULL THEN 'old' ELSE 'new-' || e.last END AS header, (1 + (e.last IS NOT NULL)::INT) AS block_revision,
      CASE WHEN o_orderkey % 7 = 0 THEN 'confirmed' WHEN e.last IS NOT NULL THEN 'unreviewed' ELSE 'open' END AS review_state FROM c LEFT JOIN e USING (o_custkey)""",
)
def moved_headers(t: Tables):
    """A header edited in one chunk of a customer's table reaches the others and reopens them."""
    chunks = t.orders.select(
        F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("table_id"), F.array(F.lit("old")).alias("headers"),
        F.lit(1).alias("block_revision"), F.lit("open").alias("review_state"))
    edited = t.orders.filter("o_orderkey % 7 = 0").select(
        F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("table_id"), F.array(F.concat(F.lit("new-"), F.col("o_orderkey").cast("string"))).alias("headers"))
    done = versions.propagate_headers(chunks, edited)
    return done.select("chunk_id", F.element_at("headers", 1).alias("header"), "block_revision", "review_state")


@query(
    "used_sources",
    """SELECT conv_id, turn, len(list_filter([1, 2, 3], lambda n: n <> 2 AND contains(text || ' [' || turn || '] [2]', '[' || n || ']')))::INT AS used FROM conversations""",
)
def used_sources(t: Tables):
    """Citations marked used whose number stands in the answer."""
    answer = F.concat("text", F.lit(" ["), F.col("turn").cast("string"), F.lit("] [2]"))
    cited = F.array(*[F.struct(F.lit(n).alias("citation"), F.lit(n != 2).alias("used")) for n in (1, 2, 3)])
    return t.conversations.select("conv_id", "turn", F.size(answers.used_citations(cited, answer)).alias("used"))


@query(
    "merged_demands",
    """WITH o AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS l FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey),
    f AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS l FROM orders WHERE o_orderstatus <> 'O' GROUP BY o_custkey)
    SELECT o_custkey, array_to_string(list_sort(list_distinct(coalesce(o.l, []) || coalesce(f.l, []))), ',') AS points FROM o FULL JOIN f USING (o_custkey)""",
)
def merged_demands(t: Tables):
    """The points of two demands of a customer as one list."""
    points = lambda rows, name: rows.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias(name))
    both = points(t.orders.filter("o_orderstatus = 'O'"), "a").join(points(t.orders.filter("o_orderstatus <> 'O'"), "b"), "o_custkey", "full")
    return both.select("o_custkey", F.array_join(F.array_sort(answers.merge_demands(F.col("a"), F.col("b"))), ",").alias("points"))


@query(
    "reserved_evidence",
    """WITH RECURSIVE i AS (SELECT l_orderkey AS query_id, l_linenumber AS n, CASE WHEN l_linenumber <= 4 THEN (l_linenumber + 1) // 2 END AS grp, l_partkey::VARCHAR AS item, (l_quantity * 10)::BIGINT AS chars FROM lineitem),
    u AS (SELECT query_id, 0 AS stage, grp AS ord, list_sort(list(DISTINCT {'item': item, 'chars': chars})) AS members FROM i WHERE grp IS NOT NULL GROUP BY query_id, grp
      UNION ALL SELECT query_id, 1, n, [{'item': item, 'chars': chars}] FROM i WHERE grp IS NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, ord, members) AS k FROM u),
    w AS (SELECT DISTINCT query_id, 0::BIGINT AS k, []::VARCHAR[] AS items, 0::BIGINT AS used FROM k
      UNION ALL SELECT w.query_id, k.k, CASE WHEN ok THEN items || list_transform(fresh, lambda m: m.item) ELSE items END, CASE WHEN ok THEN used + cost ELSE used END
      FROM w JOIN k ON k.query_id = w.query_id AND k.k = w.k + 1,
        LATERAL (SELECT list_filter(k.members, lambda m: NOT list_contains(items, m.item)) AS fresh) f,
        LATERAL (SELECT coalesce(list_sum(list_transform(fresh, lambda m: m.chars)), 0)::BIGINT AS cost) c,
        LATERAL (SELECT len(items) + len(fresh) <= 5 AND used + cost <= 1200 AS ok) o)
    SELECT query_id, len(arg_max(items, k))::BIGINT AS items, arg_max(used, k) AS chars FROM w GROUP BY query_id HAVING len(arg_max(items, k)) > 0""",
)
def reserved_evidence(t: Tables):
    """Pairs of order lines enter whole or not at all, the others fill what is left."""
    n = F.col("l_linenumber")
    items = t.lineitem.select(
        F.col("l_orderkey").alias("query_id"), F.when(n <= 4, F.floor((n + 1) / 2)).alias("group_no"), n.alias("rank"),
        F.col("l_partkey").cast("string").alias("item_id"), (F.col("l_quantity") * 10).cast("long").alias("chars"))
    packed = selection.pack_with_groups(items, "query_id", 5, 1200)
    return packed.groupBy("query_id").agg(F.count("*").alias("items"), F.sum("chars").alias("chars"))


@query(
    "newest_per_document",
    """SELECT user_id AS doc_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5""",
)
def newest_per_document(t: Tables):
    """The newest five events of every document."""
    rows = t.events.select(F.col("user_id").alias("doc_id"), "event_id", "ts")
    return versions.keep_recent(rows, "doc_id", "ts", "event_id", 5, F.lit("1900-01-01").cast(dict(rows.dtypes)["ts"]))


@query(
    "absent_codes",
    """SELECT p_partkey AS query_id FROM part WHERE p_size % 2 = 1 AND NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size % 2 = 0 AND o.p_partkey % 1000 = part.p_partkey % 1000)""",
)
def absent_codes(t: Tables):
    """Questions about parts by a code that the corpus, the parts of even size, does not hold."""
    code = F.concat(F.lit("part-"), (F.col("p_partkey") % 1000).cast("string"))
    corpus = t.part.filter("p_size % 2 = 0").select(tx.tokenize(F.concat(F.lit("unit "), code)).alias("tokens"))
    asked = t.part.filter("p_size % 2 = 1").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("where is "), code).alias("query"))
    return retrieval.absent_identifiers(corpus, retrieval.analyse_queries(asked))


@query(
    "graph_progress_detail",
    f"""WITH {EDGES} SELECT doc AS doc_id, st AS subject_type, p AS predicate, ot AS object_type, count(*) FILTER (doc = 'assets') AS relations,
      count(*) FILTER (doc = 'assets' AND p <> 'located_at') AS candidates, count(*) FILTER (doc <> 'assets') AS stale
    FROM edges WHERE p <> 'follows_procedure' GROUP BY ALL""",
)
def graph_progress_detail(t: Tables):
    """Relations by type and predicate: one kind confirmed, one rejected, one document changed since."""
    status = F.when(F.col("predicate") == "located_at", "confirmed").when(F.col("predicate") == "follows_procedure", "rejected").otherwise("candidate")
    some = edges(t).withColumn("status", status)
    today = some.select("doc_id", "fingerprint").distinct().withColumn(
        "fingerprint", F.when(F.col("doc_id") == "assets", F.col("fingerprint")).otherwise("new"))
    return graph.progress_detail(some, today)


@query(
    "workspace_overview",
    f"""WITH {CATALOG}, u AS (SELECT user_id AS doc_id, count(*) AS uses, max(ts) AS last_use FROM events GROUP BY user_id)
    SELECT base_id, lang, count(*) AS documents, count(*) FILTER (status = 'published') AS published, coalesce(sum(uses), 0)::BIGINT AS uses,
      count(*) FILTER (last_use >= TIMESTAMP '2024-01-25') AS used_lately FROM docs LEFT JOIN u USING (doc_id) WHERE deleted_at IS NULL GROUP BY base_id, lang""",
)
def workspace_overview(t: Tables):
    """Documents, use and recent use per base and source language."""
    used = t.events.groupBy(F.col("user_id").alias("doc_id")).agg(F.count("*").alias("uses"), F.max("ts").alias("last_use"))
    return catalog(t).filter("deleted_at IS NULL").join(used, "doc_id", "left").groupBy("base_id", "lang").agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "published").alias("published"),
        F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"), F.count_if(F.col("last_use") >= "2024-01-25").alias("used_lately"),
    )


@query(
    "upload_actions",
    """WITH st AS (SELECT doc_id, source AS base_id, 'f' || (doc_id % 200) AS file_name, md5(text) AS hash, (doc_id % 3)::INT AS version FROM documents WHERE lang IN ('en', 'de')),
    up AS (SELECT doc_id + 1000000 AS upload_id, CASE WHEN doc_id % 5 = 0 THEN 'src3' ELSE source END AS base_id, 'f' || (doc_id % 400) AS file_name, md5(text) AS hash FROM documents),
    a AS (SELECT base_id, hash, max({'v': version, 'd': doc_id}).d AS same FROM st GROUP BY ALL), b AS (SELECT base_id, file_name, max({'v': version, 'd': doc_id}).d AS named FROM st GROUP BY ALL),
    c AS (SELECT hash, max({'v': version, 'd': doc_id}).d AS elsewhere FROM st GROUP BY ALL)
    SELECT upload_id, CASE WHEN same IS NOT NULL THEN 'skip' WHEN named IS NOT NULL THEN 'new_version' WHEN elsewhere IS NOT NULL THEN 'copy' ELSE 'import' END AS action,
      coalesce(same, named, elsewhere) AS doc_id FROM up LEFT JOIN a USING (base_id, hash) LEFT JOIN b USING (base_id, file_name) LEFT JOIN c USING (hash)""",
)
def upload_actions(t: Tables):
    """All documents uploaded to a store that holds two languages, some to another base and under other names."""
    name = lambda n: F.concat(F.lit("f"), (F.col("doc_id") % n).cast("string"))
    stored = t.documents.filter(F.col("lang").isin("en", "de")).select(
        "doc_id", F.col("source").alias("base_id"), name(200).alias("file_name"), F.md5("text").alias("hash"), (F.col("doc_id") % 3).cast("int").alias("version"))
    uploads = t.documents.select(
        (F.col("doc_id") + 1000000).alias("upload_id"), F.when(F.col("doc_id") % 5 == 0, "src3").otherwise(F.col("source")).alias("base_id"),
        name(400).alias("file_name"), F.md5("text").alias("hash"))
    return neardup.upload_actions(uploads, stored)
