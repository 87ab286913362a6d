"""Governance, answer checks, evaluation, routing and conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom import config
from loreloom.functions.text import clean_text, tokenize
from loreloom.operators import answers, chunks, conversation, governance, recommend, retrieval, usage
from loreloom.plans.lifecycle import CATALOG, as_of, catalog
from loreloom.plans.registry import Tables, query
from loreloom.plans.retrieval import BM25, benchmark_queries, chunk_corpus
from loreloom.plans.sqltext import CHUNKS
from loreloom.session import cut_lineage

NOW = "TIMESTAMP '2024-01-15'"
#: Passages below this score are no evidence in the evaluation queries.
LEAST_SCORE = 60


def governed(t: Tables) -> DataFrame:
    texts = t.documents.select("doc_id", F.contains("text", F.lit("###")).alias("odd"))
    warned = F.when(F.col("odd"), F.array(F.lit("odd marks"), F.lit(config.NOTE_MESSAGES[0]))).otherwise(F.array().cast("array<string>"))
    warnings, _ = governance.split_messages(warned, F.lit(None).cast("array<string>"))
    empty = F.create_map().cast("map<string,string>")
    return catalog(t).join(texts, "doc_id").select(
        "doc_id", "status", "expires_at", "review_due_at", warnings.alias("warnings"),
        F.md5(F.col("lang")).alias("warning_fingerprint"),
        governance.acknowledge(empty, "parse_warning", F.md5(F.lit("en"))).alias("acknowledgements"),
    )


ISSUES = f"""WITH {CATALOG}, d AS (SELECT docs.*, contains(text, '###') AS odd FROM docs JOIN documents USING (doc_id)),
issues AS (
  SELECT doc_id, status, 'pending_review' AS type, 'medium' AS severity, 'open' AS issue_status FROM d WHERE status = 'review'
  UNION ALL SELECT doc_id, status, 'expired', 'high', 'open' FROM d WHERE status = 'published' AND expires_at <= {NOW}
  UNION ALL SELECT doc_id, status, 'expiring', 'medium', 'open' FROM d WHERE status = 'published' AND expires_at > {NOW} AND expires_at - {NOW} < INTERVAL 30 DAY
  UNION ALL SELECT doc_id, status, 'no_review_date', 'low', 'open' FROM d WHERE status = 'published' AND coalesce(expires_at > {NOW}, true) AND review_due_at IS NULL
  UNION ALL SELECT doc_id, status, 'review_due', 'medium', 'open' FROM d WHERE status = 'published' AND coalesce(expires_at > {NOW}, true) AND review_due_at <= {NOW}
  UNION ALL SELECT doc_id, status, 'parse_warning', 'medium', CASE WHEN lang = 'en' THEN 'acknowledged' ELSE 'open' END FROM d WHERE odd AND status <> 'archived')
"""


@query("issues", ISSUES + "SELECT doc_id || ':' || type AS issue_id, doc_id, type, severity, issue_status FROM issues")
def issues(t: Tables):
    return governance.document_issues(governed(t), as_of()).select("issue_id", "doc_id", "type", "severity", "issue_status")


@query(
    "work_queue",
    ISSUES + """SELECT kind, severity, count(*) AS items, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS severity_rank FROM (
      SELECT CASE type WHEN 'pending_review' THEN 'review' WHEN 'parse_warning' THEN 'evidence' ELSE 'review_due' END AS kind, severity FROM issues WHERE issue_status = 'open'
      UNION ALL SELECT 'conflict', 'medium' FROM labels WHERE toxic = 1
      UNION ALL SELECT DISTINCT 'evidence', 'medium' || substr(doc_id::VARCHAR, 1, 0) FROM labels WHERE false
      UNION ALL SELECT 'evidence', 'medium' FROM (SELECT DISTINCT vec_id FROM embeddings WHERE label < 3)
      UNION ALL SELECT 'evidence', 'medium' FROM (SELECT DISTINCT page_id FROM pages WHERE contains(html, '<table'))
      UNION ALL SELECT 'processing', CASE WHEN event_type = 'click' THEN 'low' ELSE 'high' END FROM events WHERE event_type IN ('click', 'error')
      UNION ALL SELECT 'feedback', 'medium' FROM labels WHERE quality = 0) GROUP BY kind, severity""",
)
def work_queue(t: Tables):
    found = governance.document_issues(governed(t), as_of())
    conflicts = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("issue_id"), "doc_id", F.lit("open").alias("status"))
    relations = t.embeddings.filter("label < 3").select(F.col("vec_id").alias("doc_id"), F.lit("candidate").alias("status"), F.lit(False).alias("stale"))
    blocks = t.pages.filter(F.contains("html", F.lit("<table"))).select(
        F.col("page_id").alias("doc_id"), F.lit(True).alias("review_required"), F.lit("unreviewed").alias("review_state")
    )
    kind = F.col("event_type")
    tasks = t.events.filter(kind.isin("click", "error")).select(
        F.col("event_id").alias("task_id"), F.col("user_id").alias("doc_id"),
        F.when(kind == "click", "queued").otherwise("failed").alias("status"), F.lit("index").alias("kind"),
    )
    feedback = t.labels.select(F.col("doc_id").alias("feedback_id"), "doc_id", F.when(F.col("quality") == 0, "open").otherwise("resolved").alias("status"))
    queue = governance.work_queue(found, conflicts, relations, blocks, tasks, feedback)
    return queue.groupBy("kind", "severity").agg(F.count("*").alias("items")).withColumn(
        "severity_rank", governance.severity_rank(F.col("severity"))
    )


@query(
    "workspace_summary",
    f"""WITH {CATALOG} SELECT base_id, count(*) AS total, count(*) FILTER (status = 'published' AND deleted_at IS NULL) AS published, count(*) FILTER (status = 'review') AS review,
      count(*) FILTER (access_state = 'withdrawn') AS withdrawn FROM docs GROUP BY base_id""",
)
def workspace_summary(t: Tables):
    return usage.conditional_counts(catalog(t), {
        "published": (F.col("status") == "published") & F.col("deleted_at").isNull(), "review": F.col("status") == "review",
        "withdrawn": F.col("access_state") == "withdrawn",
    }, ["base_id"])


# --- conversations ---------------------------------------------------------------

CODES = r"list_distinct(list_filter(regexp_extract_all({}, '\b[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)+\b'), lambda w: regexp_matches(w, '[0-9]')))"
TURNS = """turns AS (SELECT a.conv_id, a.turn, trim(u.text, E' \\t\\r\\n') AS question, trim(a.text, E' \\t\\r\\n') AS answer
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user' AND trim(u.text) <> '')"""


@query(
    "conversation_context",
    f"""WITH {TURNS}, n AS (SELECT *, row_number() OVER w AS k, sum(length(json_object('question', question, 'answer', answer)::VARCHAR) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) + 1 AS used
      FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
    p AS (SELECT *, k = 1 OR (k <= 6 AND used <= 2500) AS r FROM n WHERE k <= 30)
    SELECT conv_id, count(*) FILTER (r) AS recent_turns, count(*) FILTER (NOT r) AS summary_turns, arg_max(question, turn) AS last_question,
      coalesce(string_agg(question, chr(10) ORDER BY turn) FILTER (NOT r), '') AS conditions,
      array_to_string({CODES.format("string_agg(question, ' ' ORDER BY turn) FILTER (r)")}, ',') AS object_ids FROM p GROUP BY conv_id""",
)
def conversation_context(t: Tables):
    found = conversation.conversation_context(conversation.answered_turns(t.conversations), budget=2500)
    return found.select("conv_id", "recent_turns", "summary_turns", "last_question", "conditions", F.array_join("object_ids", ",").alias("object_ids"))


@query(
    "follow_up_rewrite",
    f"""WITH {TURNS}, l AS (SELECT conv_id, arg_max(question, turn) AS last_question FROM turns GROUP BY conv_id),
    q AS (SELECT conv_id, CASE WHEN count(*) > 4 THEN '那么，' ELSE '' END || arg_max(role, turn) AS question FROM conversations GROUP BY conv_id)
    SELECT conv_id, question, CASE WHEN question LIKE '那%' THEN CASE WHEN last_question IS NULL THEN 'context_missing' ELSE 'follow_up' END ELSE 'standalone' END AS state,
      CASE WHEN question LIKE '那%' AND last_question IS NOT NULL THEN last_question || '；追问：' || question ELSE question END AS query FROM q LEFT JOIN l USING (conv_id)""",
)
def follow_up_rewrite(t: Tables):
    contexts = conversation.conversation_context(conversation.answered_turns(t.conversations))
    asked = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by("role", "turn").alias("role")).select(
        "conv_id", F.concat(F.when(F.col("n") > 4, "那么，").otherwise(""), F.col("role")).alias("question")
    )
    return conversation.rewrite_question(contexts, asked)


@query(
    "message_order",
    """SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, CASE role WHEN 'user' THEN 0 ELSE 1 END) AS place FROM conversations""",
)
def message_order(t: Tables):
    placed = conversation.ordered_messages(t.conversations, "conv_id", "turn")
    return placed.select("conv_id", "turn", "role", "place")


@query(
    "message_fallbacks",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 4 END,
      CASE event_type WHEN 'signup' THEN 0 ELSE 1 END, ts, event_id) AS place FROM events""",
)
def message_fallbacks(t: Tables):
    """Messages without a sequence, or with equal ones: the time and then the id decide."""
    messages = t.events.select(
        "event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 4).alias("sequence"),
        F.when(F.col("event_type") == "signup", "user").otherwise("assistant").alias("role"))
    return conversation.ordered_messages(messages, "user_id", "sequence", "ts", "event_id").select("event_id", "place")


# --- answers ----------------------------------------------------------------------

ANSWERS = """a AS (SELECT conv_id * 1000 + turn AS answer_id, text || CASE WHEN turn = 1 THEN ' [1]' WHEN length(text) > 600 THEN chr(10) || 'x [2] [1]' ELSE '' END AS answer,
  CASE WHEN turn = 1 THEN [1] WHEN length(text) > 900 THEN [1, 2] ELSE [2] END AS declared FROM conversations WHERE role = 'assistant')"""
FACT = config.FACTUAL_LINE


@query(
    "citation_check",
    f"""WITH {ANSWERS}, u AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d+)\\]', 1), lambda x: x::INT))) AS used FROM a),
    l AS (SELECT answer_id, unnest(list_filter(list_transform(string_split_regex(answer, '\\n+'), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '')) AS line FROM a),
    p AS (SELECT answer_id, line, regexp_replace(line, '^[-*•\\d.、)\\s]+', '') AS plain FROM l),
    b AS (SELECT answer_id, count(*) FILTER (NOT regexp_matches(line, '\\[\\d+\\]') AND NOT regexp_matches(line, '^#{{1,6}}\\s|[：:]$') AND NOT (regexp_matches(line, '^\\|[\\s:|-]+\\|$'))
        AND NOT (NOT regexp_matches(plain, '{FACT}') AND length(plain) < 28)) AS bare FROM p GROUP BY answer_id)
    SELECT answer_id, len(used)::INT AS cited, coalesce(bare, 0)::INT AS uncited, CASE WHEN trim(answer) = '' THEN 'invalid_response' WHEN used <> declared THEN 'invalid_citations' WHEN bare > 0 THEN 'uncited_claim' ELSE 'ok' END AS verdict
    FROM u LEFT JOIN b USING (answer_id)""",
)
def citation_check(t: Tables):
    tail = F.when(F.col("turn") == 1, " [1]").when(F.length("text") > 600, "\nx [2] [1]").otherwise("")
    declared = (
        F.when(F.col("turn") == 1, F.array(F.lit(1))).when(F.length("text") > 900, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))
    )
    rows = t.conversations.filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.concat("text", tail).alias("answer"), declared.alias("declared"), F.lit(2).alias("sources")
    )
    return answers.check_citations(rows).select("answer_id", "cited", "uncited", "verdict")


# Points for the given languages; the Han ones are the library's default.
LATIN_POINTS = (("place", "the|der|la", "in|von|de"), ("reason", "ing|keit|tion", "for|für|para"), ("owner", "zz", "zz"))
LATIN_DEFAULT = (("core", "(?s).+"), ("basis", "and|und|et"))


def point_answers(t: Tables) -> DataFrame:
    turns = conversation.answered_turns(t.conversations)
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "question", "answer",
        F.when(F.length("answer") > 400, 1).otherwise(0).alias("citations"),
    )


POINTS = f"""WITH {TURNS}, q AS (SELECT conv_id * 1000 + turn AS answer_id, question, answer, length(answer) > 400 AS cited FROM turns),
e AS (SELECT *, list_filter([CASE WHEN regexp_matches(question, 'the|der|la') THEN 'place' END, CASE WHEN regexp_matches(question, 'ing|keit|tion') THEN 'reason' END], lambda x: x IS NOT NULL) AS pts FROM q),
x AS (SELECT answer_id, answer, cited, unnest(CASE WHEN len(pts) > 0 THEN pts ELSE ['core', 'basis'] END) AS point FROM e),
points AS (SELECT answer_id, point, CASE WHEN NOT CASE point WHEN 'place' THEN regexp_matches(answer, 'in|von|de') WHEN 'reason' THEN regexp_matches(answer, 'for|für|para')
    WHEN 'core' THEN length(answer) > 0 ELSE regexp_matches(answer, 'and|und|et') END THEN CASE WHEN cited THEN 'missing' ELSE 'insufficient' END
  WHEN NOT cited AND point <> 'core' THEN 'partial' ELSE 'answered' END AS status FROM x)
"""


@query("answer_points", POINTS + "SELECT answer_id, point, status FROM points")
def answer_points(t: Tables):
    return answers.answer_points(point_answers(t), LATIN_POINTS, LATIN_DEFAULT)


@query(
    "demands",
    POINTS + """SELECT answer_id, string_agg(DISTINCT point, ',' ORDER BY point) AS points, count(*) FILTER (status = 'missing') AS missing FROM points WHERE status <> 'answered' GROUP BY answer_id""",
)
def demands(t: Tables):
    gaps = answers.demands_from_gaps(answers.answer_points(point_answers(t), LATIN_POINTS, LATIN_DEFAULT))
    return gaps.select("answer_id", F.array_join("points", ",").alias("points"), "missing")


@query(
    "demand_verification",
    POINTS + """, later AS (SELECT answer_id - answer_id % 1000 AS conv, list_distinct(list(point)) AS done FROM points WHERE status = 'answered' GROUP BY 1),
    d AS (SELECT answer_id, list_sort(list_distinct(list(point))) AS pts FROM points WHERE status <> 'answered' GROUP BY answer_id)
    SELECT answer_id, CASE WHEN len(list_filter(pts, lambda p: NOT coalesce(list_contains(done, p), false))) = 0 THEN 'closed' ELSE 'returned' END AS status
    FROM d LEFT JOIN later ON conv = answer_id - answer_id % 1000""",
)
def demand_verification(t: Tables):
    """A demand closes when any answer of its conversation gives the point."""
    points = cut_lineage(answers.answer_points(point_answers(t), LATIN_POINTS, LATIN_DEFAULT))
    asked = answers.demands_from_gaps(points)
    conv = lambda c: (F.col(c) - F.col(c) % 1000)
    later = points.withColumn("conv", conv("answer_id")).select("conv", "point", "status").distinct()
    now = asked.select("answer_id", conv("answer_id").alias("conv")).join(later, "conv").select("answer_id", "point", "status")
    return answers.verify_demands(asked, now).select("answer_id", "status")


# --- evaluation --------------------------------------------------------------------

CASES = f"""{BM25}, cases AS (SELECT b.item_id AS case_id, CASE WHEN item_id % 2 = 0 THEN item_id * 3 END AS expected_doc, split_part(text, ' ', 3) AS expected_text,
  list_filter([split_part(text, ' ', 5), split_part(text, ' ', 7)], lambda x: x <> '') AS terms, length(text) < 150 AS must_refuse FROM benchmark b),
res AS (SELECT query_id AS case_id, doc_id, chunk_text AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id, ordinal) AS rank FROM bm25) JOIN corpus USING (doc_id, ordinal)
  WHERE rank <= 10 AND round(score, 6) >= {LEAST_SCORE})"""


def evaluation_cases(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Benchmark texts as cases; the passages are what retrieval finds for them."""
    item = F.col("item_id")
    words = F.filter(F.array(F.split_part("text", F.lit(" "), F.lit(5)), F.split_part("text", F.lit(" "), F.lit(7))), lambda w: w != "")
    cases = t.benchmark.select(
        item.alias("case_id"), F.when(item % 2 == 0, item * 3).alias("expected_doc"),
        F.split_part("text", F.lit(" "), F.lit(3)).alias("expected_text"), words.alias("terms"), (F.length("text") < 150).alias("must_refuse"),
    )
    corpus = cut_lineage(chunk_corpus(t).select("doc_id", "ordinal", "tokens", "n_tokens", "chunk_text"))
    hits = retrieval.bm25_top_k(corpus.drop("chunk_text"), retrieval.query_terms(retrieval.analyse_queries(benchmark_queries(t))), 10)
    found = hits.filter(F.col("score") >= LEAST_SCORE).join(corpus.select("doc_id", "ordinal", "chunk_text"), ["doc_id", "ordinal"])
    return cases, found.select(F.col("query_id").alias("case_id"), "doc_id", F.col("chunk_text").alias("text"))


SCORED = f"""WITH {CASES},
h AS (SELECT case_id, count(doc_id) AS passages, coalesce(bool_or(doc_id IS NOT NULL AND (expected_doc IS NULL OR doc_id = expected_doc)), false) AS src,
    coalesce(bool_or((expected_doc IS NULL OR doc_id = expected_doc) AND contains(text, expected_text)), false) AS txt,
    len(any_value(terms)) - (CASE WHEN len(any_value(terms)) > 0 AND coalesce(bool_or((expected_doc IS NULL OR doc_id = expected_doc) AND contains(text, terms[1])), false) THEN 1 ELSE 0 END)
      - (CASE WHEN len(any_value(terms)) > 1 AND any_value(terms)[1] <> any_value(terms)[2] AND coalesce(bool_or((expected_doc IS NULL OR doc_id = expected_doc) AND contains(text, terms[2])), false) THEN 1 ELSE 0 END)
      - (CASE WHEN len(any_value(terms)) > 1 AND any_value(terms)[1] = any_value(terms)[2] THEN 1 ELSE 0 END) AS miss
  FROM cases LEFT JOIN res USING (case_id) GROUP BY case_id),
scored AS (SELECT case_id, must_refuse, expected_doc IS NULL OR src AS source_hit, expected_text = '' OR txt AS text_hit, miss::INT AS missing_terms, passages = 0 AS refused,
  CASE WHEN must_refuse THEN passages = 0 ELSE (expected_doc IS NULL OR src) AND (expected_text = '' OR txt) AND miss = 0 END AS passed FROM h JOIN cases USING (case_id))
"""


@query("eval_scores", SCORED + "SELECT case_id, source_hit, text_hit, missing_terms, refused, passed FROM scored")
def eval_scores(t: Tables):
    return answers.score_cases(*evaluation_cases(t))


@query(
    "eval_pass_rate",
    SCORED + """SELECT case_id % 5 AS version, count(*) AS cases, count(*) FILTER (passed) AS passed, round(avg(passed::INT), 6) AS pass_rate,
      count(*) >= 2 AND bool_or(must_refuse) AND NOT bool_and(must_refuse) AND bool_and(passed) AS publishable FROM scored GROUP BY 1""",
)
def eval_pass_rate(t: Tables):
    cases, results = evaluation_cases(t)
    scored = answers.score_cases(cases, results).join(cases.select("case_id", "must_refuse"), "case_id").select(
        "*", (F.col("case_id") % 5).alias("version"), F.lit(True).alias("current")
    )
    rate = answers.pass_rate(scored, "version")
    gate = answers.publication_gate(scored, "version").select("version", "publishable")
    return rate.join(gate, "version").select("version", "cases", "passed", F.round("pass_rate", 6).alias("pass_rate"), "publishable")


@query(
    "case_verification",
    """WITH c AS (SELECT o_orderkey AS case_id, o_custkey, o_orderdate AS at, o_orderpriority AS scenario FROM orders),
    d AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0),
    e AS (SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_linestatus = 'F' OR l_linestatus = 'O') AS completed, count(*) FILTER (l_returnflag <> 'R') AS passed, max(l_shipdate) AS at FROM lineitem GROUP BY l_orderkey)
    SELECT case_id, d.c_custkey IS NOT NULL AS evidence_current, coalesce(passed = total, false) AS all_passed, coalesce(e.at > c.at, false) AS run_after_case,
      d.c_custkey IS NOT NULL AND coalesce(completed = total AND total > 0 AND passed = total AND e.at > c.at, false) AS verified
    FROM c LEFT JOIN d ON c_custkey = o_custkey LEFT JOIN e ON l_orderkey = case_id""",
)
def case_verification(t: Tables):
    cases = t.orders.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("doc_id"), F.lit(1).alias("version"),
        F.col("o_orderdate").alias("opened_at"), F.lit("s").alias("scenario"), F.col("o_orderkey").alias("evaluation_id"),
    )
    live = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("doc_id"), F.lit(1).alias("version"))
    runs = t.lineitem.groupBy(F.col("l_orderkey").alias("evaluation_id")).agg(
        F.lit("s").alias("scenario"), F.count("*").alias("total"), F.count_if(F.col("l_linestatus").isin("F", "O")).alias("completed"),
        F.count_if(F.col("l_returnflag") != "R").alias("passed"), F.max("l_shipdate").alias("started_at"),
    )
    return answers.case_verification(cases, live, runs).select("case_id", "evidence_current", "all_passed", "run_after_case", "verified")


@query(
    "structured_output",
    """SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INT > 50 AND event_type = 'view' THEN 'invalid:kind' ELSE '' END ||
      CASE WHEN event_type = 'error' THEN 'missing:kind' ELSE '' END AS problems FROM events""",
)
def structured_output(t: Tables):
    kind = F.when((F.get_json_object("props", "$.k").cast("int") > 50) & (F.col("event_type") == "view"), "other").otherwise(F.col("event_type"))
    body = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit(', "kind": "'), kind, F.lit('"'))), F.lit("}"))
    checked = answers.validate_output(t.events.withColumn("output", body), "output", {
        "k": {"type": "integer", "required": True}, "kind": {"type": "string", "required": True, "enum": ["view", "click", "purchase", "signup"]},
    })
    return checked.select("event_id", F.array_join("problems", ",").alias("problems"))


ALONE = "regexp_matches(lower({}), '(^|[^a-z0-9])' || lower({}) || '($|[^a-z0-9])')"
HOLDS = "CASE WHEN length({1}) = 1 THEN " + ALONE.format("{0}", "{1}") + " ELSE contains(lower({0}), lower({1})) END"


@query(
    "filter_grounding",
    f"""WITH v AS (SELECT DISTINCT 'o_orderstatus' AS col, o_orderstatus AS v FROM orders UNION SELECT DISTINCT 'l_returnflag', l_returnflag FROM lineitem UNION SELECT DISTINCT 'l_linestatus', l_linestatus FROM lineitem UNION SELECT DISTINCT 'c_mktsegment', c_mktsegment FROM customer),
    p AS (SELECT c_custkey AS query_id, 'list all in ' || c_mktsegment || ' now with O' AS text, unnest([
        {{'col': 'c_mktsegment', 'op': 'eq', 'v': c_mktsegment}}, {{'col': 'c_mktsegment', 'op': 'neq', 'v': c_mktsegment}},
        {{'col': 'c_mktsegment', 'op': 'in', 'v': 'F'}}, {{'col': 'o_orderstatus', 'op': 'eq', 'v': 'O'}}]) AS f FROM customer),
    w AS (SELECT DISTINCT f.v AS value FROM p),
    h AS (SELECT value, count(DISTINCT col) AS n, min(col) AS holder FROM w JOIN v ON {HOLDS.format("v.v", "w.value")} GROUP BY value)
    SELECT query_id, f.col AS column, f.op AS op, CASE
      WHEN NOT {HOLDS.format("text", "f.v")} THEN 'unrequested_value'
      WHEN NOT contains(text, f.col) AND coalesce(n <> 1 OR holder <> f.col, true) THEN 'ambiguous_column'
      WHEN f.op = 'neq' AND NOT regexp_matches(text, '{config.FILTER_WORDS["neq"]}') THEN 'unrequested_comparison' ELSE 'grounded' END AS verdict
    FROM p LEFT JOIN h ON h.value = f.v""",
)
def filter_grounding(t: Tables):
    """Four planned filters per customer: asked for, wrongly compared, not in the question, and of two possible columns."""
    asked = t.customer.select(
        F.col("c_custkey").alias("query_id"), F.concat(F.lit("list all in "), F.col("c_mktsegment"), F.lit(" now with O")).alias("text"))
    item = lambda column, op, value: F.struct(F.lit(column).alias("column"), F.lit(op).alias("op"), value.alias("value"))
    segment = F.col("c_mktsegment")
    plan = t.customer.select(F.col("c_custkey").alias("query_id"), F.explode(F.array(
        item("c_mktsegment", "eq", segment), item("c_mktsegment", "neq", segment), item("c_mktsegment", "in", F.lit("F")),
        item("o_orderstatus", "eq", F.lit("O")),
    )).alias("f")).select("query_id", "f.*")
    column = lambda df, c: df.select(F.lit(c).alias("column"), F.col(c).alias("value"))
    values = column(t.orders, "o_orderstatus").unionByName(column(t.lineitem, "l_returnflag")).unionByName(
        column(t.lineitem, "l_linestatus")).unionByName(column(t.customer, "c_mktsegment")).distinct()
    return answers.ground_filters(plan, asked, values).select("query_id", "column", "op", "verdict")


@query(
    "count_verdicts",
    """WITH p AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN '一共有多少条记录？' WHEN 1 THEN '非空的o_clerk有多少条' ELSE '列出订单' END AS text,
      CASE o_orderstatus WHEN 'F' THEN 'count' WHEN 'O' THEN 'sum' ELSE 'count' END AS op, CASE WHEN o_orderstatus = 'P' OR o_orderkey % 2 = 0 THEN 'o_clerk' END AS col FROM orders)
    SELECT query_id, CASE WHEN query_id % 3 = 2 THEN 'no_count' WHEN op <> 'count' THEN 'count_required'
      WHEN col IS NOT NULL AND query_id % 3 = 0 THEN 'unrequested_column' ELSE 'counted' END AS verdict, query_id % 3 = 0 AS plain FROM p""",
)
def count_verdicts(t: Tables):
    """Whether a count is asked for, planned, and of rows; which questions ask for nothing else."""
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, "一共有多少条记录？").when(key % 3 == 1, "非空的o_clerk有多少条").otherwise("列出订单")
    asked = t.orders.select(key.alias("query_id"), text.alias("text"))
    column = F.when((F.col("o_orderstatus") == "P") | (key % 2 == 0), "o_clerk")
    planned = t.orders.select(key.alias("query_id"), F.when(F.col("o_orderstatus") == "O", "sum").otherwise("count").alias("op"), column.alias("column"))
    plain = answers.count_question(F.col("text"), F.lit("订单"), F.array(F.lit("F"), F.lit("O")))
    return answers.check_counts(planned, asked).join(asked.select("query_id", plain.alias("plain")), "query_id")


# --- routing and combination ---------------------------------------------------------

def _route_sql() -> str:
    hits = " + ".join(
        f"(CASE WHEN ({h}) > 0 THEN 8 + 6 * ({h}) ELSE 0 END)"
        for h in (" + ".join(f"contains(q, '{w}')::INT" for w in words) for _, words in config.SCENARIOS)
    )
    return f"""WITH p AS (SELECT p_partkey AS query_id, p_name || ' ' || CASE WHEN p_size < 10 THEN '设备维修记录' WHEN p_size < 20 THEN '与线路的关联关系是什么？'
      WHEN p_size < 30 THEN '投诉材料原文' WHEN p_size < 40 THEN '如何' ELSE '' END AS q FROM part),
    s AS (SELECT query_id, q, 12 + CASE WHEN regexp_matches(q, '{config.DOCUMENT_HINT}') THEN 10 ELSE 0 END AS documents_score, {hits} AS sc,
      CASE WHEN regexp_matches(q, '{config.GRAPH_HINT}') THEN 22 ELSE 0 END AS graph_score,
      CASE WHEN regexp_matches(q, '{config.QUESTION_HINT}') THEN 16 WHEN length(q) >= 12 THEN 8 ELSE 0 END AS chat_score FROM p),
    t AS (SELECT *, sc + CASE WHEN regexp_matches(q, '{config.SCENARIO_HINT}') AND sc < 8 THEN 6 ELSE 0 END AS scenarios_score FROM s),
    l AS (SELECT query_id, unnest([{{'c': 'documents', 's': documents_score}}, {{'c': 'scenarios', 's': scenarios_score}}, {{'c': 'graph', 's': graph_score}}, {{'c': 'chat', 's': chat_score}}]) AS e FROM t),
    r AS (SELECT query_id, e.c, e.s, row_number() OVER (PARTITION BY query_id ORDER BY e.s DESC, e.c) AS k FROM l WHERE e.s >= 8),
    x AS (SELECT query_id, list(c ORDER BY k) AS ch FROM r WHERE k <= 3 GROUP BY query_id)
    SELECT query_id, documents_score, scenarios_score, graph_score, chat_score, array_to_string(CASE WHEN list_contains(ch, 'documents') THEN ch ELSE list_append(ch, 'documents') END, ',') AS channels, ch[1] AS primary_channel
    FROM t JOIN x USING (query_id)"""


@query("intent_route", _route_sql())
def intent_route(t: Tables):
    size = F.col("p_size")
    tail = F.when(size < 10, "设备维修记录").when(size < 20, "与线路的关联关系是什么？").when(size < 30, "投诉材料原文").when(size < 40, "如何").otherwise("")
    asked = t.part.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_name", tail).alias("query"))
    return answers.route(asked).withColumn("channels", F.array_join("channels", ","))


@query(
    "combined_channels",
    """WITH a AS (SELECT o_custkey AS query_id, 'documents' AS channel, o_orderkey AS item, o_totalprice AS score FROM orders),
    b AS (SELECT o_custkey AS query_id, 'graph' AS channel, l_partkey AS item, max(l_extendedprice) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, item::VARCHAR) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
    SELECT query_id, channel, item::VARCHAR AS item_id, place::INT AS place FROM r WHERE place <= CASE channel WHEN 'documents' THEN 8 ELSE 6 END""",
)
def combined_channels(t: Tables):
    documents = t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item_id"), F.col("o_totalprice").alias("score"))
    parts = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("query_id"), F.col("l_partkey").alias("item_id")).agg(F.max("l_extendedprice").alias("score"))
    merged = recommend.combine_channels({"documents": (documents, 8), "graph": (parts, 6)})
    return merged.select("query_id", "channel", "item_id", "place")


@query(
    "merged_bases",
    """SELECT query_id, doc_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM (
      SELECT l_suppkey AS query_id, l_orderkey AS doc_id, max(l_extendedprice) AS score FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL
      UNION ALL SELECT l_suppkey, l_orderkey + 10000000, max(l_extendedprice) FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)) WHERE place <= 20""",
)
def merged_bases(t: Tables):
    part = lambda status, shift: t.lineitem.filter(F.col("l_linestatus") == status).groupBy(
        F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") + shift).alias("doc_id")
    ).agg(F.max("l_extendedprice").alias("score"))
    return recommend.merge_bases([part("F", 0), part("O", 10_000_000)]).select("query_id", "doc_id", "place")


@query(
    "recommendations",
    """WITH ctx AS (SELECT n_nationkey AS context_id, ['ring', 'small'] AS kw, ['widget', CASE WHEN n_regionkey < 2 THEN 'red' ELSE 'blue' END] AS tw FROM nation),
    cand AS (SELECT DISTINCT s_nationkey AS context_id, l_partkey AS doc_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    j AS (SELECT context_id, doc_id, p_brand AS g, DATE '2023-12-01' + p_size * INTERVAL 1 DAY AS up, p_name, kw, tw, p_size > 45 AS due, p_size = 7 AS linked, p_size = 11 AS rd FROM cand JOIN ctx USING (context_id) JOIN part ON p_partkey = doc_id),
    s AS (SELECT *, len(list_filter(tw, lambda w: contains(p_name, w))) AS t, len(list_filter(kw, lambda w: contains(p_name, w))) AS k FROM j),
    f AS (SELECT *, CASE WHEN linked THEN 100 ELSE 0 END + 12 * t + 5 * k - CASE WHEN due THEN 20 ELSE 0 END - CASE WHEN rd THEN 3 ELSE 0 END AS score FROM s WHERE linked OR t > 0 OR k > 0),
    b AS (SELECT *, row_number() OVER (PARTITION BY context_id, g ORDER BY score DESC, up DESC, doc_id) AS r FROM f),
    o AS (SELECT context_id, doc_id, score, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, up DESC, doc_id) AS place FROM b WHERE r = 1)
    SELECT context_id, doc_id, score::INT AS score, place::INT AS place FROM o WHERE place <= 12""",
)
def recommendations(t: Tables):
    contexts = t.nation.select(
        F.col("n_nationkey").alias("context_id"), F.array(F.lit("ring"), F.lit("small")).alias("keywords"),
        F.array(F.lit("widget"), F.when(F.col("n_regionkey") < 2, "red").otherwise("blue")).alias("task_words"),
    )
    pairs = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("context_id"), F.col("l_partkey").alias("doc_id")).distinct()
    item = pairs.join(t.part, F.col("doc_id") == F.col("p_partkey"))
    day = lambda start, days: F.date_add(F.lit(start).cast("date"), days).cast("timestamp")
    candidates = item.select(
        "context_id", "doc_id", F.col("p_name").alias("searchable"), F.col("p_brand").alias("group_id"), day("2023-12-01", F.col("p_size")).alias("updated_at"),
        F.when(F.col("p_size") > 45, F.to_timestamp(F.lit("2024-01-01"))).alias("review_due_at"), F.lit(False).alias("query_hit"),
    )
    links = item.filter("p_size = 7").select("context_id", "doc_id")
    preferences = item.filter("p_size = 11").select("context_id", "doc_id", F.lit(True).alias("read"), F.lit(False).alias("dismissed"))
    return recommend.recommend(candidates, contexts, links, preferences, as_of()).select("context_id", "doc_id", "score", "place")


@query(
    "learned_guidance",
    r"""WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 5)) AS terms FROM benchmark),
    d AS (SELECT doc_id, lower(text) AS t FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)),
    x AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM q),
    tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '[a-z0-9]+(?:[-_.][a-z0-9]+)*')) AS term FROM d),
    m AS (SELECT query_id, doc_id, n, count(*) AS matches FROM x JOIN tok USING (term) GROUP BY ALL),
    s AS (SELECT *, matches / n + matches / 100 AS score FROM m WHERE CASE WHEN n = 1 THEN true ELSE matches >= 2 AND matches / n >= 0.5 END),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM s)
    SELECT query_id, place::INT AS place, doc_id, matches, round(score, 6) AS score FROM r WHERE place <= 3""",
)
def learned_guidance(t: Tables):
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.length(w) > 5))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), words.alias("terms"))
    confirmed = t.spread("documents", "doc_id").join(t.labels.filter("quality = 1"), "doc_id", "left_semi")
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    found = confirmed.select("doc_id", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).join(wanted, "term", "left_semi")
    stamped = confirmed.select("doc_id", F.lit(0).alias("updated_at"))
    return recommend.learned_guidance(asked, stamped, found).withColumn("score", F.round("score", 6))


def document_chunks(t: Tables) -> DataFrame:
    return chunks.chunk_documents(t.spread("documents", "doc_id"))


@query(
    "clause_comparison",
    f"""WITH {CHUNKS}, p AS (SELECT doc_id AS pair_id, doc_id AS l, min_by(o.id, o.id) AS r, any_value(w) AS w FROM (SELECT doc_id, text, md5(text) AS h, lang AS w FROM documents) a
        JOIN (SELECT min(doc_id) AS id, md5(text) AS h FROM documents GROUP BY 2) o USING (h) GROUP BY ALL),
    m AS (SELECT pair_id, side, ordinal, chunk_text, row_number() OVER (PARTITION BY pair_id, side ORDER BY ordinal) AS k FROM (
      SELECT pair_id, 'l' AS side, l AS doc_id, w FROM p UNION ALL SELECT pair_id, 'r', r, w FROM p) JOIN chunks USING (doc_id) WHERE contains(chunk_text, w)),
    a AS (SELECT pair_id, count(*) FILTER (side = 'l') AS lc, count(*) FILTER (side = 'r') AS rc, string_agg(chunk_text, chr(10) ORDER BY ordinal) FILTER (side = 'l') AS lt, string_agg(chunk_text, chr(10) ORDER BY ordinal) FILTER (side = 'r') AS rt FROM m WHERE k <= 4 GROUP BY pair_id)
    SELECT pair_id, lc::INT AS left_chunks, rc::INT AS right_chunks, md5(lt) AS left_md5, lt = rt AS identical FROM a WHERE lc > 0 AND rc > 0""",
)
def clause_comparison(t: Tables):
    """Each document against the first one with the same text, by its language code as term."""
    hashed = t.documents.select("doc_id", "lang", F.md5("text").alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("right_id"))
    pairs = hashed.join(first, "h").select(F.col("doc_id").alias("pair_id"), F.col("doc_id").alias("left_id"), "right_id", "lang")
    done = recommend.compare_clauses(pairs, cut_lineage(document_chunks(t)), F.array("lang"))
    return done.select("pair_id", "left_chunks", "right_chunks", F.md5("left_text").alias("left_md5"), "identical")


@query(
    "excerpt_choice",
    f"""WITH {CHUNKS}, w AS (SELECT doc_id, [lang || ' ', 'tion'] AS words FROM documents),
    j AS (SELECT *, len(list_filter(words, lambda x: contains(chunk_text, x))) = 0 AS miss FROM chunks JOIN w USING (doc_id))
    SELECT doc_id, arg_min(ordinal, (miss, ordinal))::INT AS ordinal, md5(arg_min(chunk_text, (miss, ordinal))) AS excerpt_md5 FROM j GROUP BY doc_id""",
)
def excerpt_choice(t: Tables):
    words = t.documents.select("doc_id", F.array(F.concat("lang", F.lit(" ")), F.lit("tion")).alias("words"))
    return recommend.excerpt_chunks(document_chunks(t), words).select("doc_id", "ordinal", F.md5("excerpt").alias("excerpt_md5"))


@query(
    "extractive_answers",
    f"""WITH {CHUNKS} SELECT doc_id AS query_id, count(*)::INT AS citations, md5(string_agg('[' || ordinal || '] 《' || doc_id || '》第 1 页（版本 1）' || chr(10) || chunk_text, chr(10) || chr(10) ORDER BY ordinal)) AS answer_md5
    FROM chunks WHERE ordinal <= 4 GROUP BY doc_id""",
)
def extractive_answers(t: Tables):
    hits = document_chunks(t).select(
        F.col("doc_id").alias("query_id"), F.col("ordinal").alias("place"), F.col("doc_id").cast("string").alias("title"),
        F.lit(1).alias("page"), F.lit(1).alias("version"), F.col("chunk_text").alias("text"),
    )
    return recommend.extractive_answers(hits).select("query_id", "citations", F.md5("answer").alias("answer_md5"))


@query(
    "packed_evidence",
    f"""WITH RECURSIVE {CHUNKS}, i AS (SELECT doc_id AS query_id, ordinal, length(chunk_text) AS chars,
      row_number() OVER (PARTITION BY doc_id ORDER BY CASE ordinal % 3 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END, ordinal) AS k FROM chunks),
    w AS (SELECT query_id, k, ordinal, chars, chars <= 5000 AS ok, CASE WHEN chars <= 5000 THEN chars ELSE 0 END AS used FROM i WHERE k = 1
      UNION ALL SELECT i.query_id, i.k, i.ordinal, i.chars, used + i.chars <= 5000, CASE WHEN used + i.chars <= 5000 THEN used + i.chars ELSE used END
      FROM w JOIN i ON i.query_id = w.query_id AND i.k = w.k + 1)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k)::INT AS place, ordinal::VARCHAR AS item_id, chars::BIGINT AS chars FROM w WHERE ok""",
)
def packed_evidence(t: Tables):
    """Tool rows, references and hits of every document under one budget."""
    items = document_chunks(t).select(
        F.col("doc_id").alias("query_id"), F.when(F.col("ordinal") % 3 == 0, "tool").when(F.col("ordinal") % 3 == 1, "hit").otherwise("reference").alias("source"),
        F.col("ordinal").alias("rank"), F.col("ordinal").cast("string").alias("item_id"), F.length("chunk_text").alias("chars"),
    )
    return recommend.pack_evidence(items, 5000)


@query(
    "table_evidence",
    """WITH l AS (SELECT o_custkey AS table_key, o_orderkey AS row_no, o_orderkey || chr(9) || o_orderstatus || chr(9) || o_orderpriority AS line FROM orders),
    n AS (SELECT *, row_number() OVER w AS k, 20 + 1 + sum(length(line) + 1) OVER (PARTITION BY table_key ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS used FROM l WINDOW w AS (PARTITION BY table_key ORDER BY row_no))
    SELECT table_key, count(*) AS total_rows, count(*) FILTER (k <= 12 AND used <= 250) AS returned_rows, coalesce(max(used) FILTER (k <= 12 AND used <= 250), 0)::BIGINT AS chars,
      count(*) = count(*) FILTER (k <= 12 AND used <= 250) AS complete FROM n GROUP BY table_key""",
)
def table_evidence(t: Tables):
    """The orders of a customer as a table, under a small budget."""
    line = F.concat_ws("\t", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority")
    rows = t.orders.select(F.col("o_custkey").alias("table_key"), F.col("o_orderkey").alias("row_no"), line.alias("line"), F.lit(20).alias("header_chars"))
    return recommend.table_evidence(rows, 12, 250)


@query(
    "conflict_evidence",
    """WITH h AS (SELECT item_id AS query_id, item_id * 2 AS doc_id FROM benchmark UNION ALL SELECT item_id, item_id * 2 + 1 FROM benchmark),
    i AS (SELECT quality * 2 + toxic AS grp, doc_id FROM labels),
    iss AS (SELECT doc_id AS issue_id, doc_id AS d FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, doc_id + 1 FROM labels WHERE toxic = 1)
    SELECT t.query_id, t.issue_id, iss.d AS doc_id, false AS definite FROM (SELECT DISTINCT query_id, issue_id FROM h JOIN iss ON iss.d = h.doc_id) t JOIN iss USING (issue_id)""",
)
def conflict_evidence(t: Tables):
    item = F.col("item_id")
    hits = t.benchmark.select(item.alias("query_id"), F.explode(F.array(item * 2, item * 2 + 1)).alias("doc_id"))
    issue = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("issue_id"), F.explode(F.array("doc_id", F.col("doc_id") + 1)).alias("doc_id")).withColumn("block_id", F.lit(1))
    return recommend.conflict_pairs(hits, issue).select("query_id", "issue_id", "doc_id", "definite")


@query(
    "coverage_policy",
    """SELECT conv_id AS query_id, bool_or(length(text) > 800) AS blocked, bool_or(length(text) > 800 OR turn > 4) AS limited, count(*) AS hits FROM conversations GROUP BY conv_id""",
)
def coverage_policy(t: Tables):
    hits = t.conversations.select(
        F.col("conv_id").alias("query_id"), F.when(F.length("text") > 800, "partial").otherwise("complete").alias("parse_coverage"),
        F.when(F.col("turn") > 4, "sampled").otherwise("complete").alias("visual_coverage"), F.lit("说明全部要求").alias("q"),
    )
    return recommend.coverage_policy(hits, F.col("q"), config.WHOLE_SOURCE, config.VISUAL_QUESTION)


@query(
    "attribute_suggestions",
    f"""WITH {CATALOG}, h AS (SELECT doc_id, 'topic' AS key, title AS value FROM docs UNION ALL SELECT doc_id, 'validity', CASE WHEN status = 'published' THEN 'effective' ELSE 'unknown' END FROM docs
      UNION ALL SELECT doc_id, 'effectiveAt', strftime(effective_at, '%Y-%m-%d') FROM docs),
    f AS (SELECT * FROM (VALUES ('topic', true), ('validity', false), ('effectiveAt', true), ('issuer', true), ('audience', false)) x(key, required)),
    hh AS (SELECT doc_id, key, value FROM h SEMI JOIN f USING (key) WHERE trim(coalesce(value, ''), E' \\t\\r\\n') <> '')
    SELECT doc_id, key, md5(value) AS value_md5 FROM hh UNION ALL SELECT doc_id, key, md5('') FROM (SELECT doc_id, key FROM docs, f WHERE required) ANTI JOIN hh USING (doc_id, key)""",
)
def attribute_suggestions(t: Tables):
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), value.alias("value"))
    hints = catalog(t).select("doc_id", F.explode(F.array(
        pair("topic", F.col("title")), pair("validity", F.when(F.col("status") == "published", "effective").otherwise("unknown")),
        pair("effectiveAt", F.date_format("effective_at", "yyyy-MM-dd")),
    )).alias("h")).select("doc_id", "h.key", "h.value", F.lit("explicit").alias("source"))
    fields = [("topic", "Topic", True), ("validity", "Validity", False), ("effectiveAt", "From", True), ("issuer", "Issuer", True), ("audience", "Audience", False)]
    template = t.spark.createDataFrame(fields, "key string, label string, required boolean")
    return governance.suggest_attributes(hints, template).select("doc_id", "key", F.md5("value").alias("value_md5"))


@query(
    "card_drafts",
    f"""WITH {CHUNKS}, m AS (SELECT item_id AS card_id, unnest([0, 1, 2]) AS position, item_id * 3 + unnest([0, 1, 2]) AS doc_id FROM benchmark)
    SELECT card_id, count(*)::INT AS documents, md5(string_agg(chunk_text, chr(10) || chr(10) ORDER BY position)) AS body_md5 FROM m JOIN chunks USING (doc_id) WHERE ordinal = 1 GROUP BY card_id""",
)
def card_drafts(t: Tables):
    members = t.benchmark.select(F.col("item_id").alias("card_id"), F.posexplode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("position", "p")).select(
        "card_id", "position", (F.col("card_id") * 3 + F.col("p")).alias("doc_id")
    )
    return governance.card_drafts(members, document_chunks(t)).select("card_id", "documents", F.md5("body").alias("body_md5"))


@query(
    "public_rows",
    """SELECT doc_id, lang, coalesce(c_name, '') AS owner_name FROM documents LEFT JOIN customer ON c_custkey = n_chars""",
)
def public_rows(t: Tables):
    """Catalogue rows for export: private columns dropped, owner named."""
    named = t.customer.select(F.col("c_custkey").alias("n_chars"), F.col("c_name").alias("owner_name"))
    return t.documents.drop("text", "source").join(named, "n_chars", "left").select("doc_id", "lang", F.coalesce("owner_name", F.lit("")).alias("owner_name"))
