"""Checks on generated answers, evaluation scores and routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom import config
from loreloom.functions import facts as fx
from loreloom.functions.text import bind, contains_literal, strip


def referenced_numbers(answer: Column) -> Column:
    """Distinct citation numbers ``[n]`` of an answer in ascending order."""
    found = F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: n.cast("int"))))


def used_citations(citations: Column, answer: Column) -> Column:
    """Citations marked used whose number occurs in the answer."""
    numbers = referenced_numbers(answer)
    return F.filter(citations, lambda c: c["used"] & F.array_contains(numbers, c["citation"]))


def _open_tail(text: Column) -> Column:
    """Whether a factual claim follows the last citation of ``text``."""
    tail = F.regexp_replace(F.regexp_extract(text, r"(?s).*\](.*)$", 1), r"^[。；;，,.\s]+", "")
    return (tail != "") & tail.rlike(config.FACTUAL_LINE)


def _attributed(line: Column) -> Column:
    """Whether a cited line leaves no claim without a source.

    Either no factual text follows the last citation, or a citation is named as
    the source of a sentence and every sentence is covered: by such a name, by
    citations that nothing factual follows, or by holding no fact at all.
    """
    cut = F.split(F.regexp_replace(line, config.LIST_MARK, ""), config.SENTENCE_BREAK)
    sentences = F.filter(F.transform(cut, lambda s: F.regexp_replace(strip(s), config.SENTENCE_MARKS, "")), lambda s: s != "")
    cited = lambda s: s.rlike(r"\[\d+\]")
    named = lambda s: s.rlike(config.SOURCE_BEFORE + r"\s*" + config.SOURCE_NOTE + r"\s*\[\d+\]") | s.rlike(r"\[\d+\]" + config.SOURCE_AFTER)
    silent = lambda s: ~s.rlike(config.FACTUAL_LINE) & (F.length(s) < config.SHORT_LABEL_CHARS)
    covered = lambda s: F.when(~cited(s), silent(s)).otherwise(named(s) | ~_open_tail(s))
    scoped = F.exists(sentences, lambda s: cited(s) & named(s)) & F.forall(sentences, covered)
    return scoped | ~_open_tail(line)


def uncited_lines(answer: Column) -> Column:
    """Factual lines of an answer without a citation, as an array.

    Headings, lines ending in a colon, short labels, tables next to a citation
    and lines followed by a line of citations are exempt.
    """

    def check(lines: Column) -> Column:
        cited = lambda line: F.coalesce(line, F.lit("")).rlike(r"\[\d+\]")
        table = lambda line: F.coalesce(line, F.lit("")).rlike(r"^\|.*\|$")

        def uncited(line: Column, i: Column) -> Column:
            plain = F.regexp_replace(line, r"^[-*•\d.、)\s]+", "")
            factual = plain.rlike(config.FACTUAL_LINE)
            following = F.coalesce(F.get(lines, i + 1), F.lit("")).rlike(r"^\[\d+\](?:\s*\[\d+\])*[。.]?$")
            # Bounds of the table block around the line, by counting back and forth.
            before = F.array_max(F.transform(
                F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda j: (j < i) & ~table(F.get(lines, j))), lambda j: j
            ))
            after = F.array_min(F.transform(
                F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda j: (j > i) & ~table(F.get(lines, j))), lambda j: j
            ))
            near = cited(F.get(lines, before.cast("int"))) | cited(F.get(lines, after.cast("int")))
            exempt_table = table(line) & (F.coalesce(near, F.lit(False)) | line.rlike(r"^\|[\s:|-]+\|$"))
            ok = (
                F.when(cited(line), _attributed(line))
                .when(line.rlike(r"^#{1,6}\s") | line.rlike("[：:]$"), F.lit(True))
                .when(exempt_table, F.lit(True))
                .otherwise(following | (~factual & (F.length(plain) < config.SHORT_LABEL_CHARS)))
            )
            return F.when(~ok, line)

        return F.array_compact(F.transform(lines, uncited))

    lines = F.filter(F.transform(F.split(answer, r"\n+"), strip), lambda l: l != "")
    return bind(lines, check)


def check_citations(answers: DataFrame) -> DataFrame:
    """Verdict per answer: length, declared = used numbers, all in range, no uncited facts.

    ``answers`` has ``answer``, ``declared`` (array of int) and ``sources`` (count).
    """
    used = referenced_numbers(F.col("answer"))
    declared = F.array_sort(F.array_distinct(F.coalesce("declared", F.array().cast("array<int>"))))
    valid = (F.size(declared) > 0) & (declared == used) & F.forall(declared, lambda n: (n >= 1) & (n <= F.col("sources")))
    text = F.coalesce("answer", F.lit(""))
    bare = uncited_lines(text)
    verdict = (
        F.when((strip(text) == "") | (F.length(text) > 16000), "invalid_response")
        .when(~valid, "invalid_citations")
        .when(F.size(bare) > 0, "uncited_claim")
        .otherwise("ok")
    )
    return answers.select("*", F.size(used).alias("cited"), F.size(bare).alias("uncited"), verdict.alias("verdict"))


# --- completeness of an answer -----------------------------------------------------

def expected_points(question: Column, points=config.ANSWER_POINTS, default=config.DEFAULT_POINTS) -> Column:
    """Points a question asks for; the default ones when it names none."""
    asked = F.array_compact(F.array(*[F.when(question.rlike(q), F.lit(p)) for p, q, _ in points]))
    fallback = F.array(*[F.lit(p) for p, _ in default])
    return F.when(F.size(asked) > 0, asked).otherwise(fallback)


def answer_points(answers: DataFrame, points=config.ANSWER_POINTS, default=config.DEFAULT_POINTS) -> DataFrame:
    """One row per expected point with its status.

    ``answers`` has ``answer_id``, ``question``, ``answer`` and ``citations`` (count).
    """
    rows = answers.select("answer_id", "question", "answer", "citations", F.explode(expected_points(F.col("question"), points, default)).alias("point"))
    words = {p: w for p, _, w in points} | {p: w for p, w in default}
    answer, cited = F.coalesce("answer", F.lit("")), F.col("citations") > 0
    matched = reduce(
        lambda chain, item: chain.when(F.col("point") == item[0], answer.rlike(item[1])), words.items(), F.when(F.lit(False), F.lit(False))
    )
    status = (
        F.when(~matched, F.when(cited, "missing").otherwise("insufficient"))
        .when((F.col("point") == "deadline") & ~answer.rlike(config.DEADLINE_DETAIL), "partial")
        .when((F.col("point") == "materials") & ~answer.rlike(config.MATERIALS_DETAIL), "partial")
        .when(~cited & (F.col("point") != "core"), "partial")
        .otherwise("answered")
    )
    needs = (
        F.col("question").rlike(config.CONDITION_QUESTION) & ~answer.rlike(config.CONDITION_ANSWER)
        & F.col("point").isin("approver", "deadline", "materials")
    )
    return rows.select("answer_id", "point", F.when(needs, "need_condition").otherwise(status).alias("status"))


def demands_from_gaps(points: DataFrame) -> DataFrame:
    """One demand per answer with unanswered points, listing them."""
    return points.filter("status <> 'answered'").groupBy("answer_id").agg(
        F.array_sort(F.collect_set("point")).alias("points"), F.count_if(F.col("status") == "missing").alias("missing")
    )


def verify_demands(demands: DataFrame, points: DataFrame) -> DataFrame:
    """A demand closes when all its points are answered now, else it returns to work."""
    now = points.filter("status = 'answered'").groupBy("answer_id").agg(F.collect_set("point").alias("_done"))
    open_points = F.array_except("points", F.coalesce("_done", F.array().cast("array<string>")))
    return demands.join(now, "answer_id", "left").select(
        "answer_id", F.when(F.size(open_points) == 0, "closed").otherwise("returned").alias("status"), open_points.alias("open_points")
    )


def merge_demands(left: Column, right: Column, limit: int | None = None) -> Column:
    """Union of two list fields without repeats; with ``limit`` the first entries of it."""
    empty = F.array().cast("array<string>")
    union = F.array_union(F.coalesce(left, empty), F.coalesce(right, empty))
    return union if limit is None else F.slice(union, 1, limit)


# --- evaluation --------------------------------------------------------------------

def score_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Score each evaluation case against the retrieved passages.

    ``cases`` has ``case_id``, ``expected_doc``, ``expected_text``, ``terms``
    (array) and ``must_refuse``; ``results`` is ``(case_id, doc_id, text)``.
    Text tests look at the expected document's passages, or at all without one.
    Tests run per passage and combine as flags, so passages are never gathered.
    """
    joined = cases.join(results, "case_id", "left")
    present = F.col("doc_id").isNotNull()
    applicable = present & (F.col("expected_doc").isNull() | (F.col("doc_id") == F.col("expected_doc")))
    wanted = F.coalesce("terms", F.array().cast("array<string>"))
    hits = joined.groupBy("case_id").agg(
        F.count_if(present).alias("passages"),
        F.bool_or(applicable).alias("source_found"),
        F.bool_or(applicable & F.contains("text", F.coalesce("expected_text", F.lit("")))).alias("text_found"),
    )
    terms = joined.filter(applicable).select("case_id", "text", F.explode("terms").alias("term"))
    found = terms.groupBy("case_id", "term").agg(F.bool_or(F.contains("text", F.col("term"))).alias("hit")).filter("hit")
    hits = hits.join(found.groupBy("case_id").agg(F.collect_set("term").alias("found_terms")), "case_id", "left")
    missing = F.array_except(wanted, F.coalesce("found_terms", F.array().cast("array<string>")))
    source_hit = F.col("expected_doc").isNull() | F.coalesce("source_found", F.lit(False))
    text_hit = (F.coalesce("expected_text", F.lit("")) == "") | F.coalesce("text_found", F.lit(False))
    refused = F.col("passages") == 0
    return cases.join(hits, "case_id").select(
        "case_id", source_hit.alias("source_hit"), text_hit.alias("text_hit"), F.size(missing).alias("missing_terms"), refused.alias("refused"),
        F.when(F.col("must_refuse"), refused).otherwise(source_hit & text_hit & (F.size(missing) == 0)).alias("passed"),
    )


def pass_rate(scored: DataFrame, key: str) -> DataFrame:
    return scored.groupBy(key).agg(
        F.count("*").alias("cases"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("int")).alias("pass_rate")
    )


def publication_gate(scored: DataFrame, key: str) -> DataFrame:
    """A version may be published with two or more cases, one refusal and one normal, all passed and current."""
    return scored.groupBy(key).agg(
        F.count("*").alias("cases"), F.count_if("must_refuse").alias("refusals"),
        F.bool_and("passed").alias("all_passed"), F.bool_and("current").alias("all_current"),
    ).withColumn(
        "publishable",
        (F.col("cases") >= 2) & (F.col("refusals") >= 1) & (F.col("refusals") < F.col("cases")) & F.col("all_passed") & F.col("all_current"),
    )


def case_verification(cases: DataFrame, documents: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Whether a case's cited version is current and its evaluation complete, passed, newer and of the same scenario.

    ``cases``: ``case_id, doc_id, version, opened_at, scenario, evaluation_id``;
    ``documents``: ``doc_id, version``; ``evaluations``: ``evaluation_id, scenario,
    total, completed, passed, started_at``.
    """
    live = documents.select("doc_id", F.col("version").alias("_live"))
    runs = evaluations.select("evaluation_id", F.col("scenario").alias("_scenario"), "total", "completed", "passed", "started_at")
    joined = cases.join(live, "doc_id", "left").join(runs, "evaluation_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(
        "case_id", yes(F.col("_live") == F.col("version")).alias("evidence_current"),
        yes((F.col("completed") == F.col("total")) & (F.col("total") > 0)).alias("evaluation_complete"),
        yes(F.col("passed") == F.col("total")).alias("all_passed"),
        yes(F.col("started_at") > F.col("opened_at")).alias("run_after_case"),
        yes(F.col("_scenario") == F.col("scenario")).alias("same_scenario"),
    ).withColumn(
        "verified",
        F.col("evidence_current") & F.col("evaluation_complete") & F.col("all_passed") & F.col("run_after_case") & F.col("same_scenario"),
    )


def validate_output(df: DataFrame, column: str, fields: dict[str, dict]) -> DataFrame:
    """Check JSON objects against declared fields: type, options, required, undeclared.

    ``fields`` maps a name to ``{"type", "enum", "required"}`` with type string,
    integer, number or boolean.
    """
    given = F.from_json(F.col(column), "map<string,string>")
    # from_json turns numbers into text; the JSON text itself tells strings apart.
    quoted = lambda name: F.regexp_like(F.col(column), F.lit(rf'"{name}"\s*:\s*"'))
    problems = [F.when(given.isNull(), F.lit("not_an_object"))]
    undeclared = F.size(F.array_except(F.map_keys(given), F.array(*[F.lit(n) for n in fields]))) > 0
    problems.append(F.when(undeclared, F.lit("undeclared_field")))
    for name, rule in fields.items():
        value = F.try_element_at(given, F.lit(name))
        if rule.get("required"):
            problems.append(F.when(given.isNotNull() & ~F.coalesce(F.map_contains_key(given, F.lit(name)), F.lit(False)), F.lit(f"missing:{name}")))
        wrong = {
            "string": ~quoted(name) | (F.length(value) > 4000),
            "integer": quoted(name) | ~value.rlike(r"^-?\d{1,16}$"),
            "number": quoted(name) | value.try_cast("double").isNull(),
            "boolean": quoted(name) | ~value.isin("true", "false"),
        }[rule["type"]]
        if rule.get("enum"):
            wrong = wrong | ~value.isin([str(v) for v in rule["enum"]])
        problems.append(F.when(value.isNotNull() & wrong, F.lit(f"invalid:{name}")))
    found = F.array_compact(F.array(*problems))
    return df.withColumn("problems", found).withColumn("valid", F.size(found) == 0)


def _folded(col: Column) -> Column:
    """Compatibility form, lower case, trimmed: how literals are compared."""
    return strip(F.lower(fx.nfkc(col)))


def _holding_columns(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """``(query_id, column, value, holders, holder)``: the columns with a cell that contains the value.

    ``cells`` is the distinct ``(column, value)`` of the table.  A value meets the
    cells that hold its first characters (three at most), so only those are read.
    """
    needles = wanted.withColumn("_needle", _folded(F.col("value"))).filter("_needle <> ''").withColumn(
        "_gram", F.substring("_needle", 1, 3)
    )
    folded = cells.select(F.col("column").alias("_column"), _folded(F.col("value")).alias("_cell"))
    sizes = F.array(*[F.lit(n) for n in (1, 2, 3)])
    grams = F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(
        F.when(F.length("_cell") >= n, F.sequence(F.lit(1), F.length("_cell") - n + 1)).otherwise(F.array().cast("array<int>")),
        lambda at: F.substring(F.col("_cell"), at, n),
    ))))
    met = folded.select("_column", "_cell", F.explode(grams).alias("_gram")).join(needles, "_gram").filter(
        contains_literal(F.col("_cell"), F.col("_needle"))
    )
    return met.groupBy("query_id", "column", "value").agg(
        F.count_distinct("_column").alias("holders"), F.min("_column").alias("holder")
    )


def ground_filters(plan: DataFrame, questions: DataFrame, values: DataFrame) -> DataFrame:
    """Whether each planned filter was asked for.

    ``plan`` is ``(query_id, column, op, value)``, the value a text or a list of
    texts; ``questions`` is ``(query_id, text)``; ``values`` is the distinct
    ``(column, value)`` of the table.  Every value must be in the question; without
    the column's name, each value must be found in cells of that column only; range
    operators must be worded.
    """
    listed = plan.schema["value"].dataType.typeName() == "array"
    asked = plan.withColumn("_values", F.col("value") if listed else F.array("value")).join(
        questions.select("query_id", _folded(F.col("text")).alias("_text")), "query_id"
    )
    single = asked.select("query_id", "column", "_text", F.explode("_values").alias("value")).distinct()
    held = _holding_columns(single, values)
    clear = (F.col("holders") == 1) & (F.col("holder") == F.col("column"))
    found = F.struct(
        F.coalesce(clear, F.lit(False)).alias("clear"), contains_literal(F.col("_text"), _folded(F.col("value"))).alias("said"))
    told = single.join(held, ["query_id", "column", "value"], "left").withColumn("_found", found).groupBy("query_id", "column").agg(
        F.map_from_entries(F.collect_list(F.struct("value", "_found"))).alias("_told")
    )
    text = F.col("_text")
    worded = F.lit(True)
    for op, words in config.FILTER_WORDS.items():
        worded = F.when(F.col("op") == op, text.rlike(words)).otherwise(worded)
    every = lambda field: F.forall("_values", lambda v: F.coalesce(F.try_element_at("_told", v)[field], F.lit(False)))
    requested = (F.size("_values") > 0) & every("said")
    verdict = (
        F.when(~requested, "unrequested_value")
        .when(~contains_literal(text, F.col("column")) & ~every("clear"), "ambiguous_column")
        .when(~worded, "unrequested_comparison")
        .otherwise("grounded")
    )
    return asked.join(told, ["query_id", "column"], "left").select(
        "query_id", "column", "op", "value", verdict.alias("verdict")
    )


def check_counts(aggregations: DataFrame, questions: DataFrame) -> DataFrame:
    """Whether the aggregations of each question answer a count that it asks for.

    ``aggregations`` is ``(query_id, op, column)``, the column null for all rows.  A
    count question needs a count; a count of one column's cells needs that column
    and a word for filled cells in the question.
    """
    asked = questions.select("query_id", _folded(F.col("text")).alias("_text")).withColumn(
        "_counts", F.col("_text").rlike(config.COUNT_QUESTION)
    )
    filled = contains_literal(F.col("_text"), F.col("column")) & F.col("_text").rlike(config.NOT_EMPTY_WORDS)
    joined = asked.join(aggregations, "query_id", "left").groupBy("query_id").agg(
        F.bool_or("_counts").alias("_asked"), F.coalesce(F.bool_or(F.col("op") == "count"), F.lit(False)).alias("_has"),
        F.coalesce(F.bool_or((F.col("op") == "count") & F.col("column").isNotNull() & ~filled), F.lit(False)).alias("_other"),
    )
    verdict = (
        F.when(~F.col("_asked"), "no_count").when(~F.col("_has"), "count_required")
        .when(F.col("_other"), "unrequested_column").otherwise("counted")
    )
    return joined.select("query_id", verdict.alias("verdict"))


def count_question(text: Column, title: Column | None = None, cells: Column | None = None) -> Column:
    """A plain 'how many rows' question: no condition, no cell value, nothing left over.

    ``title`` is the table's name, whose two-character pieces may stand in the
    question; ``cells`` an array of the table's values.
    """
    plain = text.rlike(config.COUNT_QUESTION) & ~text.rlike(config.CONDITION_WORDS)
    if cells is not None:
        plain = plain & ~F.exists(cells, lambda v: contains_literal(text, v))
    left = text
    if title is not None:
        pieces = F.filter(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(title) - 1, F.lit(1))), lambda i: F.substring(title, i, F.lit(2))),
            lambda piece: F.length(piece) == 2,
        )
        left = F.aggregate(pieces, left, lambda rest, piece: F.replace(rest, piece, F.lit(" ")))
    for word in sorted(config.COUNT_FILLERS, key=len, reverse=True):
        left = F.replace(left, F.lit(word), F.lit(" "))
    return plain & (F.regexp_replace(left, r"[\s\p{P}\p{S}]", "") == "")


# --- routing -----------------------------------------------------------------------

def route(queries: DataFrame) -> DataFrame:
    """Scores of the four channels per query and which of them are selected."""
    q = F.col("query")
    hits = [F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(q, w))) for _, words in config.SCENARIOS]
    scenario = reduce(lambda a, b: a + b, [F.when(h > 0, 8 + 6 * h).otherwise(0) for h in hits])
    question = q.rlike(config.QUESTION_HINT)
    scores = {
        "documents": 12 + F.when(q.rlike(config.DOCUMENT_HINT), 10).otherwise(0),
        "scenarios": scenario + F.when(q.rlike(config.SCENARIO_HINT) & (scenario < 8), 6).otherwise(0),
        "graph": F.when(q.rlike(config.GRAPH_HINT), 22).otherwise(0),
        "chat": F.when(question, 16).when(F.length(q) >= 12, 8).otherwise(0),
    }
    entry = lambda name, score: F.struct((-score).alias("order"), F.lit(name).alias("channel"), score.alias("score"))
    ranked = F.array_sort(F.array(*[entry(n, s) for n, s in scores.items()]))
    picked = F.slice(F.filter(ranked, lambda c: c["score"] >= 8), 1, 3)
    with_documents = F.when(
        F.exists(picked, lambda c: c["channel"] == "documents"), picked
    ).otherwise(F.concat(picked, F.filter(ranked, lambda c: c["channel"] == "documents")))
    chosen = F.transform(with_documents, lambda c: c["channel"])
    return queries.select(
        "query_id", *[s.cast("int").alias(f"{n}_score") for n, s in scores.items()],
        chosen.alias("channels"), F.element_at(chosen, 1).alias("primary_channel"),
    )
