"""Context carried over between the turns of a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loreloom import config
from loreloom.functions.text import strip
from loreloom.operators.ordered import number_rows


def object_ids(col: Column) -> Column:
    """Codes with a digit as written, once each."""
    pattern = r"(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)+)(?![A-Za-z0-9_])"
    return F.array_distinct(F.filter(F.regexp_extract_all(col, F.lit(pattern), F.lit(1)), lambda w: w.rlike(r"\d")))


def ordered_messages(
    messages: DataFrame, conversation: str, sequence: str, created: str | None = None, key: str | None = None, bucket: int = 1000
) -> DataFrame:
    """``place`` of every message in its conversation: by sequence, questions before answers.

    A missing sequence counts as 0; ``created`` and then ``key`` decide between
    equal places.  Long conversations are numbered in buckets of the sequence, not
    in one task.
    """
    number = F.coalesce(F.col(sequence), F.lit(0))
    order = [number, F.when(F.col("role") == "user", 0).otherwise(1), *[F.col(c) for c in (created, key) if c]]
    return number_rows(messages, [conversation], order, F.floor(number / bucket), "place")


def answered_turns(messages: DataFrame, chars: int | None = None) -> DataFrame:
    """Pairs of a question and the next answer: ``(conv_id, turn, question, answer, cut)``.

    ``messages`` is ``(conv_id, turn, role, text)``; the answer follows its question
    directly, so the pair is an equi-join on the turn number.  With ``chars`` texts
    are clipped to that length and ``cut`` tells which pairs were.
    """
    asked = messages.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), strip(F.col("text")).alias("_asked"))
    said = messages.filter("role = 'assistant'").select("conv_id", "turn", strip(F.col("text")).alias("_said"))
    pairs = said.join(asked, ["conv_id", "turn"]).filter("_asked <> ''")
    limit = lambda c: F.col(c) if chars is None else F.substring(c, 1, chars)
    cut = F.lit(False) if chars is None else (F.length("_asked") > chars) | (F.length("_said") > chars)
    return pairs.select("conv_id", "turn", limit("_asked").alias("question"), limit("_said").alias("answer"), cut.alias("cut"))


def turn_length(question: str, answer: str) -> Column:
    """Length of a turn in the JSON list of turns, in UTF-16 units, its separator included."""
    text = F.to_json(F.struct(F.col(question).alias("question"), F.col(answer).alias("answer")))
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]")) + 1


def conversation_context(
    turns: DataFrame, recent: int = 6, older: int = 24, budget: int = 6000,
    item_chars: int | None = None, summary_chars: int | None = None,
) -> DataFrame:
    """The last turns that fit the budget, the ones before as a summary.

    The budget is the length of the JSON list of the turns.  At most ``recent +
    older`` turns per conversation are kept before they are gathered.  The oldest
    recent turns move to the summary until the rest fits; the newest one always
    stays.  ``item_chars`` clips each summarised question, ``summary_chars`` keeps
    the end of the summary; ``cut`` tells whether either did.
    """
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = turns.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= recent + older)
    running = newest.rowsBetween(W.unboundedPreceding, W.currentRow)
    # The list adds one bracket more than its separators.
    used = F.sum(turn_length("question", "answer")).over(running) + 1
    fits = (F.col("_n") == 1) | ((F.col("_n") <= recent) & (F.col("_used") <= budget))
    placed = last.withColumn("_used", used).withColumn("_recent", fits)
    clipped = F.col("question") if item_chars is None else F.substring("question", 1, item_chars)
    long = F.lit(False) if item_chars is None else ~F.col("_recent") & (F.length("question") > item_chars)
    grouped = placed.groupBy("conv_id").agg(
        F.count_if("_recent").alias("recent_turns"),
        F.count_if(~F.col("_recent")).alias("summary_turns"),
        F.max_by("question", "turn").alias("last_question"), F.bool_or(long).alias("_long"),
        F.array_sort(F.collect_list(F.when(F.col("_recent"), F.struct("turn", F.col("question").alias("q"))))).alias("_turns"),
        F.array_sort(F.collect_list(F.when(~F.col("_recent"), F.struct("turn", clipped.alias("q"))))).alias("_older"),
    ).withColumn("_all", F.array_join(F.transform("_older", lambda t: t["q"]), "\n"))
    whole = F.lit(False) if summary_chars is None else F.length("_all") > summary_chars
    return grouped.select(
        "conv_id", "recent_turns", "summary_turns", "last_question",
        (F.col("_all") if summary_chars is None else F.right("_all", F.lit(summary_chars))).alias("conditions"),
        object_ids(F.array_join(F.transform("_turns", lambda t: t["q"]), " ")).alias("object_ids"),
        (F.col("_long") | whole).alias("cut"),
    )


def follow_up(question: Column) -> Column:
    return question.rlike(config.FOLLOW_UP)


def rewrite_question(contexts: DataFrame, questions: DataFrame) -> DataFrame:
    """The question with the object or question it refers to, or a request to clarify.

    ``questions`` is ``(conv_id, question)``.
    """
    joined = questions.join(contexts, "conv_id", "left")
    named = object_ids(F.col("question"))
    follows = follow_up(F.col("question")) & (F.size(named) == 0)
    objects = F.coalesce("object_ids", F.array().cast("array<string>"))
    carried = F.when(
        F.size(objects) > 0, F.concat(F.element_at(objects, 1), F.lit("，"), F.col("question"))
    ).otherwise(F.concat(F.col("last_question"), F.lit("；追问："), F.col("question")))
    has_turns = F.coalesce(F.col("recent_turns") > 0, F.lit(False))
    state = (
        F.when(follows & ~has_turns, "context_missing").when(follows & (F.size(objects) > 1), "ambiguous")
        .when(follows, "follow_up").otherwise("standalone")
    )
    return joined.select(
        "conv_id", "question", state.alias("state"),
        F.when(state == "follow_up", carried).otherwise(F.col("question")).alias("query"),
    )
