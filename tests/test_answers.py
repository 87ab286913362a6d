"""Answer checks, grounding of planned filters and count questions: golden cases."""

import pytest
from pyspark.sql import functions as F

from loreloom.operators import answers, conversation


@pytest.mark.parametrize("answer, fine", [
    ("设备必须停机。根据《规程》[1]，应当检查，不得运行", False),
    ("根据《规程》[1]，应当检查，不得运行", True),
    ("资料。根据《规程》[1]，应当检查。", True),
    ("根据《规程》[1]，应当检查。还需要停机3天。", False),
    ("根据《规程》[1]，应当检查。还需要停机3天[2]。", True),
    ("[1]明确规定应当检查，不得运行", True),
    ("应当检查[1]。", True),
    ("应当检查[1]，不得运行", False),
    ("- 依据有关规定（第 3 条）[1]，须停机 2 小时", True),
])
def test_named_sources_cover_their_sentence_only(spark, answer, fine):
    df = spark.createDataFrame([(answer,)], "answer string")
    found = df.select(answers.uncited_lines(F.col("answer")).alias("u")).first()["u"]
    assert (found == []) is fine


def test_filters_are_grounded_in_cells(spark):
    plan = spark.createDataFrame(
        [(1, "line", "in", ["一号线", "二号线"]), (1, "line", "in", ["一号线", "三号线"]), (2, "line", "eq", ["一号"]), (3, "state", "eq", ["一号"]),
         (4, "n", "eq", ["Ａ"]), (5, "line", "in", [])],
        "query_id int, column string, op string, value array<string>",
    )
    questions = spark.createDataFrame(
        [(1, "一号线和二号线的设备"), (2, "一号的设备"), (3, "state 是一号的设备"), (4, "等级 a 的设备"), (5, "设备")], "query_id int, text string")
    values = spark.createDataFrame(
        [("line", "地铁一号线"), ("line", "地铁二号线"), ("state", "一号状态"), ("n", "a"), ("m", "abc")], "column string, value string")
    rows = [(r["query_id"], tuple(r["value"]), r["verdict"]) for r in answers.ground_filters(plan, questions, values).collect()]
    assert sorted(rows) == [
        (1, ("一号线", "三号线"), "unrequested_value"), (1, ("一号线", "二号线"), "grounded"), (2, ("一号",), "ambiguous_column"),
        (3, ("一号",), "grounded"), (4, ("Ａ",), "grounded"), (5, (), "unrequested_value"),
    ]


@pytest.mark.parametrize("text, plain", [
    ("请统计共有多少条记录", True), ("资产台账一共有多少条", True), ("一号线有多少条记录", False), ("2024年有多少条", False), ("资产有多少条，谁负责", False),
])
def test_plain_count_questions(spark, text, plain):
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(answers.count_question(F.col("t"), F.lit("资产台账"), F.array(F.lit("一号线"))).alias("c")).first()["c"]
    assert found is plain


def test_budget_is_the_length_of_the_json_list(spark):
    import json

    turns = [(1, i, "q" * 30 + "\"\n😀", "a" * (10 * i)) for i in range(1, 9)]
    df = spark.createDataFrame([(*t, False) for t in turns], "conv_id int, turn int, question string, answer string, cut boolean")
    for budget in (100, 400, 700, 5000):
        recent = [{"question": q, "answer": a} for _, _, q, a in turns[-6:]]
        size = lambda ts: len(json.dumps(ts, ensure_ascii=False, separators=(",", ":")).encode("utf-16-le")) // 2
        while len(recent) > 1 and size(recent) > budget:
            recent.pop(0)
        row = conversation.conversation_context(df, budget=budget).first()
        assert row["recent_turns"] == len(recent) and row["summary_turns"] == 8 - len(recent) and row["cut"] is False
    assert conversation.conversation_context(df, item_chars=5, budget=100).first()["cut"] is True


def test_clipped_turns_say_so(spark):
    rows = [(1, 0, "user", "x" * 20), (1, 1, "assistant", "fine"), (1, 2, "user", "short"), (1, 3, "assistant", "y" * 11)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    whole = {r["turn"]: (len(r["question"]), r["cut"]) for r in conversation.answered_turns(df).collect()}
    assert whole == {1: (20, False), 3: (5, False)}
    clipped = {r["turn"]: (len(r["question"]), len(r["answer"]), r["cut"]) for r in conversation.answered_turns(df, 10).collect()}
    assert clipped == {1: (10, 4, True), 3: (5, 10, True)}
