"""Text functions and chunking on small fixtures, Han text included."""

from pyspark.sql import functions as F

from loreloom.functions import embedding, facts, html, text
from loreloom.operators import answers, chunks, conversation
from loreloom.operators.tables import column_letters, serial_date


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first()["r"]


def test_tokens_han_and_latin(spark):
    assert one(spark, "设备EQ-10 检修 A", text.tokenize) == ["eq-10", "a", "设备", "检修"]
    assert one(spark, "站", text.tokenize) == ["站"]
    assert one(spark, "äb", text.tokenize) == ["b"]
    assert one(spark, "äb", lambda c: text.tokenize(c, True)) == ["äb"]


def test_identifiers_need_a_digit(spark):
    assert one(spark, "see EQ-10, eq-10 and well-known a.b2", text.identifiers) == ["eq-10", "a.b2"]


def test_query_words_drop_stop_words(spark):
    assert one(spark, "请问设备检修多少 Pump", text.query_words) == ["pump", "设备检修"]


def test_common_phrase(spark):
    assert one(spark, "查询设备检修台账", lambda c: text.common_phrase_length(c, F.lit("年度设备检修记录"))) == 4
    assert one(spark, "abc", lambda c: text.common_phrase_length(c, F.lit("年度"))) == 0


def test_literals(spark):
    assert one(spark, "line A only", lambda c: text.contains_literal(c, F.lit("a"))) is True
    assert one(spark, "lineA", lambda c: text.contains_literal(c, F.lit("a"))) is False
    assert one(spark, "order EQ-1.", lambda c: text.mentions_code(c, F.lit("EQ-1"))) is False
    assert one(spark, "order EQ-1, done", lambda c: text.mentions_code(c, F.lit("EQ-1"))) is True


def test_html(spark):
    page = "<h2>A &amp;lt; B</h2><p>x&#65;&#xD800;&#38;lt;<br>y</p><script>no</script><ul><li>z</li></ul><!-- c"
    assert one(spark, page, html.html_to_text) == "## A &lt; B\nxA�&lt;\ny\n\n• z"


def test_chunks_cover_the_text(spark):
    source = "".join(chr(0x4E00 + i) for i in range(2800))
    df = spark.createDataFrame([(1, source)], "doc_id long, text string")
    parts = [r["chunk_text"] for r in chunks.chunk_documents(df).orderBy("ordinal").collect()]
    assert all(len(p) <= 1200 for p in parts)
    assert parts[0] + "".join(p[120:] for p in parts[1:]) == source


def plain_chunks(value):
    out, start = [], 0
    while start < len(value):
        end = min(len(value), start + 1200)
        if end < len(value):
            sample = value[start:end]
            cut = max([sample.rfind("\n")] + [sample.rfind(s) + 1 for s in ("。", "！", "？", ". ")])
            if cut > 600:
                end = start + cut
        if value[start:end].strip():
            out.append(value[start:end].strip())
        if end >= len(value):
            break
        start = max(start + 1, end - 120)
    return out


def test_chunks_match_a_plain_loop_on_long_text(spark):
    words = " ".join(f"word{i}." if i % 17 == 0 else f"word{i}" for i in range(9000))
    han = "检修。" * 4000
    df = spark.createDataFrame([(1, words), (2, han)], "doc_id long, text string").repartition(2)
    found = chunks.chunk_documents(df).orderBy("doc_id", "ordinal").collect()
    for key, value in ((1, words), (2, han)):
        assert [r["chunk_text"] for r in found if r["doc_id"] == key] == plain_chunks(value)


def test_sections_carry_headings(spark):
    df = spark.createDataFrame([(1, "intro\n# One\nbody\n## Two\nmore")], "doc_id long, text string")
    rows = chunks.chunk_documents(df).orderBy("ordinal").collect()
    assert [(r["heading"], r["chunk_text"]) for r in rows] == [("", "intro"), ("One", "# One\nbody"), ("Two", "## Two\nmore")]
    assert chunks.sections(df).count() == 3


def test_table_chunks_hold_whole_rows(spark):
    cells = [[f"EQ-{i:03d}", "x" * (40 + i)] for i in range(24)]
    df = spark.createDataFrame([("t", i + 1, i + 2, c) for i, c in enumerate(cells)], "t string, row_no int, source_no int, cells array<string>")
    found = chunks.chunk_tables(df, ["t"], F.lit("id\tnote"), F.lit("表格：demo"), size=400).orderBy("chunk").collect()
    assert len(found) > 1 and found[0]["row_start"] == 1 and found[-1]["row_end"] == 24
    assert all(a["row_end"] + 1 == b["row_start"] for a, b in zip(found, found[1:]))
    lines = [line.split("] ", 1)[1] for r in found for line in r["chunk_text"].split("\n")[2:]]
    assert lines == ["\t".join(c) for c in cells]
    assert chunks.oversized_tables(df, ["t"], max_rows=10).count() == 1
    # A table beyond the limit is packed in ranges; no row is lost.
    parts = chunks.chunk_tables(df, ["t"], F.lit("id\tnote"), F.lit("表格：demo"), size=400, max_rows=10).orderBy("chunk").collect()
    assert [r["chunk"] for r in parts] == list(range(1, len(parts) + 1)) and not any(r["within_limits"] for r in parts)
    assert [line.split("] ", 1)[1] for r in parts for line in r["chunk_text"].split("\n")[2:]] == lines
    assert all(r["within_limits"] for r in found)


def test_facts_and_masks(spark):
    assert one(spark, "每 7 天检查，不少于3次", facts.facts) == ["每7天", "不少于3次"]
    assert one(spark, "必须每7天", facts.masked) == "要求每#天"
    assert one(spark, "设备 DEV-101 与 ab_2x", facts.identities) == ["ab_2x", "设备dev-101"]
    assert one(spark, "ＡＢ，c  d！（", facts.normalize_block) == "ab,cd"
    assert one(spark, " Ａ  b ", facts.normalize_key) == "a b"


def test_serial_dates_and_letters(spark):
    row = spark.createDataFrame([(45000.25, 701)], "d double, i int").select(
        serial_date(F.col("d")), serial_date(F.lit(59)), serial_date(F.col("d"), time_only=True), column_letters(F.col("i")), column_letters(F.lit(702))
    ).first()
    assert tuple(row) == ("2023-03-15 06:00:00", "1900-02-28", "06:00:00", "ZZ", "AAA")


def test_condition_text_removes_titles(spark):
    out = one(spark, "已发布的《台账》中设备清单里A线多少条", lambda c: text.condition_text(c, F.array(F.lit("设备清单"))))
    assert "台账" not in out and "设备清单" not in out and "A线多少条" in out


def test_classifiers(spark):
    assert one(spark, "共有多少条记录", answers.count_question) is True
    assert one(spark, "大于3的有多少条", answers.count_question) is False
    assert one(spark, "那EQ呢", conversation.follow_up) is True


def test_excerpts_share_the_budget(spark):
    pages = F.array(*[F.struct(F.lit(i).alias("page"), F.repeat(F.lit(str(i)), 100).alias("text")) for i in (1, 2, 3, 4)])
    out = spark.range(1).select(text.sampled_excerpts(pages, 120).alias("e")).first()["e"]
    assert [r["text"] for r in out] == [str(i) * 21 + "\n[…]\n" + str(i) * 9 for i in (1, 2, 3, 4)]


def test_embedding_hook_gives_unit_vectors(spark):
    df = spark.createDataFrame([(i, f"word{i} and more") for i in range(70)], "id long, text string")
    rows = embedding.embed(df, ["id"], "text", "m", 16, embedding.hash_embedder(16)).collect()
    assert len(rows) == 70 and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-5 for r in rows)
