"""Cleaning, chunking and token queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreloom.functions import html, tables, text
from loreloom.operators import chunks
from loreloom.plans.registry import ORACLES, Tables, query
from loreloom.plans.sqltext import CHUNKS, sql_clean, sql_tokens
from loreloom.session import by_key


@query(
    "clean_text",
    f"SELECT doc_id, md5(c) AS clean_md5, length(c)::INT AS clean_chars FROM "
    f"(SELECT doc_id, {sql_clean('text')} AS c FROM documents)",
)
def clean_text(t: Tables):
    c = text.clean_text(F.col("text"))
    return t.spread("documents", "doc_id").select("doc_id", c.alias("c")).select(
        "doc_id", F.md5("c").alias("clean_md5"), F.length("c").alias("clean_chars")
    )


def _html_sql() -> str:
    e = r"regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g')"
    for tag in ("script", "style", "noscript", "template"):
        e = rf"regexp_replace({e}, '(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)', '', 'g')"
    for level in range(1, 7):
        e = rf"regexp_replace({e}, '(?i)<h{level}\b[^>]*>', chr(10) || '{'#' * level} ', 'g')"
    e = rf"regexp_replace({e}, '(?i)</(?:h[1-6]|p|div|section|article|header|footer|tr|li|ul|ol|table)>', chr(10), 'g')"
    e = rf"regexp_replace({e}, '(?i)<br\b[^>]*>', chr(10), 'g')"
    e = rf"regexp_replace({e}, '(?i)<li\b[^>]*>', chr(10) || '• ', 'g')"
    e = rf"regexp_replace({e}, '(?i)</(?:td|th)>', chr(9), 'g')"
    e = rf"regexp_replace({e}, '<[^>]*>', '', 'g')"
    from loreloom.config import HTML_ENTITIES

    for name, value in HTML_ENTITIES:
        quoted = value.replace("'", "''")
        e = f"regexp_replace({e}, '(?i)&{name};', '{quoted}', 'g')"
    e = f"regexp_replace({e}, '(?i)&amp;', '&', 'g')"
    return f"SELECT page_id, length(p)::INT AS chars, md5(p) AS text_md5 FROM (SELECT page_id, {sql_clean(e)} AS p FROM pages)"


@query("html_to_text", _html_sql())
def html_to_text(t: Tables):
    page = html.html_to_text(F.col("html"))
    return t.spread("pages", "page_id").select("page_id", page.alias("p")).select(
        "page_id", F.length("p").alias("chars"), F.md5("p").alias("text_md5")
    )


@query(
    "chunk_fixed",
    f"WITH {CHUNKS} SELECT doc_id, ordinal::INT AS ordinal, heading, length(chunk_text)::INT AS chars, "
    "md5(chunk_text) AS chunk_md5 FROM chunks",
)
def chunk_fixed(t: Tables):
    return chunks.chunk_documents(t.spread("documents", "doc_id")).select(
        "doc_id", "ordinal", "heading",
        F.length("chunk_text").alias("chars"), F.md5("chunk_text").alias("chunk_md5"),
    )


@query("chunk_sql", ORACLES["chunk_fixed"])
def chunk_sql(t: Tables):
    """The chunks of ``chunk_fixed`` by a table function."""
    tables.register(t.spark)
    return t.spark.sql(
        "SELECT d.doc_id, c.ordinal, c.heading, length(c.chunk_text) AS chars, md5(c.chunk_text) AS chunk_md5 "
        "FROM {documents} d, LATERAL chunk_text(d.text) c", documents=t.spread("documents", "doc_id"))


@query(
    "first_rows_sql",
    """SELECT o_custkey, o_orderkey, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 3""",
)
def first_rows_sql(t: Tables):
    """The first three orders of each customer by a table function over a partitioned table."""
    tables.register(t.spark)
    return t.spark.sql(
        "SELECT o_custkey, o_orderkey, rank FROM first_rows(TABLE(SELECT o_custkey, o_orderkey FROM {orders}), 'o_custkey', 'o_orderkey', 3)",
        orders=t.orders)


@query(
    "chunk_stats",
    f"WITH {CHUNKS} SELECT lang, count(*) AS chunks, count(DISTINCT doc_id) AS docs, "
    "max(length(chunk_text))::INT AS longest, sum(length(chunk_text))::BIGINT AS chars "
    "FROM chunks JOIN documents USING (doc_id) GROUP BY lang",
)
def chunk_stats(t: Tables):
    # One row per document first: the language rides along and no join is needed.
    per_doc = t.spread("documents", "doc_id").withColumn("id", F.struct("doc_id", "lang"))
    pieces = chunks.chunk_documents(per_doc, key="id")
    return (
        pieces.groupBy("id")
        .agg(
            F.count("*").alias("n"), F.max(F.length("chunk_text")).alias("longest"),
            F.sum(F.length("chunk_text")).alias("chars"),
        )
        .groupBy(F.col("id.lang").alias("lang"))
        .agg(
            F.sum("n").alias("chunks"), F.count("*").alias("docs"),
            F.max("longest").alias("longest"), F.sum("chars").alias("chars"),
        )
    )


@query(
    "token_df",
    f"""WITH tok AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY term""",
)
def token_df(t: Tables):
    # Texts travel, not their terms: a document's terms are counted where they arise.
    per_doc = (
        by_key(t.documents.select("doc_id", "text"), "doc_id")
        .select("doc_id", F.explode(text.tokenize(F.col("text"))).alias("term"))
        .groupBy("term", "doc_id")
        .agg(F.count("*").alias("tf"))
    )
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(
    "page_split",
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS page, md5({sql_clean('p')}) AS page_md5
    FROM (SELECT doc_id, unnest(string_split(text, chr(12))) AS p, generate_subscripts(string_split(text, chr(12)), 1) AS i FROM documents)""",
)
def page_split(t: Tables):
    return chunks.split_pages(t.spread("documents", "doc_id"), "doc_id", "text").select(
        "doc_id", "page", F.md5("page_text").alias("page_md5")
    )


@query(
    "size_rules",
    """SELECT doc_id, 1 AS page_count, 'text_too_long' AS rules FROM documents WHERE length(text) > 20000""",
)
def size_rules(t: Tables):
    found = chunks.limit_violations(t.spread("documents", "doc_id"), max_chars=20_000)
    return found.select("doc_id", "page_count", F.array_join("rules", ",").alias("rules"))
