"""Text expressions: cleaning, tokens, identifiers, phrases.

Every function takes and returns ``Column`` and stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom import config


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``use`` (a let inside an expression)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(col: Column) -> Column:
    """Trim Unicode blanks at both ends."""
    return F.btrim(col, F.lit(config.BLANKS))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")


def clip(col: Column, length: int) -> Column:
    return F.substring(strip(col), 1, length)


def clean_text(col: Column) -> Column:
    """Unify line ends, drop control characters and surplus blanks and blank lines."""
    unified = F.regexp_replace(col, r"\r\n?", "\n")
    printable = F.regexp_replace(unified, r"[\x00-\x08\x0b\x0e-\x1f]", "")
    tight = F.regexp_replace(printable, r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(tight, r"\n{4,}", "\n\n\n"))


def _han_bigrams(run: Column) -> Column:
    # sequence(1, 0) counts down, so runs of one character are kept apart.
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))),
        lambda i: F.substring(run, i, F.lit(2)),
    )
    return F.when(F.length(run) == 1, F.array(run)).otherwise(pairs)


def han_terms(col: Column) -> Column:
    runs = F.regexp_extract_all(col, F.lit(config.HAN_RUN), F.lit(1))
    return F.flatten(F.transform(runs, _han_bigrams))


def tokenize(col: Column, unicode_words: bool = False) -> Column:
    """Search tokens: lower-case words with inner ``- _ .``, and Han bigrams.

    Words are ASCII; ``unicode_words`` also keeps accented letters together.
    """
    text = F.lower(col)
    pattern = config.WORD_PATTERN
    if unicode_words:
        word = r"[\p{L}\p{N}&&[^\p{IsHan}]]+"
        pattern = f"({word}(?:[-_.]{word})*)"
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.concat(words, han_terms(text))


def identifiers(col: Column) -> Column:
    """Codes such as ``abc-12``: dashed words with a digit, once each."""
    found = F.regexp_extract_all(F.lower(col), F.lit(config.IDENTIFIER_PATTERN), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: w.rlike(r"\d")))


def query_words(col: Column, stop_words: tuple[str, ...] | list[str] = tuple(config.QUERY_STOP_WORDS)) -> Column:
    """Words of a question without stop words.

    Han text has no blanks and Spark no segmenter: stop words cut the Han runs
    and what remains is kept whole.
    """
    text = F.lower(col)
    han_stop = sorted((w for w in stop_words if not w.isascii()), key=len, reverse=True)
    runs = F.split(
        F.regexp_replace(
            F.regexp_replace(text, r"[^\p{IsHan}]+", " "), "|".join(han_stop) or "(?!)", " "
        ),
        " +",
    )
    words = F.regexp_extract_all(
        text, F.lit(r"([\p{L}\p{N}_&&[^\p{IsHan}]]+(?:['.’][\p{L}\p{N}_&&[^\p{IsHan}]]+)*)"), F.lit(1)
    )
    latin_stop = [w for w in stop_words if w.isascii()]
    if latin_stop:
        words = F.array_except(words, F.array(*[F.lit(w) for w in latin_stop]))
    return F.array_distinct(F.concat(words, F.filter(runs, lambda r: r != "")))


def significant_words(words: Column) -> Column:
    """Words long enough to carry a topic: 3 Han or 4 other characters."""
    return F.filter(
        words,
        lambda w: F.when(w.rlike(r"\p{IsHan}"), F.length(w) >= 3).otherwise(F.length(w) >= 4),
    )


def common_phrase_length(query: Column, title: Column, longest: int = 10) -> Column:
    """Length of the longest Han phrase (at most ``longest``) of a title found in the query."""
    runs = F.regexp_extract_all(title, F.lit(config.HAN_RUN), F.lit(1))

    def best(run: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(run))
        sizes = F.sequence(F.lit(1), F.least(F.length(run), F.lit(longest)))
        return F.array_max(
            F.transform(
                starts,
                lambda i: F.array_max(
                    F.transform(
                        sizes,
                        lambda n: F.when(
                            (i + n - 1 <= F.length(run)) & F.contains(query, F.substring(run, i, n)), n
                        ).otherwise(F.lit(0)),
                    )
                ),
            )
        )

    return F.coalesce(F.array_max(F.transform(runs, best)), F.lit(0))


def contains_literal(text: Column, value: Column) -> Column:
    """Literal containment; a single ASCII letter or digit must stand alone."""
    haystack, needle = F.lower(text), strip(F.lower(value))
    alone = F.concat(F.lit("(^|[^a-z0-9])"), needle, F.lit("($|[^a-z0-9])"))
    return (
        F.when((needle == "") | needle.isNull(), F.lit(False))
        .when(needle.rlike("^[a-z0-9]$"), F.regexp_like(haystack, alone))
        .otherwise(F.contains(haystack, needle))
    )


def mentions_code(text: Column, value: Column) -> Column:
    """A code is mentioned when no code character touches it; other names by containment."""
    haystack, needle = F.lower(text), strip(F.lower(value))
    escaped = F.regexp_replace(needle, r"([.\\+*?\[\]^$(){}=!<>|:\-])", r"\\$1")
    bounded = F.concat(F.lit("(^|[^a-z0-9_.-])"), escaped, F.lit("($|[^a-z0-9_.-])"))
    return (
        F.when(needle.isNull() | (F.length(needle) < 2), F.lit(False))
        .when(needle.rlike(r"^[a-z0-9_.-]+$"), F.regexp_like(haystack, bounded))
        .otherwise(F.contains(haystack, needle))
    )


def body_without_titles(text: Column, title: Column, heading: Column) -> Column:
    """Chunk text without heading lines and lines that repeat the title or heading."""
    lines = F.filter(
        F.split(text, "\n"),
        lambda line: ~(
            strip(line).rlike(r"^#{1,6}(?:[ \t]|$)")
            | (strip(line) == F.coalesce(title, F.lit("")))
            | (strip(line) == F.coalesce(heading, F.lit("\u0000")))
        ),
    )
    return F.array_join(lines, "\n")


def condition_text(question: Column, titles: Column) -> Column:
    """The question without status phrases, quoted titles and the given titles."""
    text = F.regexp_replace(
        question,
        r"(?:已发布|已生效|现行|有效|已审核)(?:的)?\s*(?=《|文档|文件|资料|知识库|表格|数据表|台账)",
        " ",
    )
    text = F.regexp_replace(text, "《[^》]*》", " ")
    return F.aggregate(titles, text, lambda acc, t: F.when(t != "", F.replace(acc, t, F.lit(" "))).otherwise(acc))


def sampled_excerpts(pages: Column, budget: int = 16000) -> Column:
    """Head (70%) and tail (30%) of each page under an equal per-page budget.

    ``pages`` is ``array<struct<page:int,text:string>>`` in page order.
    """
    filled = F.filter(pages, lambda p: ~is_blank(p["text"]))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.size(filled))).cast("int")

    def excerpt(p: Column, i: Column) -> Column:
        limit = F.least(per_page, F.greatest(F.lit(0), F.lit(budget) - i * per_page))
        head = F.ceil(limit * F.lit(0.7)).cast("int")
        tail = limit - head
        cut = F.concat(
            F.substring(p["text"], F.lit(1), head),
            F.when(tail > 0, F.concat(F.lit("\n[…]\n"), F.right(p["text"], tail))).otherwise(F.lit("")),
        )
        text = F.when(F.length(p["text"]) > limit, cut).otherwise(p["text"])
        return F.struct(p["page"].alias("page"), text.alias("text"))

    return F.filter(
        F.transform(filled, excerpt), lambda p: F.length(p["text"]) > 0
    )
