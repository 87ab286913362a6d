"""HTML to plain text, as a chain of expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreloom import config
from loreloom.functions.text import bind, clean_text

_CODED = r"(?i)&(amp|#x[0-9a-f]+|#[0-9]+);"


def _character(entity: Column) -> Column:
    """The character of ``amp``, ``#123`` or ``#x1f``; U+FFFD where there is none."""
    digits = F.substring(entity, 2, 2**30)
    code = F.when(
        digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 2**30), 16, 10).try_cast("decimal(20,0)")
    ).otherwise(digits.try_cast("decimal(38,0)"))
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    point = F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")
    return F.when(F.lower(entity) == "amp", "&").when(valid, point).otherwise("\ufffd")


def decode_entities(col: Column, numeric: bool = True) -> Column:
    """Decode the named entities of the fixed list, and numeric ones.

    ``&amp;`` is decoded in the last pass, so that what it yields stays as it is:
    the text is cut at the remaining entities and put together with their
    characters.  Pass ``numeric=False`` where the text has no numeric ones.
    """
    text = col
    for name, value in config.HTML_ENTITIES:
        text = F.regexp_replace(text, f"(?i)&{name};", value)
    if not numeric:
        return F.regexp_replace(text, "(?i)&amp;", "&")

    def joined(t: Column) -> Column:
        between = F.split(t, _CODED)
        characters = F.transform(F.regexp_extract_all(t, F.lit(_CODED), F.lit(1)), _character)
        return F.concat_ws("", F.flatten(F.zip_with(between, characters, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))

    return bind(text, lambda t: F.when(t.rlike(_CODED), joined(t)).otherwise(t))


def html_to_text(col: Column, numeric: bool = True) -> Column:
    """Visible text: blocks become lines, headings ``#`` lines, list items bullets."""
    text = F.regexp_replace(col, r"(?s)<!--.*?(?:-->|\z)", "")
    text = F.regexp_replace(
        text, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\z)", ""
    )
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?i)<h{level}\b[^>]*>", "\n" + "#" * level + " ")
    text = F.regexp_replace(
        text, r"(?i)</(?:h[1-6]|p|div|section|article|header|footer|tr|li|ul|ol|table)>", "\n"
    )
    text = F.regexp_replace(text, r"(?i)<br\b[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?i)<li\b[^>]*>", "\n• ")
    text = F.regexp_replace(text, r"(?i)</(?:td|th)>", "\t")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    return clean_text(decode_entities(text, numeric))
