"""Secret scan: fixed patterns, and the guess cost of values in credential context.

A value that stands where a password would stand (after a key word and a
separator, after ``Bearer``, before ``@`` in a URL) is cut into dictionary
words, dates, repeats, keyboard walks and brute-force spans so that the product
of their guess counts is least (dynamic programming over positions, in bits).
Values that cost at least ``LEAST_BITS`` are reported as ``guess``: guessable
ones such as ``Password2024`` are not.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import text_rows

#: Kinds in the order of the listing; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Without one of these a text holds no credential context.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "://")
CONTEXTS = (
    re.compile(
        r"""(?ai)(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|auth)[_-]?key|credentials?)"""
        r"""["']?\x20*(?:=>|:=|[:=])\x20*["']?([^\s"'<>,;]{6,})"""
    ),
    re.compile(r"(?ai)\bbearer\x20+([A-Za-z0-9+/_.=~-]{6,})"),
    re.compile(r"(?a)://[^\s/:@]*+:([^\s/@]{6,})@"),
)
#: Random values of 8 letters of both cases and digits cost 48.6 bits, the keyboard's longest plain walks 15.
LEAST_BITS = 47.0
#: Words that password guessers try first, most common first.
WORDS = (
    "password passwd pass admin root user login welcome letmein qwerty monkey dragon master shadow "
    "sunshine princess football baseball superman batman trustno iloveyou hello freedom whatever "
    "charlie michael jordan hunter ranger buster soccer hockey killer george thomas robert daniel "
    "secret token key api test testing demo example sample default changeme change temp guest "
    "public private server database access system computer internet service account manager "
    "summer winter spring autumn monday friday january february march april june july august "
    "september october november december love money star blue black white green orange purple "
    "the this that your name home work mail email phone null none true false value string "
    "required optional hidden placeholder your_token your_password xxx foo bar baz abc"
).split()
RANKS = {word: rank for rank, word in enumerate(WORDS, start=1)}
LONGEST_WORD = max(map(len, WORDS))
LEET = str.maketrans("@4830!1$57", "aabeoiists")
#: The rows of the usual keyboard; a key touches the key above and the next one to the right of that.
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def key_steps() -> dict[tuple[str, str], str]:
    """The direction of each step between neighbouring keys, and between neighbours of the alphabet."""
    steps = {(a, b): "next" for a, b in zip(ALPHABET, ALPHABET[1:])} | {(b, a): "before" for a, b in zip(ALPHABET, ALPHABET[1:])}
    for row in KEY_ROWS:
        steps |= {(a, b): "right" for a, b in zip(row, row[1:])} | {(b, a): "left" for a, b in zip(row, row[1:])}
    for upper, lower in zip(KEY_ROWS, KEY_ROWS[1:]):
        for at, key in enumerate(lower):
            for shift, way in ((0, "up"), (1, "up right")):
                if at + shift < len(upper):
                    steps[key, upper[at + shift]] = way
                    steps[upper[at + shift], key] = "down" if way == "up" else "down left"
    return steps


NEXT = key_steps()
#: Keys a walk may begin with, and ways it may turn to.
KEYS, TURNS = 47, 6
DATE = re.compile(
    r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?"
    r"|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d"
)
SEGMENT_BITS = 1.0
CLASSES = ((re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[0-9]"), 10))
OTHER_SIGNS = 33


def alphabet(value: str) -> int:
    """Number of characters that a brute-force attack on ``value`` tries per place."""
    size = sum(n for pattern, n in CLASSES if pattern.search(value))
    return size + (OTHER_SIGNS if re.search(r"[^A-Za-z0-9]", value) else 0)


def runs(value: str, lower: str) -> tuple[list[int], list[int], list[int]]:
    """For every position the end of the repeat and of the walk that begin there, and the turns before it in its walk.

    From right to left, so a value of any length is looked at once.
    """
    size = len(value)
    repeat, walk, turns = list(range(1, size + 1)), list(range(1, size + 1)), [0] * (size + 1)
    for at in range(size - 2, -1, -1):
        if value[at] == value[at + 1]:
            repeat[at] = repeat[at + 1]
        if (lower[at], lower[at + 1]) in NEXT:
            walk[at] = walk[at + 1]
    for at in range(2, size):
        ways = NEXT.get((lower[at - 2], lower[at - 1])), NEXT.get((lower[at - 1], lower[at]))
        turns[at] = turns[at - 1] + (ways[0] != ways[1])
    turns[size] = turns[size - 1] if size else 0
    return repeat, walk, turns


def spans_from(
    value: str, lower: str, plain: str, start: int, of: tuple[list[int], list[int], list[int]] | None = None
) -> Iterator[tuple[int, float]]:
    """(end, bits) of the word, date, repeat and walk segments that begin at ``start``; ``of`` are the ``runs`` of the value."""
    for end in range(start + 3, min(len(value), start + LONGEST_WORD) + 1):
        rank = RANKS.get(lower[start:end])
        swapped = rank is None
        rank = RANKS.get(plain[start:end]) if swapped else rank
        if rank is not None:
            mixed_case = not (value[start:end].islower() or value[start:end].isdigit())
            yield end, math.log2(rank + 1) + (1.0 if mixed_case else 0.0) + (2.0 if swapped else 0.0)
    date = DATE.match(value, start)
    if date:
        days = 7.0 if date.end() - start == 4 else math.log2(200 * 366) + 1.0
        yield date.end(), days
    repeat, walk, turns = of or runs(value, lower)
    if repeat[start] - start >= 3:
        yield repeat[start], math.log2(95) + math.log2(repeat[start] - start)
    if walk[start] - start >= 3:
        made = turns[walk[start] - 1] - turns[start + 1]
        yield walk[start], math.log2(KEYS) + math.log2(walk[start] - start) + made * math.log2(TURNS) + 1.0


def guess_bits(value: str) -> float:
    """Logarithm of the least number of guesses over all segmentations of ``value``."""
    lower = value.lower()
    plain = lower.translate(LEET)
    if len(lower) != len(value):  # a letter whose lower case is longer
        lower = plain = value
    per_char = math.log2(max(alphabet(value), 2))
    best = [0.0] + [math.inf] * len(value)
    # A brute-force span grows by one character: its own state, so that it pays SEGMENT_BITS once.
    brute = math.inf
    of = runs(value, lower)
    for at in range(len(value)):
        brute = min(brute, best[at] + SEGMENT_BITS) + per_char
        for end, bits in spans_from(value, lower, plain, at, of):
            best[end] = min(best[end], best[at] + bits + SEGMENT_BITS)
        best[at + 1] = min(best[at + 1], brute)
    # The whole may be a unit said several times.
    unit = (value + value).find(value, 1)
    if value and unit < len(value) and unit * 2 <= len(value):
        best[-1] = min(best[-1], guess_bits(value[:unit]) + math.log2(len(value) // unit) + SEGMENT_BITS)
    return best[-1]


def scan(text: str, least_bits: float = LEAST_BITS) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, bits) of all spans of ``text``, sorted."""
    found: list[tuple[int, int, int, float | None]] = [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    lower = text.lower()
    if any(hint in lower for hint in HINTS):
        found += [(m.start(), 0, m.end(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        values = {m.span(1) for pattern in CONTEXTS for m in pattern.finditer(text)}
        for start, end in values:
            bits = guess_bits(text[start:end])
            if bits >= least_bits:
                found.append((start, 3, end, bits))
    return sorted(found, key=lambda span: span[:3])


def scan_batches(batches: Iterator[pd.DataFrame], least_bits: float):
    for batch in batches:
        spans = [
            [{"kind": KINDS[k], "start": s, "end": e, "bits": b} for s, k, e, b in scan(text or "", least_bits)]
            for text in batch["text"]
        ]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": spans})


def scan_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bits: float = LEAST_BITS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans array of (kind, start, end, bits).

    * Positions are code points, end exclusive; spans are sorted by start, then
      kind (assign, access, hex, guess).  ``bits`` is the guess cost of a
      ``guess`` span, null for the base patterns, which hold at any cost.
    * Null and empty texts have no spans; whole texts are read, of any length.
      Repeated rows give a row each; an empty table gives no rows; other
      columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    return text_rows(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        lambda batches: scan_batches(batches, least_bits),
        f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,bits:double>>",
    )


def listing(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    ), ",")
