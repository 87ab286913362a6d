"""Chat formatting of typed content parts.

A visitor walks the parts of a turn in order.  Text parts become escaped text;
image, audio and document parts become numbered placeholders, their references
and the number of tokens they expand to are recorded.  Turns are formatted row
by row; a conversation is the concatenation of its turns, and its loss mask is
the list of spans of assistant texts in it.

Control strings start with ``<|``.  Inside texts one backslash is put between
``<`` and ``|`` (and one more where backslashes already stand there), so no
text can hold a control string and reading back takes one backslash out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import text_rows

PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT_TYPE = "struct<number:int,type:string,ref:string,tokens:long>"
START, STOP = "<|im_start|>", "<|im_end|>"
#: Tokens that attachments expand to: pixels on a side of one image patch,
#: tokens per second of audio, tokens per page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25.0, 1024

_MAKES_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED_CONTROL = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _MAKES_CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED_CONTROL.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles stand on a line of their own."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class PartVisitor:
    """Flattens the parts of one turn; ``result()`` and ``attachments`` hold what it found.

    Neighbouring text parts are joined before they are escaped: no control
    string can arise between them.
    """

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.plain: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        handler = {
            "image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document,
        }.get(part["type"], self.visit_text)
        handler(part)

    def visit_text(self, part: dict) -> None:
        self.plain.append(part["text"] or "")

    def visit_image(self, part: dict) -> None:
        tokens = math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH)
        self.attach("image", part, tokens)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part["seconds"] or 0.0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part["pages"] or 0) * PAGE_TOKENS)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.flush()
        number = len(self.attachments) + 1
        self.attachments.append({"number": number, "type": kind, "ref": part["ref"], "tokens": tokens})
        self.pieces.append(f"<|{kind}:{number}|>")

    def flush(self) -> None:
        self.pieces.append(escape("".join(self.plain)))
        self.plain = []

    def result(self) -> str:
        self.flush()
        return "".join(self.pieces)


def format_batches(batches: Iterator[pd.DataFrame]):
    for batch in batches:
        texts, attachments = [], []
        for parts in batch["parts"]:
            visitor = PartVisitor()
            for part in parts if parts is not None else ():
                visitor.visit(part)
            texts.append(visitor.result())
            attachments.append(visitor.attachments)
        roles = [escape_role(role or "") for role in batch["role"]]
        yield pd.DataFrame({
            "conv_id": batch["conv_id"], "turn": batch["turn"],
            "head": [f"{START}{role}\n" for role in roles], "body": texts,
            "learned": [role == "assistant" for role in batch["role"]], "attachments": attachments,
        })


def text_part(text: Column) -> Column:
    """A text as the only part of a turn (null: empty)."""
    null = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"),
        null.cast("int").alias("width"), null.cast("int").alias("height"),
        null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
    ).cast(PART_TYPE))


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn of ``turns`` (conv_id, turn, role, parts): its head, body, ``learned``, attachments.

    Null parts give an empty body, null roles an empty role.  A part of an
    unknown type counts as text.  Long texts are read whole.
    """
    kinds = dict(turns.dtypes)
    return text_rows(turns).select("conv_id", "turn", "role", "parts").mapInPandas(
        format_batches,
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, head string, body string, learned boolean, "
        f"attachments array<{ATTACHMENT_TYPE}>",
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, attachments, attachment_tokens.

    * Turns are ordered by (turn, head, body), null turns first: equal numbers
      have a defined order, repeated rows are repeated turns.
    * ``loss_spans`` are (start, end) in code points of ``formatted``: the body
      of each assistant turn.
    * A null conv_id is a conversation of its own.  An empty table gives no
      rows.  Columns other than the four are not read.  A conversation is one
      record, so its turns meet in one row.
    """
    rows = format_turns(turns)
    listed = F.array_sort(F.collect_list(F.struct("turn", "head", "body", "learned", "attachments")))
    grouped = rows.groupBy("conv_id").agg(listed.alias("t"))
    pieces = F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(STOP + "\n")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            (end + len(STOP) + 1).cast("long").alias("at"),
            F.when(t["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    attachments = F.flatten(F.transform("t", lambda t: t["attachments"]))
    return grouped.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(pieces, "").alias("formatted"),
        F.aggregate("t", zero, step)["spans"].alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation; placeholders stay in the text."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def formatted_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, formatted, loss_start, loss_end, attachments; conversations of any length.

    A conversation is the concatenation of its rows in the order of
    ``format_conversations``, null turns first.  The loss span (code points of ``formatted``) is empty for turns
    that are not the assistant's.
    """
    start = F.length("head")
    return format_turns(turns).select(
        "conv_id", "turn", F.concat("head", "body", F.lit(STOP + "\n")).alias("formatted"), start.alias("loss_start"),
        F.when(F.col("learned"), start + F.length("body")).otherwise(start).alias("loss_end"), "attachments",
    )


class Digests:
    """What is read back from the turns of one conversation, fed one after the other."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted: str, loss_start: int, loss_end: int) -> None:
        for role, text in read_turns(formatted):
            self.turns += 1
            self.whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        learned = unescape(formatted[loss_start:loss_end])
        self.loss_chars += len(learned)
        self.chars += len(formatted)
        self.loss.update(learned.encode("utf-8", "surrogatepass"))

    def row(self, key: str | None) -> tuple:
        return key, self.turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest_turns(batches: Iterator[pd.DataFrame]):
    """Digests of conversations whose turns come in order; a conversation may go on in the next batch."""
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, held = None, None
    for batch in batches:
        done = []
        for key, *turn in zip(batch["key"], batch["formatted"], batch["loss_start"], batch["loss_end"]):
            if held is None or key != now:
                done += [held.row(now)] if held else []
                now, held = key, Digests()
            held.feed(*turn)
        yield pd.DataFrame(done, columns=names)
    if held:
        yield pd.DataFrame([held.row(now)], columns=names)


def read_back_turns(turns: DataFrame) -> DataFrame:
    """Digests of the turns and of the learned text, read back from ``formatted_turns``: a row per conversation.

    The turns of a conversation are sorted (Spark spills) and fed to the digests
    one by one, so memory does not grow with a conversation.  A digest runs from
    the first turn to the last: one task reads a conversation, and nothing else
    is done there.
    """
    kind = dict(turns.dtypes)["conv_id"]
    head, body = F.expr("substring(formatted, 1, loss_start)"), F.expr(
        f"substring(formatted, loss_start + 1, length(formatted) - loss_start - {len(STOP) + 1})")
    ordered = text_rows(turns).select(
        F.col("conv_id").cast("string").alias("key"), "turn", "formatted", "loss_start", "loss_end"
    ).repartition("key").sortWithinPartitions("key", "turn", head, body)
    return ordered.drop("turn").mapInPandas(
        digest_turns, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    ).withColumn("conv_id", F.col("key").cast(kind)).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def digest_batches(batches: Iterator[pd.DataFrame]):
    for batch in batches:
        rows = []
        for conv_id, formatted, spans in zip(batch["conv_id"], batch["formatted"], batch["loss_spans"]):
            turns = read_turns(formatted)
            whole = hashlib.sha256()
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            loss = "".join(unescape(formatted[s["start"]:s["end"]]) for s in spans)
            rows.append((
                conv_id, len(turns), whole.hexdigest(), len(loss),
                hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(formatted),
            ))
        yield pd.DataFrame(rows, columns=[
            "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the learned text, read back from ``format_conversations``."""
    kind = dict(formatted.dtypes)["conv_id"]
    return text_rows(formatted).select("conv_id", "formatted", "loss_spans").mapInPandas(
        digest_batches,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
