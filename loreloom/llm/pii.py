"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field labels the tokens of a text (inside each kind, or outside) from the shapes of a token and its neighbours.  It is trained on a small
labelled table: lines made from templates, and windows of some texts where only
what the patterns match is personal.  Texts are decoded by Viterbi in numpy
batches.  What the patterns find stays; the field adds names, addresses, and
phone numbers and e-mail addresses in forms that the patterns do not know.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.llm.common import text_rows

#: Kinds of the patterns, then those that the field adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "address", "phone_like", "email_like")
KINDS = BASE + ADDED
#: Lines made from templates, windows of texts, and characters of a window: the bound of the labelled table.
MADE_LINES, WINDOWS, WINDOW = 1200, 300, 400
SEED = 11
ROUNDS, RATE, DECAY = 50, 0.25, 2e-4
#: What the score of a token outside is raised by: with it 1 of 10,000 documents without names gets a name.
CAUTION = 0.3


# Patterns.

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Doubled digits of a card number, with the digits of the result added.
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans of a local part, ``@`` and a domain with a dot; every character is looked at a few times at most."""
    done = 0
    at = text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def luhn(digits: Sequence[int]) -> bool:
    doubled = sum(_DOUBLED[d] for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + doubled) % 10 == 0


def is_card(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    return 14 <= len(digits) <= 19 and luhn(digits)


def is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def is_phone(text: str) -> bool:
    return 10 <= sum(c.isdigit() for c in text) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns match, sorted."""
    found = [(start, 0, end) for start, end in emails(text)]
    for kind, pattern, holds in ((1, _IP, is_ip), (2, _CARD, is_card), (3, _PHONE, is_phone)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if holds(m[0])]
    return sorted(found)


# The labelled table.

# What the lines of the labelled table are made from.
FIRST_NAMES = (
    "Anna Ben Carla David Elena Frank Greta Hugo Ines Jonas Karin Louis Maria Noah Olivia Paul Rosa Simon Tanja Victor "
    "Alice Bruno Claire Diego Emma Felix Gloria Henri Irene Jacob Laura Marco Nina Oscar Petra Ralph Sofia Thomas Ursula Walter"
).split()
LAST_NAMES = (
    "Adams Becker Castillo Dupont Evans Fischer Garcia Hoffmann Iglesias Johnson Keller Lambert Martin Navarro Olsen Parker "
    "Quinn Richter Schmidt Torres Ullman Vidal Weber Young Zimmer Bernard Campbell Delgado Fontaine Gruber Herrera Jansen "
    "Kowalski Leroy Mercier Nowak Ortega Peterson Rossi Stewart"
).split()
PLACES = "Maple Garden Station Linden Schiller Church Victoria Mill Park Oak Goethe Moulin Sol Mayor Roosevelt Lake Rosen Birken".split()
CITIES = "Berlin Paris Madrid London Boston Lyon Hamburg Sevilla Leeds Vienna".split()
#: Words that keep a feature of their own although they stand inside addresses.
CUES = frozenset("street road avenue lane square straße strasse platz weg allee rue boulevard calle avenida plaza at dot".split())
TEMPLATES = (
    "My name is {name}.", "My name is {name} and I live at {address}.", "I am {name}, born in {city}.", "Dear Mr. {last},",
    "Dear Mrs. {name},", "Contact {name} by phone: {phone_like}", "Please call {phone_like} after six.", "call me on {phone_like}",
    "Tel. {phone_like}", "phone {phone_like}, ask for {name}", "Signed, {name}", "Kind regards, {name}", "Dr. {name} will see you now.",
    "write to {email_like} or to {email}", "mail: {email_like}", "Reach me at {email} or {phone}.", "Customer: {name}, {address}",
    "Ship it to {name}, {address}.", "Address: {address}", "lives at {address} in {city}", "card {card} of {name}", "pay with {card} today",
    "login of {name} from {ip}", "host {ip} refused the connection", "patient {name}, phone {phone}", "Name: {name}", "name = {name}",
    "Ich heiße {name} und wohne in der {address}.", "Mein Name ist {name}.", "Sehr geehrter Herr {last},", "Sehr geehrte Frau {last},",
    "Rufen Sie {phone_like} an.", "Telefon: {phone_like}", "Anschrift: {address}, {city}", "Mit freundlichen Grüßen, {name}",
    "Je m'appelle {name} et j'habite {address}.", "Mon nom est {name}.", "Madame {last} habite {address}.", "Monsieur {name} est absent.",
    "Tél. {phone_like}", "Appelez le {phone_like} demain", "Adresse : {address}, {city}", "Me llamo {name} y vivo en {address}.",
    "Mi nombre es {name}.", "Señor {last}, llame al {phone_like}.", "Teléfono: {phone_like}", "Dirección: {address}, {city}",
    # Lines without personal data.
    "Version {version} came out in May {year}.", "Order {number} has {small} items.", "The Old {place} Museum in {city} opens on Monday.",
    "Chapter {small}: The {place} House", "Page {small} of {number}", "In {year}, {number} people lived in {city}.", "A total of {number}.{small} was paid.",
    "The {place} Party met in {city} on {small} May {year}.", "See {place} {small} and {place} {small}.", "On {year}-{small}-{small} at {small}:{small}",
    "The name of the game is chess.", "please call the function twice", "the phone is new and the street is long", "Mr. and Mrs. are titles.",
    "Der Name der Straße ist lang.", "Im Jahr {year} kamen {number} Gäste nach {city}.", "Le nom de la rue est long.", "La calle es larga y el nombre corto.",
    "isbn {number}-{small}-{number}", "{small}.{small} times {number}", "He said it at dot four, at least.", "Serial {number} {number} {number} {number}",
    "{again}", "{again} {again}", "id {hex} and {hex}", "key = \"{hex}\"", "under the General Public License", "A Copy Of The {place} Licence", "The And For. Then Of The In!", "THE END OF {place} WAS NEAR", "Dear all, Call now.", "Contact Sales Today", "phone: none, name: unknown, address: missing",
)


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _made(rng: random.Random, slot: str, first: Sequence[str], last: Sequence[str]) -> str:
    """A value for a slot of a template."""
    if slot == "name":
        middle = rng.choice(["", "", f"{rng.choice('ABCDEFGHJKLMPRST')}. ", rng.choice(first) + " "])
        return f"{rng.choice(first)} {middle}{rng.choice(last)}" if rng.random() < 0.9 else f"{rng.choice(last)}-{rng.choice(last)}"
    if slot == "last":
        return rng.choice(last)
    if slot == "address":
        place, number = rng.choice(PLACES), rng.randint(1, 250)
        return rng.choice([
            f"{number} {place} {rng.choice(['Street', 'Road', 'Avenue', 'Lane', 'Square'])}",
            f"{place}{rng.choice(['straße', 'strasse', 'weg', 'platz', 'allee'])} {number}",
            f"{number} {rng.choice(['rue', 'avenue', 'boulevard'])} {rng.choice(['de la ', 'du ', ''])}{place}",
            f"{rng.choice(['Calle', 'Avenida', 'Plaza'])} {rng.choice(['de ', ''])}{place} {number}",
        ])
    if slot == "phone_like":
        return rng.choice([
            f"{_digits(rng, 3)}-{_digits(rng, 3)}-{_digits(rng, 4)}", f"({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}",
            f"0{_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 4)}", " ".join(["0" + _digits(rng, 1), *[_digits(rng, 2) for _ in range(4)]]),
            f"0{_digits(rng, 3)}/{_digits(rng, 6)}", f"{_digits(rng, 3)}.{_digits(rng, 3)}.{_digits(rng, 4)}", f"0{_digits(rng, 9)}",
        ])
    if slot == "phone":
        return f"+{rng.randint(1, 99)} ({_digits(rng, 3)}) {_digits(rng, 3)}-{_digits(rng, 4)}"
    if slot in ("email", "email_like"):
        user = rng.choice([rng.choice(first).lower(), f"{rng.choice(first)}.{rng.choice(last)}".lower(), f"user{_digits(rng, 2)}"])
        host = rng.choice(["example", "mail", "post", "firm"]) + rng.choice(["", _digits(rng, 1)])
        end = rng.choice(["com", "org", "net", "de"])
        if slot == "email":
            return f"{user}@{host}.{end}"
        return rng.choice([f"{user} at {host} dot {end}", f"{user} [at] {host} [dot] {end}", f"{user}(at){host}.{end}", f"{user} (at) {host}.{end}"])
    if slot == "again":
        return " ".join([rng.choice([*PLACES, *CITIES, "At", "Dot", "at", "the"])] * rng.randint(2, 8))
    return {
        "hex": lambda: "".join(rng.choices(rng.choice(["0123456789abcdef", "0123456789ABCDEF"]), k=rng.randint(8, 40))),
        "card": lambda: rng.choice([" ", "-", ""]).join(_digits(rng, 4) for _ in range(4)),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "city": lambda: rng.choice(CITIES), "place": lambda: rng.choice(PLACES), "year": lambda: str(rng.randint(1900, 2030)),
        "number": lambda: _digits(rng, rng.randint(3, 7)), "small": lambda: str(rng.randint(1, 31)),
        "version": lambda: ".".join(str(rng.randint(0, 20)) for _ in range(rng.randint(2, 4))),
    }[slot]()


def made_lines(
    n: int = MADE_LINES, seed: int = SEED, first: Sequence[str] = FIRST_NAMES, last: Sequence[str] = LAST_NAMES,
    templates: Sequence[str] = TEMPLATES,
) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` labelled lines (text, spans as (start, end, kind)); one or two templates a line, in turn."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text, spans = "", []
        for template in [templates[i % len(templates)], *([rng.choice(templates)] if rng.random() < 0.5 else [])]:
            text += " " if text else ""
            for literal, slot in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
                text += literal
                if slot:
                    value = _made(rng, slot, first, last)
                    kind = "name" if slot == "last" else slot
                    if kind in KINDS:
                        spans.append((len(text), len(text) + len(value), kind))
                    text += value
        rows.append((text, spans))
    return rows


def labelled_table(spark: SparkSession, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, spans): ``MADE_LINES`` made lines, and windows of ``WINDOWS`` texts of ``docs``, chosen by a hash of the id.

    In windows exactly what the patterns match is labelled.
    """
    kind = "text string, spans array<struct<start:int,end:int,kind:string>>"
    made = spark.createDataFrame(made_lines(), kind)
    if docs is None:
        return made
    code = F.xxhash64(F.col(id_col).cast("string"))
    length = F.length(text_col)
    start = F.pmod(code, F.greatest(length - WINDOW, F.lit(0)) + 1).cast("int")
    windows = docs.where(length > 0).select(
        code.alias("code"), F.substring(F.col(text_col), start + 1, F.lit(WINDOW)).alias("text")
    ).orderBy("code", "text").limit(WINDOWS).select("text")

    def label(batches: Iterator[pd.DataFrame]):
        for batch in batches:
            yield pd.DataFrame({"text": batch["text"], "spans": [
                [{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in base_spans(text)] for text in batch["text"]
            ]})

    return made.unionByName(windows.mapInPandas(label, kind))


# Tokens and their features.

#: A word, a number or a sign, with the space before it; other blanks are tokens of their own.
_TOKEN = re.compile(r" ?(?:[^\W\d_]+|\d+|[^\w\s]|_)|\n|[^\S\n]+|.", re.DOTALL)
#: Code points that are cut into tokens at a time.
PIECE = 1 << 19
_SPACE = re.compile(r"\s")
#: Tokens around a token whose shape and word count, and the token between texts.
REACH, BETWEEN = 2, "\0between"
#: Outside, inside what a pattern matches, inside each kind that the field adds.
LABELS = ("outside", "pattern", *ADDED)
def cut(text: str) -> list[str]:
    """All tokens of ``text``; joined they are the text."""
    if len(text) <= PIECE:
        return _TOKEN.findall(text)
    tokens, at = [], 0
    while at < len(text):
        space = _SPACE.search(text, min(at + PIECE, len(text)))
        end = space.start() if space else len(text)
        tokens += _TOKEN.findall(text, at, end)
        at = end
    return tokens


def shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{min(len(token), 12)}"
    if not token[0].isalpha():
        return token[0]
    if token.islower():
        return "x1" if len(token) == 1 else "x"
    if token.isupper():
        return "X1" if len(token) == 1 else "XX"
    return "Xx" if token[0].isupper() and token[1:].islower() else "xX"


def features(token: str) -> list[str]:
    """Names of the features of a token; those of its ``tail`` count for the token alone, others for its neighbours too."""
    if token == BETWEEN:
        return [BETWEEN]
    spaced, token = token[0] == " ", token.lstrip(" ") or " "
    word = token.lower() if len(token) <= 20 else ""
    names = [f"shape={shape(token)}", f"word={word}", f"spaced={spaced}"]
    return [*names, f"tail={word[-5:]}", f"tail={word[-3:]}"] if token[0].isalpha() else names


@dataclass
class Stream:
    """The tokens of several texts one after the other, with so many ``BETWEEN`` tokens that none reaches the next text.

    Text ``i`` lies between the ``BETWEEN`` tokens ``begins[i]`` and ``ends[i]``.
    """

    tokens: list[str] = field(default_factory=lambda: [BETWEEN] * REACH)
    begins: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.begins.append(len(self.tokens) - 1)
        self.tokens += cut(text)
        self.ends.append(len(self.tokens))
        self.tokens += [BETWEEN] * REACH

    def places(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens of text ``i`` start and end in it, without the space before them."""
        own = self.tokens[self.begins[i] + 1:self.ends[i]]
        ends = np.cumsum(np.fromiter(map(len, own), dtype=np.int64, count=len(own)))
        size = np.fromiter((len(t.lstrip(" ")) or len(t) for t in own), dtype=np.int64, count=len(own))
        return ends - size, ends


# The field.

def token_scores(tables: np.ndarray, numbers: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """A row over ``LABELS`` for every token: what the tokens around it give, and whether it or the next one repeats the one before.

    ``tables[REACH + d]`` is what a token gives the token at distance -d.
    """
    out = tables[REACH][numbers].astype(np.float64)
    for d in range(1, REACH + 1):
        out[d:] += tables[REACH + d][numbers[:-d]]
        out[:-d] += tables[REACH - d][numbers[d:]]
    again = repeats(numbers)
    out[again] += repeated[0]
    out[:-1][again[1:]] += repeated[1]
    return out


def repeats(numbers: np.ndarray) -> np.ndarray:
    """Which tokens equal the token before them."""
    return np.append(False, numbers[1:] == numbers[:-1])


@dataclass
class Model:
    """Weights: of each feature by distance and label, of neighbouring labels, of a token that repeats and one that is repeated."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray
    repeated: np.ndarray

    def __post_init__(self) -> None:
        self.known: dict[str, int] = {}
        self.tables = np.zeros((2 * REACH + 1, 1024, len(LABELS)), dtype=np.float32)

    def __getstate__(self):
        return {"weights": self.weights, "moves": self.moves, "repeated": self.repeated}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def number(self, tokens: list[str]) -> np.ndarray:
        """A number for each token; the scores it gives itself and its neighbours are kept in ``tables``."""
        if len(self.known) > 200_000:
            self.known.clear()
        known, weights = self.known, self.weights
        new = set(tokens) - known.keys()
        while len(known) + len(new) > self.tables.shape[1]:
            self.tables = np.concatenate((self.tables, np.zeros_like(self.tables)), axis=1)
        for at, token in enumerate(new, len(known)):
            known[token] = at
            rows = [weights[name] for name in features(token) if name in weights]
            self.tables[:, at] = sum(rows) if rows else 0
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def scores(self, tokens: list[str]) -> np.ndarray:
        numbers = self.number(tokens)
        out = token_scores(self.tables, numbers, self.repeated)
        out[numbers == self.known[BETWEEN], 1:] = -1e6
        out[:, 0] += CAUTION
        return out

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best labels for a stream of tokens whose first and last are certainly outside.

        A token is certainly outside if no pair of neighbours can make up for
        what another label costs it; beside tokens that are certainly outside
        less can, so this is asked again while it settles many.  Only the runs
        between such tokens are decoded, all at a time, the longest first.
        """
        t = self.moves
        over_outside = t[:, :, None] + t[None, :, :] - (t[:, 0][:, None, None] + t[0][None, None, :])
        open_ = ((scores[:, 1:] + over_outside[:, 1:].max(axis=(0, 2))).max(axis=1) >= scores[:, 0])
        open_[[0, -1]] = False
        left, right = over_outside[0].max(axis=1), over_outside[:, :, 0].max(axis=0)
        # What the best neighbours add to each label, by which of them is open: none, the left, the right one, both.
        gains = np.stack((over_outside[0, :, 0], right, left, over_outside.max(axis=(0, 2))))
        waiting = np.flatnonzero(open_)
        while len(waiting):
            beside = open_[waiting - 1] + 2 * open_[waiting + 1].astype(int)
            settled = (scores[waiting, 1:] + gains[beside, 1:]).max(axis=1) < scores[waiting, 0]
            open_[waiting[settled]] = False
            if settled.sum() * 20 < len(waiting):
                break
            waiting = waiting[~settled]
        labels = np.zeros(len(scores), dtype=np.int8)
        edges = np.flatnonzero(np.diff(open_.astype(np.int8)))
        starts, ends = edges[0::2] + 1, edges[1::2] + 1
        if not len(starts):
            return labels
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        live = len(starts)
        best = t[0] + scores[starts]
        back: list[np.ndarray] = []
        done = np.empty((len(starts), len(LABELS)))
        for step in range(1, int(lengths[0]) + 1):
            still = int(np.searchsorted(-lengths, -step, side="left"))
            done[still:live] = best[still:live]
            live = still
            if not live:
                break
            through = best[:live, :, None] + t
            back.append(through.argmax(axis=1).astype(np.int8))
            best = through.max(axis=1) + scores[starts[:live] + step]
        last = (done + t[:, 0]).argmax(axis=1)
        for step in range(int(lengths[0]) - 1, -1, -1):
            here = int(np.searchsorted(-lengths, -step, side="left"))
            labels[starts[:here] + step] = last[:here]
            if step:
                last[:here] = back[step - 1][np.arange(here), last[:here]]
        return labels


def spans_of(labels: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, label, end) of the runs of a label other than outside."""
    edges = np.flatnonzero(np.diff(labels, prepend=0, append=0))
    return [
        (int(starts[a]), int(labels[a]), int(ends[b - 1])) for a, b in zip(edges[:-1], edges[1:]) if labels[a]
    ]


def label_tokens(starts: np.ndarray, ends: np.ndarray, spans: Sequence[tuple[int, int, str]]) -> np.ndarray:
    labels = np.zeros(len(starts), dtype=np.int64)
    for start, end, kind in spans:
        labels[(starts < end) & (ends > start)] = LABELS.index(kind if kind in ADDED else "pattern")
    return labels


def train(rows: Sequence[tuple[str, Sequence[tuple[int, int, str]]]], rounds: int = ROUNDS) -> Model:
    """The field that makes the labels of ``rows`` (text, spans) most likely, by gradient steps over all of them."""
    stream, texts = Stream(), []
    for text, spans in rows:
        stream.add(text)
        texts.append(spans)
    gold = np.zeros(len(stream.tokens), dtype=np.int64)
    for i, spans in enumerate(texts):
        gold[stream.begins[i] + 1:stream.ends[i]] = label_tokens(*stream.places(i), spans)
    # Names are not learned by heart: no words that stand in values only, no endings that only names have.
    outside = Counter(t.strip(" ").lower() for t, label in zip(stream.tokens, gold) if not label)
    words = {w for w, n in outside.items() if n >= 2} | CUES
    address = LABELS.index("address")
    endings = {
        name for t, label in zip(stream.tokens, gold) if label in (0, address) for name in features(t) if name.startswith("tail=")}
    tokens = sorted(set(stream.tokens))
    names: dict[str, int] = {}
    listed = [
        (i, names.setdefault(name, len(names))) for i, token in enumerate(tokens) for name in features(token)
        if (token.strip(" ").lower() in words if name.startswith("word=") else name in endings or not name.startswith("tail="))
    ]
    token_of, name_of = np.array(listed).T
    number = {t: i for i, t in enumerate(tokens)}
    numbers = np.array([number[t] for t in stream.tokens])
    reaches = np.ones((len(names), 2 * REACH + 1, 1))
    reaches[[n.startswith("tail=") for n in names]] = (np.arange(-REACH, REACH + 1) == 0)[:, None]
    k = len(LABELS)
    weights = [np.zeros((len(names), 2 * REACH + 1, k)), np.zeros((k, k)), np.zeros((2, k))]
    sums = [np.full_like(w, 1e-6) for w in weights]
    data = FieldData(numbers, gold, np.array(stream.begins), np.array(stream.ends), number[BETWEEN], token_of, name_of, reaches, len(tokens))
    for _ in range(rounds):
        for w, s, g in zip(weights, sums, field_gradient(weights, data)[1]):
            g -= DECAY * len(rows) * w
            s += g * g
            w += RATE * g / np.sqrt(s)
    kept = {n: weights[0][i].astype(np.float32) for n, i in names.items() if np.abs(weights[0][i]).max() > 1e-3}
    return Model(kept, weights[1], weights[2])


@dataclass
class FieldData:
    """Labelled tokens: numbers and labels in a row, where texts lie, the ``BETWEEN`` token, and which token has which feature."""

    numbers: np.ndarray
    gold: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    between: int
    token_of: np.ndarray
    name_of: np.ndarray
    reaches: np.ndarray
    n_tokens: int


def field_gradient(weights: Sequence[np.ndarray], data: FieldData) -> tuple[float, list[np.ndarray]]:
    """Log-likelihood of the labels of ``data`` and its gradient by the three arrays of ``weights``.

    Probabilities run forward and backward through all texts at a time, scaled
    to sum 1 at every token; ``BETWEEN`` tokens are outside.
    """
    names, moves, repeated = weights
    numbers, gold, between = data.numbers, data.gold, data.numbers == data.between
    n, k, width = len(numbers), len(LABELS), 2 * REACH + 1
    tables = np.zeros((width, data.n_tokens, k))
    for d in range(width):
        for label in range(k):
            tables[d, :, label] = np.bincount(data.token_of, names[data.name_of, d, label], data.n_tokens)
    scores = token_scores(tables, numbers, repeated)
    scores[between, 1:] = -1e6
    top = scores.max(axis=1)
    potential, step = np.exp(scores - top[:, None]), np.exp(moves)
    # A text runs from one BETWEEN token to the next; the longest texts come first.
    starts, lengths = data.begins, data.ends - data.begins
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    live = [int(np.searchsorted(-lengths, -t, side="right")) for t in range(int(lengths[0]) + 1)]
    only_outside = (np.arange(k) == 0).astype(float)
    forward, backward, scale = np.zeros((n, k)), np.zeros((n, k)), np.ones(n)
    forward[between] = only_outside
    last_scale = np.ones(len(starts))
    for t in range(1, len(live)):
        at, is_end = starts[: live[t]] + t, lengths[: live[t]] == t
        now = (forward[at - 1] @ step) * potential[at]
        size = now.sum(axis=1)
        last_scale[: live[t]][is_end] = size[is_end]
        scale[at[~is_end]] = size[~is_end]
        forward[at[~is_end]] = now[~is_end] / size[~is_end, None]
    total = np.log(scale).sum() + np.log(last_scale).sum() + top.sum()
    move_gradient = np.zeros((k, k))
    for t in range(len(live) - 2, -1, -1):
        m = live[t + 1]
        at, is_last = starts[:m] + t, lengths[:m] == t + 1
        here, last = at[~is_last], at[is_last]
        inner = potential[here + 1] * backward[here + 1] / scale[here + 1][:, None]
        closing = potential[last + 1] * only_outside / last_scale[:m][is_last][:, None]
        backward[here], backward[last] = inner @ step.T, closing @ step.T
        move_gradient -= step * (forward[here].T @ inner + forward[last].T @ closing)
    inside = ~(between[:-1] & between[1:])
    before, after = gold[:-1][inside], gold[1:][inside]
    np.add.at(move_gradient, (before, after), 1.0)
    expected = forward * backward
    expected[between] = only_outside
    difference = -expected
    difference[np.arange(n), gold] += 1.0
    likelihood = scores[np.arange(n), gold].sum() + moves[before, after].sum() - total
    name_gradient = np.zeros_like(names)
    for d in range(-REACH, REACH + 1):
        given, taken = numbers[max(-d, 0): n - max(d, 0)], difference[max(d, 0): n - max(-d, 0)]
        for label in range(k):
            of_tokens = np.bincount(given, taken[:, label], data.n_tokens)
            name_gradient[:, REACH + d, label] = np.bincount(data.name_of, of_tokens[data.token_of], len(names))
    again = repeats(numbers)
    again_gradient = np.stack((difference[again].sum(axis=0), difference[:-1][again[1:]].sum(axis=0)))
    return likelihood, [name_gradient * data.reaches, move_gradient, again_gradient]


# Scanning.

def plausible(kind: str, text: str) -> bool:
    """Whether a span of the field can be what it is called."""
    digits, words = sum(c.isdigit() for c in text), re.findall(r"\w+", text)
    if kind == "phone_like":
        return 7 <= digits <= 15
    if kind == "email_like":
        return len(set(words)) >= 4
    if kind == "address":
        return digits > 0 and any(c.isalpha() for c in text)
    return not digits and len(words) <= 6 and len(set(words)) == len(words) and any(c.isupper() for c in text)


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit touches the span."""
    return not text[start - 1:start].isalnum() and not text[end:end + 1].isalnum() if start else not text[end:end + 1].isalnum()


def scan_texts(model: Model, texts: Sequence[str | None]) -> list[list[tuple[int, int, int]]]:
    """For every text (start, kind, end) of its spans, sorted: those of the patterns, and what the field adds beside them."""
    stream = Stream()
    for text in texts:
        stream.add(text or "")
    labels = model.decode(model.scores(stream.tokens))
    marked = set(np.searchsorted(stream.begins, np.flatnonzero(labels > 1), side="right") - 1)
    out = []
    for i, text in enumerate(texts):
        spans, added = base_spans(text or ""), []
        if i in marked:
            opens, reach = [s for s, _, _ in spans], list(accumulate((e for _, _, e in spans), max))
            own = labels[stream.begins[i] + 1:stream.ends[i]]
            for start, label, end in spans_of(own, *stream.places(i)):
                before = bisect_left(opens, end)
                free = not before or reach[before - 1] <= start
                if label > 1 and free and stands_alone(text, start, end) and plausible(LABELS[label], text[start:end]):
                    added.append((start, KINDS.index(LABELS[label]), end))
        out.append(sorted(spans + added))
    return out


def grouped(texts: Sequence[str | None], size: int) -> Iterator[slice]:
    """Runs of texts of about ``size`` characters."""
    at = held = 0
    for i, text in enumerate(texts):
        held += len(text or "") + 1
        if held >= size:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def scan_batches(batches: Iterator[pd.DataFrame], model: Model):
    for batch in batches:
        texts = batch["text"].tolist()
        found = [spans for part in grouped(texts, PIECE) for spans in scan_texts(model, texts[part])]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "spans": [
            [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in found
        ]})


def trained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A field trained on the labelled table of ``docs``: ``MADE_LINES + WINDOWS`` rows."""
    rows = labelled_table(docs.sparkSession, docs, id_col, text_col).collect()
    return train([(r["text"], [(s["start"], s["end"], s["kind"]) for s in r["spans"]]) for r in rows])


def scan_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, spans array of (kind, start, end).

    * Positions are code points, end exclusive; spans are sorted by start, then
      kind in the order of ``KINDS``.  Spans of the field stand beside those of
      the patterns, never over them.
    * Null and empty texts have no spans; texts of any length are read whole.
      Repeated rows give a row each; an empty table gives no rows; other columns
      are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the labelled table makes it
    return text_rows(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        lambda batches: scan_batches(batches, shared.value),
        f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>",
    )


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
