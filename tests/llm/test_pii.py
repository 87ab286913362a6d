import itertools
import random
import re
import time

import numpy as np
import pytest

from loreloom.llm import pii, queries
from tests.llm.helpers import documents


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def literal(text):
    """The patterns as the rule gives them."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


CASES = [
    "a@b.c", "a@b", "@b.c", "a@b@c.d e.f@g.h@i.j", "x@y.z.@q.w", "a@b..c", "über.a@b.de", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.0003.255",
    "4465758382889437", "4465 7583-8288 9437", "44657583828894370", "+1 (523) 555-1055", "+1 523", "+12345678901234567890", "+1 (2", "++49 30 1234567",
    "", "٤٤٦٥", "+1 (523) 555-1055 4465758382889437 4465758382889437",
]


def test_patterns_are_the_rules():
    rng = random.Random(3)
    bits = ["a", "b.c", "@", ".", "x-y", "1", "23", "255", "256", " ", "-", "+", "(", ")", "4465758382889437", "é", "+1", "_", "\n", "4465"]
    texts = CASES + ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(4000)]
    for text in texts:
        assert pii.base_spans(text) == literal(text), text


def test_time_is_linear():
    start = time.time()
    for unit in ("a", "1", "1.", "@", "a@", "+1 ", "+", "( ", "1 ", "a.b@c "):
        pii.base_spans(unit * (1_000_000 // len(unit)))
    assert time.time() - start < 20


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.made_lines(500), rounds=25)


def best_path(scores, moves):
    def total(path):
        full = [0, *path, 0]
        return sum(scores[i + 1][k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(full))

    return max(itertools.product(range(scores.shape[1]), repeat=len(scores) - 2), key=total)


def test_decoding_is_best(model):
    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    for _ in range(40):
        scores = rng.normal(0, 2, (rng.integers(1, 5) + 2, k))
        scores[[0, -1], 1:] = -1e6
        scores[:, 0] += rng.choice([0, 3])
        field = pii.Model({}, rng.normal(0, 1.5, (k, k)), model.repeated)
        assert tuple(field.decode(scores)[1:-1]) == best_path(scores, field.moves)


def test_gradient_by_differences():
    rows = pii.made_lines(12)
    caught = {}
    original = pii.field_gradient

    def first(weights, data):
        caught.setdefault("data", data)
        return original(weights, data)

    pii.field_gradient = first
    try:
        pii.train(rows, rounds=1)
    finally:
        pii.field_gradient = original
    data, rng = caught["data"], np.random.default_rng(1)
    k = len(pii.LABELS)
    weights = [rng.normal(0, 0.3, s) for s in ((data.reaches.shape[0], 5, k), (k, k), (2, k))]
    _, gradients = original(weights, data)
    for w, g in zip(weights, gradients):
        for _ in range(15):
            at = tuple(rng.integers(0, s) for s in w.shape)
            if w.ndim == 3 and not data.reaches[at[0], at[1], 0]:
                continue
            kept = w[at]
            w[at] = kept + 1e-5
            up = original(weights, data)[0]
            w[at] = kept - 1e-5
            down = original(weights, data)[0]
            w[at] = kept
            assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5)


def test_names_never_seen():
    first, last = "Aisha Boris Chen Dagmar Ewan Farid".split(), "Okafor Lindqvist Marchetti Yamada Petrov".split()
    model = pii.train(pii.made_lines())
    hits = wrong = missed = 0
    for text, spans in pii.made_lines(400, seed=99, first=first, last=last):
        got = {(s, e, pii.KINDS[k]) for s, k, e in pii.scan_texts(model, [text])[0] if k >= len(pii.BASE)}
        want = {s for s in spans if s[2] in pii.ADDED}
        hits, wrong, missed = hits + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hits / (hits + wrong) > 0.95 and hits / (hits + missed) > 0.9


def test_texts_do_not_touch_each_other(model):
    texts = [t for t, _ in pii.made_lines(60, seed=4)] + [None, "", "\n", " "]
    alone = [pii.scan_texts(model, [t])[0] for t in texts]
    assert pii.scan_texts(model, texts) == alone


def test_pieces_do_not_change_tokens(monkeypatch):
    text = " ".join(t for t, _ in pii.made_lines(40)) + " " + "x" * 500 + " end"
    whole = pii.cut(text)
    monkeypatch.setattr(pii, "PIECE", 37)
    assert pii.cut(text) == whole and "".join(whole) == text


def test_rows(spark, model):
    long = "of the " * 200_000 + "a@b.de +1 (523) 555-1055 My name is Anna Becker."
    rows = [(i, t) for i, t in enumerate(CASES)] + [(100, None), (None, CASES[0]), (None, CASES[0]), (101, long)]
    got = pii.scan_documents(documents(spark, rows), model).collect()
    found = sorted(((r.doc_id, [(x.start, pii.KINDS.index(x.kind), x.end) for x in r.spans if x.kind in pii.BASE]) for r in got), key=repr)
    assert found == sorted(((i, literal(t or "")) for i, t in rows), key=repr)
    assert [(x.kind, long[x.start:x.end]) for r in got if r.doc_id == 101 for x in r.spans][-1] == ("name", "Anna Becker")
    assert pii.scan_documents(documents(spark, []), model).count() == 0


def test_query_reads_its_labels_from_the_table(spark, monkeypatch):
    monkeypatch.setattr(pii, "MADE_LINES", 300)
    monkeypatch.setattr(pii, "ROUNDS", 10)
    docs = documents(spark, [(1, "write to a@b.de now"), (2, "+1 (523) 555-1055"), (3, None), (3, "")])
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = {r["doc_id"]: r for r in queries.op12_pii(spark, "").collect()}
    assert (got[1]["n_email"], got[2]["n_phone"], got[3]["n_email"]) == (1, 1, 0)
    assert got[1]["spans"] == "email:9:15" and got[3]["spans"] == ""
    assert got[1]["base_sha256"] == __import__("hashlib").sha256(b"email:9:15").hexdigest()
    assert pii.labelled_table(spark, docs).count() == len(pii.made_lines()) + 2
