import random
import re
import zlib
from collections import Counter

import pytest

from loreloom.llm import spelling
from tests.llm.helpers import documents


def counted(rows, noise=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if noise and code % noise == 0:
                at = code % len(word)
                word = word[:at] + word[at + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    words = counted(rows)
    forms, out = {}, []
    for word, n in words.items():
        others = [w for w in words if near(word, w)]
        best = min(others, key=lambda w: (-words[w], w), default=None)
        forms[word] = best if best and words[best] >= 2 * n else None
        out.append([word, forms[word], None, n, len(others), words[best] if forms[word] else None])
    for row in out:
        root = row[0]
        while forms[root]:
            root = forms[root]
        row[2] = root
    return sorted(map(tuple, out))


def found(df):
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


def texts(rng, n, letters, lengths, copies=4):
    bases = ["".join(rng.choices(letters, k=rng.choice(lengths))) for _ in range(n)]
    words = []
    for base in bases:
        words += [base] * rng.choice([3, 7, 20])
        for _ in range(copies):
            at, kind = rng.randrange(len(base)), rng.randrange(3)
            made = base[:at] + ("" if kind == 0 else rng.choice(letters)) + base[at + (kind != 2):]
            words += [made] * rng.choice([1, 3, 5])
    rng.shuffle(words)
    return [(i, " ".join(w.capitalize() if rng.random() < 0.2 else w for w in words[i::60])) for i in range(60)]


@pytest.mark.parametrize("case", ["usual", "few letters", "crowded", "long"])
def test_equals_brute_force(spark, monkeypatch, case):
    rng = random.Random(case)
    if case == "usual":
        rows = texts(rng, 60, "abcdefghijklmnopqrstuvwxyzäéÿÀ×", [5, 6, 8, 11])
    elif case == "few letters":
        rows = texts(rng, 60, "ab", [5, 6, 7])
    elif case == "crowded":
        monkeypatch.setattr(spelling, "CLASS_PAIRS", 4)
        rows = texts(rng, 60, "abcdé", [5, 6])
    else:
        monkeypatch.setattr(spelling, "LONG", 8)
        rows = texts(rng, 60, "abcdef", [6, 7, 8, 9])
    assert found(documents(spark, rows)) == brute(rows)


def test_hard_rows(spark):
    long_word = "q" * 1_500
    rows = [(None, "Color colour colour"), (1, None), (2, ""), (3, " ".join(["colour"] * 9)), (3, " ".join(["colour"] * 9)),
            (4, "color, COLOR;color×color ÀBCDE àBCDE"), (5, f"{long_word} {long_word}x " * 3), (6, "ab abc abcd " * 9)]
    assert found(documents(spark, rows)) == brute(rows)
    assert found(documents(spark, [])) == []


def test_one_edit():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choices("ab", k=rng.randint(0, 6))) for _ in range(2))
        assert spelling.differ_by_one(a, b) == near(a, b), (a, b)


def test_very_long_words(spark):
    word = "ab" * 60_000
    rows = [(1, f"{word} " * 9 + f"{word}c " * 3), (2, None)]
    assert [(len(r[0]), r[1] and len(r[1]), r[3], r[4]) for r in found(documents(spark, rows))] == [(120_000, None, 9, 1), (120_001, 120_000, 3, 1)]


def test_words_across_pieces(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "alpha beta gammagammagamma delta épsilon " * 5
    assert spelling.runs_of(text, 5) == Counter(re.findall("[A-Za-zÀ-ÿ]{5,}", text))


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}" if i < 12 else None) for i in range(13)]
    got = spelling.with_roots(spark.createDataFrame(chain, "word string, form string")).collect()
    assert {r["root"] for r in got} == {"w12"} and len(got) == 13
