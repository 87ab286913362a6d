import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.llm import ngram_join
from loreloom.llm.shingles import PIECE, WordReader, shingle_hashes
from tests.llm.helpers import documents, rows_of, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    sets, low = {}, {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, []).append(shingle_set(text))
        low[doc_id] = doc_id
    moved = True
    pairs = [
        (a, b) for a, b in combinations([i for i in sets if i is not None], 2)
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])
    ]
    while moved:
        moved = False
        for a, b in pairs:
            least = min(low[a], low[b])
            moved |= low[a] != least or low[b] != least
            low[a] = low[b] = least
    return sorted(((i, len(shingle_set(t)), low[i]) for i, t in rows), key=repr)


def edited(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    rng = random.Random(11)
    shared = words(rng, 50)
    rows, next_id = [], 100
    for size in (6, 20, 60, 150):
        for _ in range(4):
            base = words(rng, size) + shared
            for changes in (0, 0, 1, 1, 2, 3, 5, 8):
                rows.append((next_id, edited(rng, base, changes)))
                next_id += 1
    hub = words(rng, 120)
    for _ in range(60):
        rows.append((next_id, edited(rng, hub, rng.choice((0, 1, 1, 2, 3, 4)))))
        next_id += 1
    rows += [(next_id + i, " ".join(words(rng, 80, 30))) for i in range(20)]
    rows += [
        (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "One  two\nTHREE"), (6, "one two three four"),
        (7, "É é"), (8, "é é"), (9, "to to to to to to of of of of of to to to"), (50, "one two three"),
        (50, " ".join(hub)), (None, " ".join(hub)), (None, None), (51, "repeat me"), (51, "repeat me"),
    ]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_classes_equal_brute_force(spark, rows):
    df = documents(spark, rows).repartition(6)
    got = rows_of(ngram_join.join_classes(df), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows)


def test_small_blocks_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 500)
    got = rows_of(ngram_join.join_classes(documents(spark, rows).repartition(3)), "doc_id", "n_shingles", "component_id")
    assert got == brute(rows)


def test_other_similarity_and_length(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g x"), (3, "a b q r s t u v")]
    got = rows_of(ngram_join.join_classes(documents(spark, rows), k=2, hundredths=50), "doc_id", "component_id")
    assert got == [(1, 1), (2, 1), (3, 3)]


def test_empty_table(spark):
    assert ngram_join.join_classes(documents(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark, rows):
    docs = documents(spark, rows).withColumns({"_row": F.lit("mine"), "number": F.lit(-1), "row": F.lit("r")})
    kept = ngram_join.kept_rows(docs)
    assert kept.columns == docs.columns
    # Each row by itself: the smallest id of its group, null last.
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    component = {i: c for i, n, c in brute(numbered) if n}
    groups = {}
    for i, c in component.items():
        groups.setdefault(c, []).append(rows[i][0])
    expected = [min(g, key=lambda i: (i is None, i or 0)) for g in groups.values()]
    expected += [i for i, t in rows if not shingle_set(t)]
    got = kept.collect()
    assert sorted([r.doc_id for r in got], key=repr) == sorted(expected, key=repr)
    assert {(r["_row"], r["number"], r["row"]) for r in got} == {("mine", -1, "r")}


def test_pairs_grow_with_the_documents(spark, monkeypatch):
    """Copies of one text that link with some of the others: pairs for a document stay few, whatever the ids."""
    per_document = []
    for n in (150, 600):
        rng = random.Random(n)
        base = words(rng, 120, 100_000)
        rows = [(i, edited(rng, base, rng.choice((1, 2, 2, 3)))) for i in range(n)]
        ids = rng.sample(range(10 * n), n)
        rows = [(ids[i], t) for i, t in rows]
        counted = []
        original = ngram_join.verified

        def count(pairs, ordered):
            counted.append(pairs.count())
            return original(pairs, ordered)

        monkeypatch.setattr(ngram_join, "verified", count)
        got = rows_of(ngram_join.join_classes(documents(spark, rows)), "doc_id", "n_shingles", "component_id")
        monkeypatch.setattr(ngram_join, "verified", original)
        assert got == brute(rows)
        per_document.append(sum(counted) / n)
    assert per_document[1] < 2 * per_document[0] + 2


def test_long_texts_are_read_in_pieces():
    rng = random.Random(1)
    text = " ".join(words(rng, 10)) + " " + "x" * (PIECE + 5) + " " + " ".join(words(rng, PIECE // 4))
    whole, parts = WordReader().of_bytes(text.encode())[0], WordReader().words(text)
    assert np.array_equal(whole, parts) and len(parts) == len(text.split())


def test_shingles_of_repeated_words_differ():
    hashes = {}
    reader = WordReader()
    for word in ("a", "b"):
        hashes[word] = reader.words(word)[0]
    seen = {}
    for bits in range(32):
        run = [("a", "b")[bits >> i & 1] for i in range(5)]
        seen[int(shingle_hashes(np.array([hashes[w] for w in run]), 5)[0])] = run
    assert len(seen) == 32
