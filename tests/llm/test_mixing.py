import random
import re
from collections import defaultdict
from fractions import Fraction

from loreloom.llm import mixing
from tests.llm.helpers import documents, rows_of, words


def corpus():
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randint(0, 40))), "en", rng.choice("aaaaaab")) for i in range(300)]
    rows += [(1000 + i, " ".join(words(rng, 12)), "en", s) for i, s in enumerate(["c", "d", None, None, "é", "Z"] * 5)]
    rows += [(2000, None, "en", "a"), (2001, "", "en", "empty"), (None, "x y", "en", "c"), (2002, "x y", "en", "c"), (2002, "x y", "en", "c")]
    return rows


def targets(rows):
    """Water filling by repeated resharing, in exact arithmetic."""
    sizes = defaultdict(int)
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
            open_.remove(s)
    return sizes, target


def test_targets_and_taken_words(spark):
    rows = corpus()
    sizes, target = targets(rows)
    got = mixing.mix(documents(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert abs(r.target - float(target[r.source])) < 1e-6
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    longest = max(r["size"] for r in got)
    for s in sizes:
        assert abs(taken[s] - float(target[s])) <= 2 * longest
    assert sum(taken.values()) <= sum(sizes.values()) * 3 // 2


def test_reruns_agree(spark):
    rows = corpus()
    runs = [
        rows_of(mixing.mix(documents(spark, order).repartition(n)), "doc_id", "source", "size", "taken")
        for order, n in ((rows, 2), (rows[::-1], 7))
    ]
    assert runs[0] == runs[1]


def test_documents_repeat_as_decided(spark):
    rows = corpus()
    docs = documents(spark, rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = defaultdict(int)
    for r in mixed.collect():
        copies[r.doc_id, r.text] += 1
    wanted = defaultdict(int)
    for r in mixing.mix(docs).collect():
        wanted[r.doc_id] += r.copies
    for (doc_id, _), n in copies.items():
        if doc_id != 2002:
            assert n == wanted[doc_id]
    assert set(copies) and {i for i, n in wanted.items() if n} == {i for i, _ in copies}


def test_tables_without_words(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.mixed_documents(documents(spark, [])).count() == 0
    got = mixing.mix(documents(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0), (0, 0.0)]


def test_columns_of_any_name_stay(spark):
    names = ["_source", "_place", "_copies", "_copy", "_cut1", "cut1", "place", "row", "of", "copies"]
    docs = documents(spark, corpus()).withColumns({n: mixing.F.lit(n) for n in names})
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == mixing.mixed_documents(documents(spark, corpus())).count()
    assert tuple(mixed.select(names).distinct().collect()[0]) == tuple(names)
