import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loreloom.llm import merkle, queries
from tests.llm.helpers import documents


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, **changed):
    values = [changed.get(c, row[c]) for c in merkle.FIELDS]
    return hashlib.sha256(b"".join(
        b"-" if v is None else str(len(str(v).encode())).encode() + b":" + str(v).encode() for v in values
    )).hexdigest()


def tree(nodes):
    """All levels, as the rule says it."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i:i + 2])) for i in range(0, len(now), 2)])
    return levels


def way(levels, at):
    for nodes in levels[:-1]:
        run = at // 2 * 2
        yield at % 2, [nodes[i] for i in range(run, min(run + 2, len(nodes))) if i != at]
        at //= 2


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for group in order:
        groups[group].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[group] = tree([leaf_of(r) for r in groups[group]])
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for place, group in enumerate(order):
        for at, row in enumerate(groups[group]):
            leaf = leaf_of(row)
            tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None
            folded, siblings = leaf_of(row, n_chars=row["n_chars"] + 1) if tampered else leaf, []
            for right, others in [*way(trees[group], at), *way(top, place)]:
                folded = h("".join([*others, folded] if right else [folded, *others]))
                siblings += others
            out.append((row["doc_id"], leaf, trees[group][-1][0], top[-1][0], h("".join(siblings)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def run(monkeypatch, df):
    monkeypatch.setattr(queries, "table", lambda *_: df)
    found = queries.op11_merkle_manifest(df.sparkSession, "")
    return sorted((tuple(r) for r in found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def rows_like(rng, n, langs, ids):
    return [(ids(i), "".join(rng.choices("abé😀 \n", k=rng.randint(0, 30))) or None, rng.choice(langs), rng.choice([None, "web", ""])) for i in range(n)]


@pytest.mark.parametrize("case", ["dense", "sparse", "repeated", "hot", "many groups", "one", "copies"])
def test_equals_the_rule(spark, monkeypatch, case):
    rng = random.Random(case)
    rows = {
        "dense": lambda: rows_like(rng, 700, [None, "en", "de", "é", ""], lambda i: i),
        "sparse": lambda: rows_like(rng, 300, ["en"], lambda i: rng.choice([-1, 1]) * rng.randrange(2**62) + rng.choice([0, i])),
        "repeated": lambda: rows_like(rng, 300, ["en", None], lambda i: rng.choice([None, -5, -64, -1, 0, 63, 64, 7, 2**63 - 1, -2**63])),
        "hot": lambda: rows_like(rng, 200, ["en"], lambda i: 5 if i % 3 else i) + [(9, "same", "en", "s")] * 150,
        "many groups": lambda: rows_like(rng, 90, [f"l{i}" for i in range(60)], lambda i: i // 2),
        "one": lambda: [(3, "only", "en", None)],
        "copies": lambda: [(None, None, None, None)] * 70,
    }[case]()
    if case in ("hot", "copies"):
        monkeypatch.setattr(merkle, "COPIES", 16)
    df = documents(spark, rows)
    expected = brute([r.asDict() for r in df.collect()])
    for levels in (2, 10) if case in ("dense", "many groups") else (3,):
        monkeypatch.setattr(merkle, "LEVELS", levels)
        assert run(monkeypatch, df) == expected


def test_rows_tampered_with_do_not_verify(spark, monkeypatch):
    df = documents(spark, [(i, f"text {i}", "en", "s") for i in range(100)])
    got = run(monkeypatch, df)
    changed = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0]
    assert changed and [r[0] for r in sorted(got) if not r[-1]] == changed


def test_long_text_and_empty_table(spark):
    df = documents(spark, [(1, "x" * 3_000_000, "en", "s"), (2, "", "en", "s")])
    expected = brute([r.asDict() for r in df.collect()])
    got = merkle.manifest(df).select("id", "leaf", "subroot", "root", "proof").collect()
    assert sorted((tuple(r) for r in got), key=repr) == [r[:5] for r in expected]
    assert merkle.manifest(documents(spark, [])).count() == 0


def test_directory_counts_the_rows_before(spark):
    ids = [0, 1, 63, 64, 300 * 64, 70_000, -1, -70_000]
    rows = documents(spark, [(i, str(i), "en", "s") for i in ids])
    placed = merkle.coordinates(merkle.leaves(rows)).select("id", "position").collect()
    assert [r["id"] for r in sorted(placed, key=lambda r: r["position"])] == sorted(ids)
    words = merkle.directory(merkle.leaves(rows)).agg(F.sum(F.bit_count("bits"))).first()[0]
    assert words == len(ids)
