"""Ordered operators against plain loops, with one hot key and null keys."""

import random

from pyspark.sql import functions as F

from loreloom.operators import ordered, usage, versions


def events(spark, n=400):
    rng = random.Random(2)
    rows = [(None if i % 11 == 0 else 1 if i % 3 else i % 5, rng.randint(0, 5000), i, rng.choice("abc")) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k int, at long, id long, act string").repartition(6)


def test_numbers_keep_hot_and_null_keys(spark):
    rows, df = events(spark)
    numbered = ordered.number_rows(df, ["k"], [F.col("at"), F.col("id")], F.floor(F.col("at") / 300)).collect()
    expected, seen = {}, {}
    for k, at, i, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        expected[i] = seen[k]
    assert {r["id"]: r["number"] for r in numbered} == expected


def test_replay_equals_a_loop(spark):
    rules = {("new", "a"): "open", ("open", "b"): "done", ("done", "a"): "open", ("open", "a"): "open"}
    rows, df = events(spark)
    rows = [r for r in rows if r[0] is not None]
    done = ordered.replay(df.filter("k IS NOT NULL"), "k", ["at", "id"], "act", F.floor(F.col("at") / 50), F.floor(F.col("at") / 1000), rules, "new").collect()
    states, expected = {}, {}
    for k, at, i, act in sorted(rows, key=lambda r: (r[1], r[2])):
        now = states.get(k, "new")
        following = rules.get((now, act))
        states[k] = following or now
        expected[i] = (now, states[k], following is not None)
    assert {r["id"]: (r["from_state"], r["to_state"], r["accepted"]) for r in done} == expected


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1, 21)], "v double")
    row = usage.nearest_rank(df, "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (row["n"], row["p50"], row["p95"]) == (20, 10.0, 19.0)


def test_version_chain_reports_gaps(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (5, 4)], "doc_id long, previous_id long")
    rows = {r["doc_id"]: (r["root_id"], r["length"], r["complete"]) for r in versions.version_chains(df).collect()}
    # A chain with a missing predecessor has no root that could be named.
    assert rows == {1: (1, 1, True), 2: (1, 2, True), 3: (1, 3, True), 5: (None, None, False)}


def test_version_chains_of_any_length_and_circles(spark):
    rows = [(i, i - 1 if i > 1 else None) for i in range(1, 81)] + [(100, 102), (101, 100), (102, 101), (103, 102)]
    df = spark.createDataFrame(rows, "doc_id long, previous_id long").repartition(5)
    found = {r["doc_id"]: (r["root_id"], r["length"], r["complete"]) for r in versions.version_chains(df).collect()}
    assert all(found[i] == (1, i, True) for i in range(1, 81))
    assert all(found[i] == (None, None, False) for i in range(100, 104))
    flagged = {r["doc_id"]: r["complete"] for r in versions.version_chains(df, depth=64).collect()}
    assert flagged[64] and not flagged[65]


def test_history_needs_every_revision(spark):
    blocks = spark.createDataFrame([("c1", 3), ("c2", 2), ("c3", 1)], "block string, revision int")
    records = spark.createDataFrame([("c1", 3, "c1", 2), ("c1", 2, "c1", 1)], "block string, revision int, source_block string, source_revision int")
    rows = {r["block"]: r["complete"] for r in versions.history_complete(blocks, records).collect()}
    assert rows == {"c1": True, "c2": False, "c3": True}


def test_header_change_reopens_sibling_chunks(spark):
    chunks = spark.createDataFrame(
        [("a", "t", ["x"], 1, "confirmed"), ("b", "t", ["x"], 1, "confirmed"), ("c", "u", ["x"], 1, "confirmed")],
        "chunk_id string, table_id string, headers array<string>, block_revision int, review_state string",
    )
    edited = spark.createDataFrame([("a", "t", ["y"])], "chunk_id string, table_id string, headers array<string>")
    rows = {r["chunk_id"]: (r["headers"], r["block_revision"], r["review_state"]) for r in versions.propagate_headers(chunks, edited).collect()}
    assert rows == {"a": (["y"], 2, "confirmed"), "b": (["y"], 2, "unreviewed"), "c": (["x"], 1, "confirmed")}


def test_replay_looks_an_action_up_once(spark):
    rules = {("new", "go"): "run", ("run", "stop"): "new"}
    rows = [(1, i, a) for i, a in enumerate(["go", None, "odd", "go", "stop", "stop", "go"])] + [(2, 0, "stop")]
    df = spark.createDataFrame(rows, "k int, at int, act string")
    done = ordered.replay(df, "k", ["at"], "act", F.floor(F.col("at") / 2), F.floor(F.col("at") / 4), rules, "new")
    assert "concat(" not in done._jdf.queryExecution().optimizedPlan().toString()
    got = [(r["from_state"], r["to_state"], r["accepted"]) for r in done.filter("k = 1").orderBy("at").collect()]
    assert got == [("new", "run", True), ("run", "run", False), ("run", "run", False), ("run", "run", False),
                   ("run", "new", True), ("new", "new", False), ("new", "run", True)]
    assert [tuple(r)[:4] for r in done.filter("k = 2").select("from_state", "to_state", "accepted", "act").collect()] == [("new", "new", False, "stop")]
