"""Streams over split files against plain loops."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from loreloom.operators import usage
from loreloom.streaming import state

START = dt.datetime(2024, 1, 1)


def source(spark, tmp_path, rows, files=3):
    """The rows as several files, in order, read one file per trigger."""
    size = -(-len(rows) // files)
    for n in range(files):
        part = rows[n * size:(n + 1) * size]
        spark.createDataFrame(part, "user_id long, event_id long, kind string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
    schema = spark.read.parquet(f"{tmp_path}/in/f0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def test_rate_windows_open_at_the_first_event(spark, tmp_path):
    rng = random.Random(1)
    moments = sorted(rng.uniform(0, 900) for _ in range(120))
    rows = [(rng.randint(1, 3), i, "x", START + dt.timedelta(seconds=s)) for i, s in enumerate(moments)]
    # One file: every event of a key meets its state in order.
    stream = source(spark, tmp_path, rows, files=1)
    done = state.run_to_table(state.rate_windows(stream, "user_id", "ts", "event_id", 4, 60), f"{tmp_path}/out")
    windows, expected = {}, {}
    for user, event, _, at in rows:
        begun, count = windows.get(user, (None, 0))
        if begun is None or at > begun + dt.timedelta(seconds=60):
            begun, count = at, 0
        windows[user] = (begun, count + 1)
        expected[event] = count + 1 <= 4
    assert {r["event_id"]: r["accepted"] for r in done.collect()} == expected


def test_late_events_come_out_as_late(spark, tmp_path):
    seconds = [0, 10, 5000, 5010, 20, 1500]
    rows = [(1, i, "x", START + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    stream = source(spark, tmp_path, rows, files=3)
    done = state.run_to_table(state.rate_windows(stream, "user_id", "ts", "event_id", 4, 60, delay=3600), f"{tmp_path}/out").collect()
    found = {r["event_id"]: (r["n"], r["accepted"], r["late"]) for r in done}
    assert found == {0: (1, True, False), 1: (2, True, False), 2: (1, True, False), 3: (2, True, False), 4: (None, False, True), 5: (3, True, False)}


def test_outbox_delivers_more_than_a_batch_once(spark, tmp_path):
    rows = [(1, i, "a" if i % 2 else "b", START + dt.timedelta(seconds=i)) for i in range(450)]
    stream = source(spark, tmp_path, rows).select(F.col("event_id").alias("sequence"), "event_id", F.col("kind").alias("action"))
    hooks = spark.createDataFrame([(1, "a", -1), (2, "a", 200), (2, "b", 200)], "hook_id long, action string, cursor long")
    found = state.deliver_batches(stream, hooks, f"{tmp_path}/out").collect()
    expected = {(1, i) for i in range(450) if i % 2} | {(2, i) for i in range(201, 450)}
    assert len(found) == len(expected) and {(r["hook_id"], r["event_id"]) for r in found} == expected


def test_outbox_gives_an_event_that_comes_again_once(spark, tmp_path):
    rows = [(1, i % 300, "a" if i < 300 else "b", START + dt.timedelta(seconds=i)) for i in range(450)]
    stream = source(spark, tmp_path, rows).select(F.col("event_id").alias("sequence"), "event_id", F.col("kind").alias("action"))
    hooks = spark.createDataFrame([(1, "a", -1), (1, "b", -1), (2, "b", 20), (2, "b", 100)], "hook_id long, action string, cursor long")
    found = state.deliver_batches(stream, hooks, f"{tmp_path}/out").collect()
    expected = {(1, i) for i in range(300)} | {(2, i) for i in range(21, 150)}
    assert len(found) == len(expected) and {(r["hook_id"], r["event_id"]) for r in found} == expected
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out/rows")
    assert "delivery_id" not in stored.columns  # the digest is most of a row; it follows from the keys


def test_deliveries_are_not_shuffled(spark):
    audit = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, 2, "a"), (4, 2, "b"), (5, None, "a"), (6, None, "a")], "sequence long, event_id long, action string")
    hooks = spark.createDataFrame([(1, "a", 0), (1, "a", 0), (1, "b", 0), (None, "a", 0), (2, "b", 4)], "hook_id long, action string, cursor long")
    sent = usage.deliveries(audit, hooks)
    wanted = [hashlib.sha256(i.encode()).hexdigest() for i in ("1:1", "1:2", "1", "2", "")]
    assert sorted(r["delivery_id"] for r in sent.collect()) == sorted(wanted)
    text = sent._jdf.queryExecution().optimizedPlan().toString()
    assert text.lstrip().startswith("Union")  # not an aggregate over all deliveries


def test_change_feed_over_batches_ignores_older_records(spark, tmp_path):
    rows = [
        (1, 0, "v1", START), (1, 1, "v2", START + dt.timedelta(hours=2)),
        (1, 2, "old", START + dt.timedelta(hours=1)), (2, 3, "w1", START), (2, 4, "gone", START + dt.timedelta(hours=3)),
    ]
    stream = source(spark, tmp_path, rows).select(
        F.col("user_id").alias("external_id"), F.col("kind").alias("content_hash"), F.col("ts").alias("updated_at"),
        (F.col("kind") == "gone").alias("deleted"), F.lit(True).alias("allowed"),
    )
    kind = "external_id long, content_hash string, source_updated_at timestamp, access_state string, tombstone boolean, version int"
    final = state.apply_changes_stream(stream, spark.createDataFrame([], kind), f"{tmp_path}/out")
    rows = {r["external_id"]: (r["content_hash"], r["access_state"]) for r in final.collect()}
    assert rows == {1: ("v2", "active"), 2: ("w1", "withdrawn")}


def test_change_feed_writes_deltas_in_proportion(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.randrange(12), i, f"v{rng.randrange(3)}", START + dt.timedelta(seconds=rng.randrange(900))) for i in range(90)]
    kind = "external_id long, content_hash string, source_updated_at timestamp, access_state string, tombstone boolean, version int"
    old = [(i, "v0", START, "active", i % 7 == 0, 1) for i in range(400)]
    results = []
    for compact in (3, 100):
        stream = source(spark, tmp_path / str(compact), rows, files=9).select(
            F.col("user_id").alias("external_id"), F.col("kind").alias("content_hash"), F.col("ts").alias("updated_at"),
            (F.col("event_id") % 10 == 0).alias("deleted"), F.lit(True).alias("allowed"))
        folder = f"{tmp_path}/out{compact}"
        results.append(sorted(map(tuple, state.apply_changes_stream(stream, spark.createDataFrame(old, kind), folder, compact=compact).collect())))
        for n in range(9):
            assert spark.read.parquet(f"{folder}/delta/batch={n}").count() <= 12
    assert results[0] == results[1] and len(results[0]) == 400


def test_tables_of_part_files_are_read_whole(spark, tmp_path):
    rows = [(i % 5, i, "x", START + dt.timedelta(seconds=i)) for i in range(200)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, kind string, ts timestamp")
    df.repartition(6).write.parquet(f"{tmp_path}/given/events.parquet")
    df.limit(3).coalesce(1).write.parquet(f"{tmp_path}/given/other.parquet")
    found = state.run_to_table(state.read_table_stream(spark, f"{tmp_path}/given", "events", 2), f"{tmp_path}/out")
    assert {r["event_id"] for r in found.collect()} == set(range(200)) and found.count() == 200


def test_stream_queries_over_part_files_equal_those_over_one_file(spark, tmp_path):
    from loreloom.plans import QUERIES

    given = "/root/testdata/sf0.001"
    for name in ("events", "supplier"):
        spark.read.parquet(f"{given}/{name}.parquet").repartition(4).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("once_stream", "outbox_stream", "clock_window", "rate_window", "interrupted_stream"):
        one, parts = (QUERIES[name](spark, folder) for folder in (given, str(tmp_path)))
        assert one.count() > 0 and one.exceptAll(parts).count() == 0 and parts.exceptAll(one).count() == 0, name


def test_clock_windows_count_files_in_any_order(spark, tmp_path, monkeypatch):
    from loreloom.plans import QUERIES

    rng = random.Random(5)
    rows = [(i % 3, i, "x", START + dt.timedelta(minutes=rng.randrange(30 * 24 * 60))) for i in range(300)]
    rows.sort(key=lambda r: r[3], reverse=True)
    for n in (1, 0, 3, 2):  # one file each, newer days before older ones
        part = spark.createDataFrame(rows[n * 75:(n + 1) * 75], "user_id long, event_id long, kind string, ts timestamp")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    whole = state.read_table_stream
    monkeypatch.setattr(state, "read_table_stream", lambda spark, folder, name: whole(spark, folder, name, 1))
    expected = {}
    for user, _, _, at in rows:
        hour = (user, at.replace(minute=0))
        expected[hour] = expected.get(hour, 0) + 1
    found = {r["user_id"]: (r["windows"], r["events"], r["busiest"]) for r in QUERIES["clock_window"](spark, str(tmp_path)).collect()}
    counts = {u: [n for (user, _), n in expected.items() if user == u] for u in range(3)}
    assert found == {u: (len(c), sum(c), max(c)) for u, c in counts.items()}
