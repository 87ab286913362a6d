"""Event-time order over shuffled part files, one file per trigger."""

import datetime as dt
import random

import pytest

from loreloom.streaming import timers

START = dt.datetime(2024, 1, 1)


def source(spark, tmp_path, rows, files):
    for n in range(files):
        spark.createDataFrame(rows[n::files], "user_id long, event_id long, kind string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/f{n}")
    schema = spark.read.parquet(f"{tmp_path}/in/f0").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def events(rng, n):
    rows = [(rng.choice([1, 1, 2, 3, None]), i, rng.choice(["start", "end", "x"]), START + dt.timedelta(seconds=rng.randrange(900))) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("files", [1, 4])
def test_rate_windows_do_not_depend_on_files(spark, tmp_path, files):
    rows = events(random.Random(files), 120)
    stream = source(spark, tmp_path, rows, files)
    done, progress = timers.run_to_end(
        stream, lambda s: timers.folded(s, "user_id", "ts", "event_id", None, timers.rate_fold(4, 60),
                                        "event_id bigint, start bigint, n bigint, accepted boolean", "20 minutes"), "ts")
    windows, expected = {}, {}
    for user, event, _, at in sorted(rows, key=lambda r: (r[3], r[1])):
        begun, count = windows.get(user, (None, 0))
        if begun is None or at > begun + dt.timedelta(seconds=60):
            begun, count = at, 0
        windows[user] = (begun, count + 1)
        expected[event] = (user, count + 1, count + 1 <= 4)
    assert {r["event_id"]: (r["user_id"], r["n"], r["accepted"]) for r in done.collect()} == expected
    held = spark.read.format("statestore").option("stateVarName", "kept").load(progress)
    assert held.count() == 0


def test_work_without_an_end_is_interrupted(spark, tmp_path):
    rows = events(random.Random(9), 90)
    done, _ = timers.run_to_end(
        source(spark, tmp_path, rows, 3), lambda s: timers.folded(
            s, "user_id", "ts", "event_id", "kind", timers.work_fold("start", "end", 30),
            "event_id bigint, status string, at_us bigint", "20 minutes"), "ts")
    expected = {}
    for user, event, kind, at in rows:
        if kind == "start":
            ends = [r[3] for r in rows if r[0] == user and r[2] == "end" and (at, event) < (r[3], r[1]) and r[3] <= at + dt.timedelta(seconds=30)]
            expected[event] = "succeeded" if ends else "interrupted"
    assert {r["event_id"]: r["status"] for r in done.collect()} == expected


def test_kinds_without_a_part_are_not_kept(spark, tmp_path):
    rows = events(random.Random(4), 60) + [(8, 900, "x", START), (9, 901, None, START)]
    kind = "event_id bigint, status string, at_us bigint"
    run = lambda acting, folder: timers.run_to_end(
        source(spark, tmp_path / folder, rows, 2), lambda s: timers.folded(
            s, "user_id", "ts", "event_id", "kind", timers.work_fold("start", "end", 30), kind, "20 minutes", acting), "ts")
    (done, _), (every, _) = run(("start", "end"), "a"), run(None, "b")
    assert sorted(map(str, done.collect())) == sorted(map(str, every.collect())) and done.count()
    acting = timers.folded(source(spark, tmp_path / "c", rows, 1), "user_id", "ts", "event_id", "kind", timers.work_fold("start", "end", 30), kind, "20 minutes", ("start", "end"))
    assert "IN (start,end)" in acting._jdf.queryExecution().analyzed().toString()
