"""The compacted log, and the user view and streams that live in it."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kindred.operators import activity as act
from kindred.operators import incremental
from kindred.sources.log import Log
from kindred.streaming import streams


def newest(df):
    return df.groupBy("k").agg(F.max_by("v", "version").alias("v"), F.max("version").alias("version"))


def test_reading_opens_the_base_and_a_short_tail(spark, tmp_path):
    log = Log(spark, str(tmp_path), newest, most=3)
    with pytest.raises(ValueError, match="nothing"):
        log.read()
    for number in range(10):
        assert log.append(number, spark.createDataFrame([(number % 4, number)], "k long, v long"))
        assert not log.append(number, spark.createDataFrame([(0, -1)], "k long, v long"))
        assert len(log.state()["tail"]) < 3
    assert {(r["k"], r["v"]) for r in newest(log.read()).collect()} == {(0, 8), (1, 9), (2, 6), (3, 7)}
    assert len(list((tmp_path / "snapshots").glob("*.json"))) <= 3
    assert len(list((tmp_path / "parts").iterdir())) <= 8


def test_a_merge_that_fails_leaves_the_log_as_it_was(spark, tmp_path):
    rows = [spark.createDataFrame([(n, n)], "k long, v long") for n in range(3)]

    def broken(df):
        return df.withColumn("v", F.raise_error(F.lit("lost")).cast("long"))

    log = Log(spark, str(tmp_path), broken, most=2)
    log.append(0, rows[0])
    with pytest.raises(Exception, match="lost"):
        log.append(1, rows[1])  # the part counts, the merge after it fails
    whole = Log(spark, str(tmp_path), newest, most=2)
    assert not whole.append(1, rows[1])  # so a retry of the batch changes nothing
    whole.append(2, rows[2])
    assert sorted(r["k"] for r in whole.read().collect()) == [0, 1, 2] and whole.state()["tail"] == []


def test_deltas_equal_the_full_rebuild(spark, tmp_path):
    rng, kind = random.Random(9), "event_id long, user_id long, action string, ts timestamp"

    def event(i):
        at = None if i % 17 == 0 else datetime(2024, 5, 1) + timedelta(hours=rng.randrange(90))
        return (i, rng.choice([None, 1, 2, 3, 4]), rng.choice(["view", "search", "add_watchlist", "other"]), at)

    wishes = spark.createDataFrame([(1, ["A", "B"]), (3, [])], "user_id long, favorite_genres array<string>")
    view, alive = incremental.user_view(spark, str(tmp_path), most=3), []
    for number in range(5):
        added = [event(100 * number + i) for i in range(40)]
        gone = rng.sample(alive, len(alive) // 3) if number % 2 else []
        if number == 3:
            gone += [e for e in alive if e[1] == 2 and e not in gone]
            added = [e for e in added if e[1] != 2]
        alive = [e for e in alive if e not in gone] + added
        frames = [spark.createDataFrame(rows, kind) for rows in (added, gone, alive)]
        for _ in range(2):
            incremental.apply_delta(view, number, frames[0], frames[1] if gone else None, frames[2])
        for fanout in (False, True):
            got = incremental.read_user_view(view, wishes, fanout).collect()
            want = act.user_features(frames[2], wishes, fanout).collect()
            assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_many_batches_of_a_stream_leave_a_short_tail(spark, tmp_path):
    path, kind = str(tmp_path / "in"), "trace_id string, type string, data string, pos long"
    for n in range(20):
        rows = [(f"t{n % 3}", "request", f"q{n}", n), (f"t{n % 3}", "external_api", "c", n)]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    source = streams.read_folder(spark, path, kind, files=1)
    for _ in range(2):
        streams.trace_stream(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["trace_id"]: (r["request"], r["external_calls"]) for r in streams.read_trace_records(spark, str(tmp_path / "out")).collect()}
    assert got == {"t0": ("q18", 7), "t1": ("q19", 7), "t2": ("q17", 6)}
    state = streams.trace_log(spark, str(tmp_path / "out")).state()
    assert state["base"] and len(state["tail"]) == 4
