"""Sessions with ordered steps as keyed state: out of order, late, restarted, and what is left at the end."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.operators import activity as act
from kindred.streaming import funnel, streams

KIND = "event_id bigint, user_id bigint, action string, ts timestamp"


def at(text):
    return datetime.datetime.fromisoformat(f"2024-05-{text}")


def land(spark, path, *arrivals):
    for rows in arrivals:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)


def drain(spark, tmp_path, lateness="1 day"):
    stream = funnel.funnel_stream(streams.read_folder(spark, str(tmp_path / "in"), KIND, files=1), lateness=lateness)
    query = streams.run(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    return sorted((r["user_id"], r["session_start"].isoformat(sep=" ")[8:16], r["events"], r["depth"]) for r in rows)


def test_steps_out_of_order_and_late_events(spark, tmp_path):
    land(
        spark, str(tmp_path / "in"),
        [(1, 1, "add_watchlist", at("01 10:20")), (2, 1, "search", at("01 10:00")), (3, 2, "view", at("01 12:00"))],
        [(4, 1, "view", at("01 10:10")), (5, 1, "view", at("01 11:05"))],  # the first session gets its middle step, a second one opens
        [(6, 1, "search", at("01 10:40"))],  # joins both
        [(7, None, "view", at("01 10:00")), (8, 3, "search", None), (9, 9, "view", at("04 00:00"))],
        [(10, 9, "view", at("04 00:05"))],
        [(11, 1, "view", at("01 10:30")), (12, 2, "search", at("01 11:50")), (13, 9, "view", at("04 00:10"))],  # after expiry
    )
    assert drain(spark, tmp_path) == [(1, "01 10:00", 5, 3), (2, "01 12:00", 1, 0)]
    held = funnel.open_sessions(spark, str(tmp_path / "cp"))
    assert [r["key"]["user_id"] for r in held.select("key").collect()] == [9]


def test_a_restart_goes_on_with_its_state(spark, tmp_path):
    land(spark, str(tmp_path / "in"), [(1, 1, "search", at("01 10:00")), (2, 2, "search", at("01 10:00"))])
    assert drain(spark, tmp_path) == []
    land(spark, str(tmp_path / "in"), [(3, 1, "view", at("01 10:10"))], [(4, 9, "view", at("09 00:00"))])
    assert drain(spark, tmp_path) == [(1, "01 10:00", 2, 2), (2, "01 10:00", 1, 1)]
    assert drain(spark, tmp_path) == [(1, "01 10:00", 2, 2), (2, "01 10:00", 1, 1)]


def test_the_stream_gives_what_the_batch_gives(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 12)), str(rng.choice(["search", "view", "add_watchlist", "filter"])), at("01 00:00") + datetime.timedelta(seconds=int(s)))
            for i, s in enumerate(rng.permutation(np.arange(0, 86_000, 97)))]
    rows += [(10_000 + k, 5, "view", at("01 03:00") + datetime.timedelta(seconds=k)) for k in range(600)]  # one user with a crowd of events
    batch = act.session_funnel(spark.createDataFrame(rows, KIND))
    land(spark, str(tmp_path / "in"), *(rows[k::4] for k in range(4)), [(-1, -1, "view", at("20 00:00"))])
    stream = funnel.funnel_stream(streams.read_folder(spark, str(tmp_path / "in"), KIND, files=1), lateness="2 days")
    streams.run(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    columns = ["user_id", "session_start", "session_end", "events", "first_search", "first_view", "first_add_watchlist", "depth"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, batch.select(columns).collect()))


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_pieces_merge_alike_however_they_are_cut(parts):
    rng = np.random.default_rng(5)
    times = rng.integers(0, 400, 60)
    events = pd.DataFrame({"first": times, "last": times, "events": 1, "step0": np.where(times % 3 == 0, times, funnel.NEVER)})
    whole = funnel.merged(events, 5)
    held = events.iloc[:0]
    for k in rng.permutation(parts):
        held = funnel.merged(pd.concat([held, events.iloc[k::parts]]), 5)
    assert held.to_numpy().tolist() == whole.to_numpy().tolist() and len(whole) > 5


def test_state_is_a_row_for_each_open_session(spark, tmp_path):
    land(spark, str(tmp_path / "in"), [(k, 1, "view", at("01 10:00") + datetime.timedelta(seconds=k)) for k in range(500)] + [(999, 1, "view", at("01 20:00"))])
    assert drain(spark, tmp_path) == []
    assert sorted(r["n"] for r in funnel.open_sessions(spark, str(tmp_path / "cp")).select(F.col("list_element.events").alias("n")).collect()) == [1, 500]
