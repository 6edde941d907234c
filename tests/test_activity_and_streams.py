"""Activity analytics on literal cases; streams give what the batch forms give."""

from pyspark.sql import functions as F

from kindred.operators import activity as act
from kindred.sources import files
from kindred.sources import warehouse as wh
from kindred.streaming import streams

KIND = "event_id bigint, user_id bigint, action string, item_id bigint, ts timestamp"


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, user_id bigint, action string, item_id bigint, at string").select(
        "event_id", "user_id", "action", "item_id", F.to_timestamp("at").alias("ts"))


def test_user_features_and_fanout(spark):
    log = events(spark, [(1, 1, "view", 5, "2024-01-01 00:00:00"), (2, 1, "view", 6, "2024-01-02 00:00:00"),
                         (3, None, "view", 6, "2024-01-02 00:00:00"), (4, 2, "search", None, "2024-01-03 00:00:00")])
    wishes = spark.createDataFrame([(1, ["A", "B", "C"])], "user_id bigint, favorite_genres array<string>")
    got = {r["user_id"]: (r["view_count"], r["search_count"], r["favorite_genres"]) for r in act.user_features(log, wishes).collect()}
    assert got == {1: (2, 0, ["A", "B", "C"]), 2: (0, 1, None)}
    fan = {r["user_id"]: r["view_count"] for r in act.user_features(log, wishes, fanout=True).collect()}
    assert fan == {1: 6, 2: 0}


def test_sessions_span_midnight(spark):
    log = events(spark, [(1, 1, "search", 5, "2024-01-01 23:50:00"), (2, 1, "view", 6, "2024-01-02 00:10:00"),
                         (3, 1, "add_watchlist", 6, "2024-01-02 00:30:00"), (4, 1, "view", 6, "2024-01-02 01:30:00")])
    got = sorted((r["events"], r["depth"]) for r in act.session_funnel(log).collect())
    assert got == [(1, 0), (3, 3)]


def test_sessions_of_a_user_with_a_third_of_all_events_on_one_day(spark):
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(2), datetime(2024, 1, 1)
    rows = [(k, 0, rng.choice(act.FUNNEL), 1, start + timedelta(minutes=rng.choice([0, 1, 5, 6, 7, 8, 14]) * 100 + rng.randrange(60), microseconds=k)) for k in range(1000)]
    rows += [(1000 + k, 1 + k % 40, rng.choice(act.FUNNEL), 1, start + timedelta(hours=rng.random() * 90)) for k in range(2000)]
    rows += [(5000 + k, 50, "view", 1, start + timedelta(minutes=m)) for k, m in enumerate((0, 30, 60, 91, 91, 121))]  # exactly a gap apart is together
    log = spark.createDataFrame(rows, "event_id long, user_id long, action string, item_id long, ts timestamp")
    want = set()
    for user in {r[1] for r in rows}:
        mine, held = sorted((r[4], r[2]) for r in rows if r[1] == user), []
        for at, action in [*mine, (datetime.max, None)]:
            if held and at - held[-1][0] > timedelta(minutes=30):
                firsts = [min((t for t, a in held if a == step), default=None) for step in act.FUNNEL]
                want.add((user, held[0][0], held[-1][0] + timedelta(minutes=30), len(held), *firsts))
                held = []
            held.append((at, action))
    got = act.session_funnel(log).select("user_id", "session_start", "session_end", "events", *[f"first_{s}" for s in act.FUNNEL])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {tuple(r) for r in act.sessions(log).collect()} == {w[:4] for w in want}


def test_constraints_and_names(spark):
    profiles = spark.createDataFrame([(1, "Good_one", "b"), (2, "x", "b"), (3, "bad name", "b" * 501), (4, "good_ONE", None)], "user_id bigint, username string, bio string")
    watch = spark.createDataFrame([(1, "12", None), (1, "12", None), (2, "abc", "n" * 1001)], "user_id bigint, item_id string, notes string")
    log = spark.createDataFrame([("", None), ("view", "7"), ("view", "z")], "action string, item_id string")
    got = {r["rule"]: r["violations"] for r in act.constraint_report(profiles, watch, log).collect()}
    assert got == {"username_length": 1, "username_format": 1, "bio_length": 1, "item_id_format": 1, "notes_length": 1, "action_not_empty": 1,
                   "activity_item_id_format": 1, "username_unique": 1, "watchlist_unique": 1}
    asked = spark.createDataFrame([("GOOD_one",), ("free_name",), ("ab",), (None,)], "username string")
    assert {r["username"]: r["available"] for r in act.username_availability(asked, profiles).collect()} == {
        "GOOD_one": False, "free_name": True, "ab": False, None: False}


def test_trace_log(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.json").write_text(
        '{"trace_id": "t", "type": "request", "timestamp": "1", "data": "r"}\nnot json\n'
        '{"trace_id": "t", "type": "prediction", "timestamp": "2", "data": "p1"}\n{"trace_id": "t", "type": "prediction", "timestamp": "3", "data": "p2"}\n')
    rows = files.read_traces(spark, str(path)).withColumn("pos", F.col("timestamp"))
    asked = spark.createDataFrame([("t",), ("unknown",)], "trace_id string")
    got = {r["trace_id"]: (r["request"], r["prediction"], r["external_calls"]) for r in act.trace_audit(rows, asked).collect()}
    assert got == {"t": ("r", "p2", 0), "unknown": (None, None, 0)}


def landed(spark, folder, tmp_path, copies=1):
    path = str(tmp_path / "in")
    for _ in range(copies):
        wh.activity(spark, folder).repartition(3).write.mode("append").parquet(path)
    return streams.read_folder(spark, path, spark.read.parquet(path).schema, files=2)


def test_ingest_is_idempotent(spark, folder, tmp_path):
    source = landed(spark, folder, tmp_path, copies=2)
    streams.run(streams.interaction_ingest(source, "60 days"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == stored.select("event_id").distinct().count() == wh.activity(spark, folder).count()


def test_closed_windows_and_sessions_equal_the_batch(spark, folder, tmp_path):
    source = landed(spark, folder, tmp_path)
    for name, stream, batch in (
        ("w", streams.activity_counts_windowed(source, lateness="40 days"), act.activity_counts(wh.activity(spark, folder))),
        ("s", streams.session_stream(source, "6 hours", lateness="40 days"), act.sessions(wh.activity(spark, folder), "6 hours")),
    ):
        query = stream.writeStream.format("memory").queryName(f"mem_{name}").outputMode("complete").start()
        query.processAllAvailable()
        query.stop()
        got = spark.table(f"mem_{name}")
        assert sorted(got.select(batch.columns).collect()) == sorted(batch.collect())


def test_append_mode_gives_closed_windows_and_drops_what_comes_after_them(spark, tmp_path):
    path, kind = str(tmp_path / "in"), "event_id bigint, user_id bigint, action string, ts timestamp"
    day = lambda text: __import__("datetime").datetime.fromisoformat(f"2024-05-{text}")
    arrivals = [
        [(1, 1, "view", day("01 10:05")), (2, 1, "view", day("01 10:20")), (3, 2, "search", day("01 12:00"))],
        [(4, 1, "view", day("04 00:00"))], [(7, 1, "view", day("04 00:05"))], [(5, 1, "view", day("01 10:30")), (6, 1, "view", day("04 00:10"))],
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    counts = streams.activity_counts_windowed(streams.read_folder(spark, path, kind, files=1))
    streams.run(counts, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r["window_start"].day, r["window_start"].hour): (r["view_count"], r["search_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(1, 10): (2, 0), (1, 12): (0, 1)}  # event 5 is later than its closed window, the windows of day 4 are open


def test_late_repeated_and_malformed_events(spark, tmp_path):
    path, kind = str(tmp_path / "in"), "event_id bigint, user_id bigint, action string, ts timestamp"
    day = lambda n: __import__("datetime").datetime(2024, 5, n)
    for rows in ([(1, 1, "view", day(20)), (1, 1, "view", day(20))], [(2, 1, "view", day(2)), (1, 1, "view", day(20)), (3, 1, None, day(3))], [(4, None, "view", day(4)), (2, 1, "view", day(2))]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    source = streams.read_folder(spark, path, kind, files=1)
    for _ in range(2):
        streams.ingest_with_quarantine(source, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / "good")).collect()) == [1, 2]
    assert [r["event_id"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [3]


def test_an_id_on_another_day_is_stored_once_however_the_stream_is_cut(spark, tmp_path):
    kind = "event_id bigint, user_id bigint, action string, ts timestamp"
    day = lambda n: __import__("datetime").datetime(2024, 5, n)
    rows = [(1, 1, "view", day(20)), (2, 1, "view", day(20)), (1, 1, "view", day(21)), (3, None, "view", day(21)), (2, 1, "view", day(2)), (4, 2, "view", day(2)), (5, None, None, day(2))]
    for cut in (1, 3, 7):
        path, out = str(tmp_path / f"in{cut}"), str(tmp_path / f"out{cut}")
        for a in range(0, len(rows), cut):
            spark.createDataFrame(rows[a : a + cut], kind).coalesce(1).write.mode("append").parquet(path)
        streams.ingest_with_quarantine(streams.read_folder(spark, path, kind, files=1), f"{out}/good", f"{out}/bad", f"{out}/cp").awaitTermination()
        assert sorted(r["event_id"] for r in spark.read.parquet(f"{out}/good").collect()) == [1, 2, 4]
        assert [r["event_id"] for r in spark.read.parquet(f"{out}/bad").collect()] == [5]
        assert [(r["event_id"], r["reason"]) for r in spark.read.parquet(f"{out}/bad_no_user").collect()] == [(3, "no user")]


def test_answers_within_an_interval(spark, tmp_path):
    path, kind = str(tmp_path / "in"), "trace_id string, type string, data string, ts timestamp"
    at = lambda minute: __import__("datetime").datetime(2024, 5, 1, 8, minute)
    rows = [("a", "request", "q", at(0)), ("a", "prediction", "p", at(4)), ("b", "request", "q", at(0)), ("b", "prediction", "late", at(30)), ("c", "prediction", "alone", at(1))]
    spark.createDataFrame(rows, kind).write.parquet(path)
    streams.run(streams.answered_requests(streams.read_folder(spark, path, kind)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [(r["trace_id"], r["prediction"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", "p")]


def test_trending_traces_and_delta(spark, folder, tmp_path):
    streams.trending_windowed(landed(spark, folder, tmp_path), str(tmp_path / "t"), str(tmp_path / "tc"), lateness="40 days").awaitTermination()
    got = streams.read_trending(spark, str(tmp_path / "t")).select("window_start", "item_id", "n", "rank")
    want = act.trending(wh.activity(spark, folder)).select("window_start", "item_id", "n", "rank")
    assert sorted(got.collect()) == sorted(want.collect())
    pages = str(tmp_path / "pages")
    for part in ("item_id < 50", "item_id >= 30"):
        wh.activity(spark, folder).filter(part).select("item_id", F.col("event_id").alias("pos")).coalesce(1).write.mode("append").parquet(pages)
    source = streams.read_folder(spark, pages, "item_id bigint, pos bigint", files=1)
    streams.catalogue_delta_stream(source, str(tmp_path / "d"), str(tmp_path / "dc")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "d"))
    assert stored.count() == stored.select("item_id").distinct().count() == wh.activity(spark, folder).select("item_id").distinct().count()
