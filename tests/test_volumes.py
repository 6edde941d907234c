"""What steps send and hold: rows in packs, tables computed once, lists without expansion."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F

from kindred.operators import activity, collab, content, factor
from kindred.operators import similarity as sim
from kindred.sources import files, warehouse


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_packs_hold_all_rows_in_few_bytes(spark):
    cells = spark.range(80_000).select((F.col("id") % 2000).alias("id"), F.xxhash64("id").alias("dim"), (F.col("id") % 50 / 5).alias("w")).filter("w <> 0")
    packed = sim.pack(cells.withColumn("dim", F.pmod("dim", F.lit(120_000))), scale=True)
    packs = [sim.unpacked(bytes(r["pack"])) for r in sim.packs(packed).collect()]
    told = {i: (d, w, n) for p in packs for i, d, w, n in zip(*(p.column(c).to_pylist() for c in ("id", "dims", "ws", "norm")))}
    assert told == {r["id"]: (list(r["dims"]), list(r["ws"]), r["norm"]) for r in packed.collect()}
    sent = sum(len(r["pack"]) for r in sim.packs(packed).collect())
    assert sent < 16 * sum(len(d) for d, _, _ in told.values()) / 2


def test_predictions_send_packs(spark):
    rng = np.random.default_rng(5)
    rows = [(int(u), int(i), float(rng.integers(1, 11))) for u in range(60) for i in rng.choice(40, 8, replace=False)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    assert "pack" in plan(collab.predict_user_based(ratings, ratings))
    assert "pack" in plan(collab.recommend_item_based(ratings))


def test_ratings_are_joined_once(spark, tmp_path):
    lines = [(1, 7, 10.0), (1, 7, 20.0), (2, 7, 5.0), (3, 8, 1.0), (None, 8, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 4), (2, 4), (3, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    found = warehouse.ratings(spark, str(tmp_path))
    assert "Join" not in plan(found)
    assert {(r[0], r[1], round(r[2], 6)) for r in found.collect()} == {(4, 7, round(7 / 3, 6)), (None, 8, 0.2)}


def test_spare_slots_never_leave_the_row_of_their_user(spark):
    users, items = spark.range(30).withColumnRenamed("id", "user_id"), spark.range(40).withColumnRenamed("id", "item_id")
    found = files.synth_ratings(users, items)
    assert "min(slot" not in plan(found)

    def digest(*keys):
        return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16)

    ids = sorted(range(40), key=lambda i: (digest(i, "item42"), i))
    expected = set()
    for user in range(30):
        places = list(dict.fromkeys(digest(user, slot, "slot42") % 40 for slot in range(117)))[: digest(user, "count42") % 25 + 5]
        expected |= {(user, ids[p], float(digest(user, ids[p], "rating42") % 10 + 1)) for p in places}
    assert {tuple(r) for r in found.collect()} == expected


def test_lists_are_cut_from_one_list_of_a_key(spark):
    rows = [(i, f"d{i % 3}", float(i % 5)) for i in range(40)] + [(7, "d2", 9.0), (7, "d1", 9.0), (None, "d0", 9.0)]
    found = content.same_director(spark.createDataFrame(rows, "item_id long, director string, rating double"), 4)
    assert "posexplode" in plan(found)
    met = {}
    for item, director, _ in rows:
        if item is not None:
            ranked = sorted((r for r in rows if r[1] == director), key=lambda r: (-r[2], r[0] if r[0] is not None else -1))[:5]
            met.setdefault(item, []).extend((-r[2], r[0]) for r in ranked if r[0] is not None and r[0] != item)
    expected = {(item, other, -rating, rank) for item, others in met.items() for rank, (rating, other) in enumerate(sorted(others)[:4], 1)}
    assert {tuple(r) for r in found.collect()} == expected


def test_tastes_are_counted_where_they_are_listed(spark):
    ratings = spark.createDataFrame([(u, i) for u in (1, 2, None) for i in range(6)] + [(1, 5)], "user_id long, item_id long")
    items = spark.createDataFrame([(0, "b, a"), (1, "a"), (2, "c, Unknown"), (3, "d"), (4, None), (5, "d, d"), (5, "e")], "item_id long, genre string")
    found = activity.preferences_from_ratings(ratings, items)
    assert "RepartitionByExpression [user_id" in plan(found)
    assert {r["user_id"]: r["favorite_genres"] for r in found.collect()} == {1: ["a", "d", "e"], 2: ["a", "b", "d"], None: ["a", "b", "d"]}


def test_ratings_of_users_without_a_list_are_not_sent(spark, monkeypatch):
    sent = []
    whole = sim.block_topn
    monkeypatch.setattr(sim, "block_topn", lambda *args, exclude, **more: sent.append(exclude) or whole(*args, exclude=exclude, **more))
    ratings = spark.createDataFrame([(u, i, 5.0) for u in range(50) for i in range(3)], "user_id long, item_id long, rating double")
    users = spark.createDataFrame([(4, [1.0, 2.0]), (60, [2.0, 1.0])], "user_id long, factors array<double>")
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "item_id long, factors array<double>")
    found = factor.mf_recommend(ratings, users, items, n=3)
    assert {r["id"] for r in sent[0].collect()} == {4}
    assert [(r["user_id"], r["item_id"]) for r in found.orderBy("user_id", "rank").collect()] == [(4, 4), (4, 3), (60, 4), (60, 3), (60, 2)]


def test_a_block_lets_go_of_what_it_was_sent():
    ids, cells = 3000, 100
    lists = lambda kind, values: pa.ListArray.from_arrays(np.arange(0, ids * cells + 1, cells, dtype=np.int32), pa.compute.add(pa.array(values, kind), 0))
    none, own = pa.nulls(ids, pa.int64()), pa.array(np.arange(ids))
    fill = pa.array([None] * ids, pa.list_(pa.int64()))

    def sent():
        for side in (0, 1):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(ids, side, dtype=np.int32)), own if side == 0 else none, own if side else none,
                lists(pa.int64(), np.tile(np.arange(cells), ids)), lists(pa.float64(), np.ones(ids * cells)), fill,
            ], ["side", "tid", "cid", "dims", "ws", "masked"])

    before = pa.total_allocated_bytes()
    found = sim._best_of_block(3, None, None, True)(sent())
    next(found)
    assert pa.total_allocated_bytes() - before < 2 * ids * cells * 16


def test_tasks_of_predictions_read_the_rows_from_files(spark):
    """No row is shuffled for every block of targets: the tasks' lists are joined with stored packs, and nothing is joined after."""
    ratings = spark.createDataFrame([(u, i, float(1 + u * i % 7)) for u in range(300) for i in range(u % 5, 40, 5)], "user_id long, item_id long, rating double")
    for found in (collab.predict_user_based(ratings, ratings), collab.recommend_item_based(ratings)):
        told = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in told and "SortMergeJoin" not in told and "FlatMapGroupsInArrow" not in told


def test_every_cell_asked_for_is_told_once_from_many_blocks(spark, monkeypatch):
    """Also those that repeat, are null or have a user or an item without ratings."""
    rows = [(u, i, float(1 + (u * i + u) % 9)) for u in range(60) for i in range(u % 3, 30, 3)]
    kind = "user_id long, item_id long, rating double"
    ratings = spark.createDataFrame(rows, kind)
    odd = [(1, 4, 0.0), (1, 4, 0.0), (1, 3, 0.0), (777, 4, 0.0), (1, 888, 0.0), (None, 4, 0.0), (1, None, 0.0), (777, 888, 0.0)]
    asked = spark.createDataFrame(odd, kind)
    told = lambda df: sorted(((r["user_id"], r["item_id"], round(r["score"], 9)) for r in df.collect()), key=str)
    whole = told(collab.predict_user_based(ratings, asked, k=3, hot_column=1))  # the other path
    assert len(whole) == len(odd) and sum(s > 0 for *_, s in whole) >= 2
    one, lists = told(collab.predict_user_based(ratings, asked, k=3)), told(collab.recommend_item_based(ratings, n=4, k=3, hot_column=1))
    monkeypatch.setattr(collab, "TARGET_ROWS", 3)
    assert told(collab.predict_user_based(ratings, asked, k=3)) == one == whole
    assert told(collab.recommend_item_based(ratings, n=4, k=3)) == lists
    none = ratings.limit(0)
    assert told(collab.predict_user_based(none, asked)) == sorted(((u, i, 0.0) for u, i, _ in odd), key=str)
    assert told(collab.recommend_item_based(none)) == []


def test_tastes_are_counted_in_small_parts(spark):
    """A part has 100,000 ratings on a small table as on a large one."""
    ratings = spark.range(700_000).select((F.col("id") % 5000).alias("user_id"), F.lit(1).cast("long").alias("item_id"), F.lit(1.0).alias("rating"))
    items = spark.createDataFrame([(1, "drama, crime")], "item_id long, genre string")
    found = activity.preferences_from_ratings(ratings, items)
    assert "RepartitionByExpression [user_id" in plan(found) and "], 7" in plan(found)
    assert found.count() == 5000 and found.first()["favorite_genres"] == ["crime", "drama"]
