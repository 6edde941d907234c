"""Similarities, predictions and factors: literal fixtures, brute force and invariance."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import ranking, stats
from kindred.operators import collab, factor
from kindred.operators import similarity as sim

# Two readers of crime, two of travel, and one of both.
DEMO = {
    ("bo", "fog"): 8, ("bo", "knife"): 6, ("kim", "fog"): 4, ("kim", "knife"): 7, ("kim", "alibi"): 9, ("lu", "delta"): 3, ("lu", "atlas"): 10,
    ("mei", "delta"): 6, ("mei", "reef"): 2, ("noor", "alibi"): 5, ("noor", "atlas"): 7,
}


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame([(u, i, float(r)) for (u, i), r in DEMO.items()], "user_id string, item_id string, rating double")


def pairs(df, digits=6):
    return {(r[0], r[1]): round(r[2], digits) for r in df.collect()}


def test_user_and_item_cosine(demo):
    # bo and kim: 8 * 4 + 6 * 7 = 74 over lengths 10 and sqrt(146).
    users = pairs(collab.user_cosine(demo))
    assert users["bo", "kim"] == round(74 / (10 * math.sqrt(146)), 6) and ("bo", "lu") not in users
    assert users == {k: round(v, 6) for k, v in brute_cosine(DEMO).items() if k[0] < k[1]}
    turned = {(i, u): r for (u, i), r in DEMO.items()}
    assert pairs(collab.item_cosine(demo)) == {k: round(v, 6) for k, v in brute_cosine(turned).items() if k[0] < k[1]}


@pytest.mark.parametrize("run, turn", [(collab.recommend_user_based, False), (collab.recommend_item_based, True)])
@pytest.mark.parametrize("mode", ["identity", "skip_top"])
def test_recommendations_of_the_demo(demo, run, turn, mode):
    cells = {(i, u) if turn else (u, i): r for (u, i), r in DEMO.items()}
    found = brute_predictions(cells, 10, int(mode == "skip_top"))
    want = {(b, a) if turn else (a, b): pytest.approx(v, abs=2e-6) for (a, b), v in found.items() if (a, b) not in cells}
    assert {(r["user_id"], r["item_id"]): r["score"] for r in run(demo, neighbours=mode).collect()} == want


def random_ratings(seed, users=40, items=30, share=0.3, hot=True):
    rng = random.Random(seed)
    rows = {}
    for u in range(users):
        for i in range(items):
            if rng.random() < share or (hot and (i == 0 or u == 0)):
                rows[u, i] = rng.randint(1, 10)
    return rows


def brute_cosine(cells):
    vectors = defaultdict(dict)
    for (a, b), r in cells.items():
        vectors[a][b] = r
    norm = {a: math.sqrt(sum(x * x for x in v.values())) for a, v in vectors.items()}
    out = {}
    for a in vectors:
        for b in vectors:
            if a != b:
                dot = sum(x * vectors[b].get(d, 0) for d, x in vectors[a].items())
                if dot:
                    out[a, b] = dot / norm[a] / norm[b]
    return out


def brute_predictions(cells, k, skip_top):
    sims = brute_cosine(cells)
    rows, columns = {a for a, _ in cells}, {b for _, b in cells}
    out = {}
    for t in rows:
        for c in columns:
            near = sorted(((-round(sims[t, s], 9), s) for s in rows if (t, s) in sims and (s, c) in cells))[skip_top: k + skip_top]
            if near:
                weight = sum(sims[t, s] for _, s in near)
                out[t, c] = sum(sims[t, s] * cells[s, c] for _, s in near) / weight
    return out


def frame(spark, cells):
    return spark.createDataFrame([(a, b, float(r)) for (a, b), r in cells.items()], "user_id bigint, item_id bigint, rating double")


@pytest.mark.parametrize("longest", [sim.LONG_VECTOR, 12])
def test_topn_matches_brute_force_with_and_without_long_vectors(spark, longest):
    cells = random_ratings(1)
    sims = brute_cosine(cells)
    want = {}
    for t in {a for a, _ in cells}:
        near = sorted((-round(v, 9), s) for (a, s), v in sims.items() if a == t)[:5]
        want[t] = [(s, round(-v, 6)) for v, s in near]
    found = sim.cosine_topn(collab.user_cells(frame(spark, cells)), 5, longest=longest)
    got = defaultdict(list)
    for r in found.orderBy("target_id", "rank").collect():
        got[r["target_id"]].append((r["item_id"], r["score"]))
    assert dict(got) == {t: [(s, pytest.approx(v, abs=1e-6)) for s, v in rows] for t, rows in want.items()}
    all_pairs = pairs(sim.cosine_pairs(collab.user_cells(frame(spark, cells)), longest=longest))
    assert all_pairs == {k: pytest.approx(v, abs=1e-6) for k, v in sims.items() if k[0] < k[1]}


@pytest.mark.parametrize("options", [{}, {"hot_column": 10}, {"longest": 12}, {"hot_column": 10, "longest": 12}])
@pytest.mark.parametrize("mode", ["identity", "skip_top"])
def test_predictions_match_brute_force(spark, mode, options):
    cells = random_ratings(2)
    ratings = frame(spark, cells)
    brute = brute_predictions(cells, 5, int(mode == "skip_top"))
    got = collab.predict_user_based(ratings, ratings, k=5, neighbours=mode, **options)
    assert pairs(got) == {k: pytest.approx(brute.get(k, 0.0), abs=2e-6) for k in cells}
    recs = collab.recommend_user_based(ratings, n=4, k=5, neighbours=mode, **options)
    best = defaultdict(list)
    for (t, c), v in brute.items():
        if (t, c) not in cells:
            best[t].append((-round(v, 9), c))
    want = {(t, c): pytest.approx(-v, abs=2e-6) for t, rows in best.items() for v, c in sorted(rows)[:4]}
    assert {(r["user_id"], r["item_id"]): r["score"] for r in recs.collect()} == want


def test_item_based_matches_brute_force_when_users_are_hot(spark):
    cells = random_ratings(3)
    turned = {(i, u): r for (u, i), r in cells.items()}
    brute = brute_predictions(turned, 5, 0)
    got = collab.recommend_item_based(frame(spark, cells), n=30, k=5, hot_column=10)
    want = {(u, i): pytest.approx(v, abs=2e-6) for (i, u), v in brute.items() if (u, i) not in cells}
    assert {(r["user_id"], r["item_id"]): r["score"] for r in got.collect()} == want


def test_results_do_not_depend_on_blocks_or_partitions(spark, monkeypatch):
    cells = random_ratings(4)
    plain = collab.similar_users(frame(spark, cells)).collect()
    monkeypatch.setattr(sim, "TARGET_BLOCK", 7)
    monkeypatch.setattr(sim, "CANDIDATE_BLOCK", 5)
    small = collab.similar_users(frame(spark, cells).repartition(5)).collect()
    assert sorted(plain) == sorted(small)


def test_targets_limit_the_answer(spark):
    ratings = frame(spark, random_ratings(5))
    some = spark.createDataFrame([(3,), (4,), (999,)], "user_id bigint")
    every = {tuple(r) for r in collab.recommend_user_based(ratings).collect() if r["user_id"] in (3, 4)}
    assert {tuple(r) for r in collab.recommend_user_based(ratings, targets=some).collect()} == every


def test_asked_cells_and_columns_limit_the_work_and_not_the_answer(spark):
    ratings = frame(spark, random_ratings(9))
    some = spark.createDataFrame([(3,), (4,), (999,)], "user_id bigint")
    every = {tuple(r) for r in collab.recommend_item_based(ratings).collect() if r["user_id"] in (3, 4)}
    assert {tuple(r) for r in collab.recommend_item_based(ratings, targets=some).collect()} == every
    one = ratings.filter("user_id = 5 and item_id = 0")
    whole = pairs(collab.predict_user_based(ratings, ratings))
    for options in ({}, {"hot_column": 10}):
        assert pairs(collab.predict_user_based(ratings, one, **options)) == {(5, 0): whole[5, 0]}


def test_row_numbers_with_an_outlier(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_SLICE", 10)
    rows = spark.range(95).select(F.when(F.col("id") == 94, 1e300).otherwise(F.col("id") % 50).alias("x"), "id")
    got = ranking.number_rows(rows, "x", "id").orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(95)) and [(r["x"], r["id"]) for r in got] == sorted((r["x"], r["id"]) for r in got)
    assert got[-1]["id"] == 94


def test_svd_reconstruction_of_the_demo(demo):
    users, items = factor.mf_fit(demo, k=2, oversample=4, iterations=6)
    names = sorted({u for u, _ in DEMO}), sorted({i for _, i in DEMO})
    table = np.array([[DEMO.get((u, i), 0) for i in names[1]] for u in names[0]], float)
    left, values, right = np.linalg.svd(table)
    want = left[:, :2] * values[:2] @ right[:2]
    got = pairs(factor.mf_predict(demo.select("user_id").distinct().join(demo.select("item_id").distinct()), users, items, -99, 99), 5)
    assert got == {(u, i): pytest.approx(want[x, y], abs=1e-3) for x, u in enumerate(names[0]) for y, i in enumerate(names[1])}
    recs = factor.mf_recommend(demo, users, items, 10)
    assert {r["item_id"] for r in recs.filter("user_id = 'bo'").collect()} == {"alibi", "atlas", "delta", "reef"}
    assert recs.filter("score < 0 or score > 10").count() == 0
    unknown = demo.select(F.lit("nobody").alias("user_id"), "item_id").limit(1)
    assert factor.mf_predict(unknown, users, items).first()["score"] == 0.0


def test_an_opposed_neighbour_counts_against(spark):
    # The one other row that fills column 3 is exactly opposed.
    cells = {(1, 1): 2, (1, 2): -2, (2, 1): -2, (2, 2): 2, (2, 3): 3}
    ratings = frame(spark, cells)
    asked = spark.createDataFrame([(1, 3)], "user_id bigint, item_id bigint")
    for options in ({}, {"hot_column": 0}):
        assert collab.predict_user_based(ratings, asked, **options).first()["score"] == pytest.approx(-3.0)
    # A row that shares nothing takes the one place before it, and knows nothing.
    more = frame(spark, cells | {(3, 9): 1, (3, 3): 5})
    assert collab.predict_user_based(more, asked, k=1).first()["score"] == 0.0


@pytest.mark.parametrize("options", [{}, {"hot_column": 10}, {"hot_column": 10, "longest": 12}])
def test_signed_predictions_match_brute_force(spark, options):
    cells = {key: r - 5 for key, r in random_ratings(8).items() if r != 5}
    sims, rows, columns = brute_cosine(cells), {a for a, _ in cells}, {b for _, b in cells}
    want = {}
    for t, c in cells:
        near = sorted((-round(sims.get((t, s), 0.0), 9), s) for s in rows if s != t and (s, c) in cells)[:5]
        weight = sum(abs(sims.get((t, s), 0.0)) for _, s in near)
        want[t, c] = pytest.approx(sum(sims.get((t, s), 0.0) * cells[s, c] for _, s in near) / weight if weight else 0.0, abs=2e-6)
    assert columns and pairs(collab.predict_user_based(frame(spark, cells), frame(spark, cells), k=5, **options)) == want


def cancelling_ratings(seed):
    """Whole numbers of which many products cancel: every row is made of pairs of opposite ratings."""
    rng, cells = random.Random(seed), {}
    for u in range(30):
        for i in range(0, 24, 2):
            if rng.random() < 0.4:
                r = rng.choice([1, 2, 3])
                cells[u, i], cells[u, i + 1] = r, r * rng.choice([1, -1])
        cells[u, 24 + u % 5] = rng.choice([-2, 2, 5])
    return cells


@pytest.mark.parametrize("options", [{}, {"hot_column": 4}, {"longest": 8}, {"hot_column": 4, "longest": 8}])
def test_products_that_cancel_are_zero(spark, options):
    """Dots are whole numbers here; a row similar by exactly 0 must not become a neighbour through rounding."""
    cells = cancelling_ratings(13)
    sims, rows, columns = brute_cosine(cells), {a for a, _ in cells}, {b for _, b in cells}
    assert len(sims) < len(rows) * (len(rows) - 1) * 0.9
    longest = {"longest": options["longest"]} if "longest" in options else {}
    found = pairs(sim.cosine_pairs(collab.user_cells(frame(spark, cells)), **longest), 9)
    assert found == {k: pytest.approx(v, abs=1e-9) for k, v in sims.items() if k[0] < k[1]}
    nearest = sim.cosine_topn(collab.user_cells(frame(spark, cells)), 40, **longest).collect()
    assert {(r["target_id"], r["item_id"]) for r in nearest} == {k for k, v in sims.items() if v > 0}
    want = {}
    for t in rows:
        for c in columns:
            near = sorted((-round(sims.get((t, s), 0.0), 9), s) for s in rows if s != t and (s, c) in cells)[:5]
            weight = math.fsum(abs(sims.get((t, s), 0.0)) for _, s in near)
            total = math.fsum(sims.get((t, s), 0.0) * cells[s, c] for _, s in near)
            want[t, c] = pytest.approx(total / weight if weight else 0.0, abs=2e-6)
    every = frame(spark, cells).select("user_id").distinct().crossJoin(frame(spark, cells).select("item_id").distinct())
    assert pairs(collab.predict_user_based(frame(spark, cells), every, k=5, **options)) == want


def test_scores_of_any_size_are_ranked(spark):
    rows = spark.createDataFrame([(i, [0], [w]) for i, w in enumerate([9e9, 5e9, 3e9, 2e9, 1e3, -5e4, -8e12])], "id bigint, dims array<int>, ws array<double>")
    one = spark.createDataFrame([(99, [0], [1.0])], "id bigint, dims array<int>, ws array<double>")
    got = sim.block_topn(one, rows, 7, 1, 7, floor=None).orderBy("rank").collect()
    assert [r["score"] for r in got] == [9e9, 5e9, 3e9, 2e9, 1e3, -5e4, -8e12]
    assert [r["item_id"] for r in sim.block_topn(one, rows, 2, 1, 7).orderBy("rank").collect()] == [0, 1]


def test_best_columns_take_ties_in_order():
    scores = np.array([[1.0, 2, 2, 2, 0], [-np.inf, -5, -5, -7, -np.inf], [3, 3, 3, 3, 3]])
    assert sim.best_columns(scores, 2).tolist() == [[1, 2], [1, 2], [0, 1]]


def test_split_and_centering(spark):
    ratings = frame(spark, random_ratings(6))
    split = collab.train_test_split(ratings)
    again = collab.train_test_split(ratings.repartition(7))
    assert sorted(split.collect()) == sorted(again.collect())
    centred = collab.mean_center(ratings).groupBy("user_id").agg(F.sum("rating").alias("s"))
    assert centred.filter("abs(s) > 1e-9").count() == 0


def test_medians_with_extreme_outliers(spark):
    values = [1e300, -1e300, *range(100), *[7.0] * 40]
    rows = spark.createDataFrame([(float(v), None if v == 7.0 else float(v)) for v in values], "a double, b double")
    got = {r["feature"]: (r["lo"], r["hi"], r["median"]) for r in stats.column_stats(rows, ["a", "b"]).collect()}
    b = [v for v in values if v != 7.0]
    assert got == {"a": (-1e300, 1e300, float(np.median(values))), "b": (-1e300, 1e300, float(np.median(b)))}


def test_predictions_send_the_table_once_for_a_large_block_of_targets(spark, monkeypatch):
    """Many rows of a sparse table: the number of grid tasks, each of which is sent whole rows, follows the targets alone."""
    monkeypatch.setattr(sim, "CANDIDATE_BLOCK", 20)
    asked_for = []
    by_task = sim.by_task
    monkeypatch.setattr(sim, "by_task", lambda rows, tasks: asked_for.append(tasks) or by_task(rows, tasks))
    rows = [(u, (u * 7 + x * x) % 150, float(1 + (u + x) % 9)) for u in range(300) for x in range(6)]
    ratings = frame(spark, {(u, i): r for u, i, r in rows})
    collab.predict_user_based(ratings, ratings, k=3)
    collab.recommend_user_based(ratings, n=3, k=3)
    assert max(asked_for) <= sim.cores(ratings)


def test_rows_are_sent_to_few_blocks(spark, monkeypatch):
    """All pairs and top-n of many rows: the number of tasks, and with it how often a row is sent, stays at what the cores ask for."""
    monkeypatch.setattr(sim, "TARGET_BLOCK", 4)
    asked_for = []
    by_task = sim.by_task
    monkeypatch.setattr(sim, "by_task", lambda rows, tasks: asked_for.append(tasks) or by_task(rows, tasks))
    rows = [(u, (u * 7 + x * x) % 150, float(1 + (u + x) % 9)) for u in range(600) for x in range(4)]
    cells = collab.user_cells(frame(spark, {(u, i): r for u, i, r in rows}))
    most = max(sim.cores(cells), -(-600 // (4 * sim.SENT_BLOCKS)))
    sim.cosine_pairs(cells)
    sim.cosine_topn(cells, 3)
    assert asked_for[0] <= most * (most + 1) // 2 and asked_for[1] <= most


def test_strips_of_pairs_and_targets_lose_nothing(spark, monkeypatch):
    rows = {(u, (u * 7 + x * x) % 40): float(1 + (u + x) % 9) for u in range(90) for x in range(6)}
    cells = collab.user_cells(frame(spark, rows))
    whole = sorted(map(tuple, sim.cosine_pairs(cells).select("a", "b", "sim").collect()))
    nearest = sorted(map(tuple, sim.cosine_topn(cells, 4).collect()))
    for name, value in (("PAIR_STRIP", 200), ("TARGET_BLOCK", 3), ("PAIR_ROWS", 25)):
        monkeypatch.setattr(sim, name, value)
    cut = sorted(map(tuple, sim.cosine_pairs(cells).select("a", "b", "sim").collect()))
    assert [x[:2] for x in cut] == [x[:2] for x in whole]
    assert [x[2] for x in cut] == pytest.approx([x[2] for x in whole])
    assert sorted(map(tuple, sim.cosine_topn(cells, 4).collect())) == nearest
