"""Metrics on a small worked example and their relations."""

import math

import pytest

from kindred.operators import metrics

# Of the eight recommended, places 2, 3 and 7 are among the four relevant ones.
RECOMMENDED, RELEVANT = [40, 11, 17, 52, 60, 61, 23, 70], [11, 17, 23, 99]


@pytest.fixture(scope="module")
def lists(spark):
    recs = spark.createDataFrame([("anna", i, place) for place, i in enumerate(RECOMMENDED, 1)], "user_id string, item_id int, rank int")
    return recs, spark.createDataFrame([("anna", i) for i in RELEVANT], "user_id string, item_id int")


def test_errors(spark):
    # Errors 1, -2, 0 and 2: squares 9 in all, absolute 5.
    rows = [(7.0, 6.0), (1.5, 3.5), (4.0, 4.0), (9.0, 7.0)]
    row = metrics.evaluate_predictions(spark.createDataFrame(rows, "rating double, score double")).first()
    assert (row["rmse"], row["mae"]) == (pytest.approx(1.5), pytest.approx(1.25))


def test_ranking(lists):
    got = {r["k"]: r for r in metrics.evaluate_recommendations(*lists, k_values=(2, 8)).collect()}
    assert [got[2][m] for m in ("precision", "recall", "f1")] == [pytest.approx(x) for x in (1 / 2, 1 / 4, 1 / 3)]
    assert [got[8][m] for m in ("precision", "recall", "f1")] == [pytest.approx(x) for x in (3 / 8, 3 / 4, 1 / 2)]
    assert got[8]["hit_rate"] == 1.0 and got[8]["average_precision"] == pytest.approx((1 / 2 + 2 / 3 + 3 / 7) / 4)


def test_ndcg_and_coverage(spark):
    recs = spark.createDataFrame([("anna", 8, 1), ("anna", 9, 2), ("anna", 6, 3)], "user_id string, item_id int, rank int")
    gains = spark.createDataFrame([("anna", 6, 7.0), ("anna", 9, 1.0)], "user_id string, item_id int, gain double")
    want = (1 / math.log2(3) + 7 / 2) / (7 + 1 / math.log2(3))
    assert metrics.ndcg_at_k(recs, gains, 3).first()["ndcg"] == pytest.approx(want)
    listed = spark.createDataFrame([(31,), (31,), (32,), (38,)], "item_id int")
    items = spark.range(31, 39).selectExpr("int(id) as item_id")
    assert metrics.catalog_coverage(listed, items).first()["coverage"] == 3 / 8
    assert metrics.catalog_coverage(listed, items.limit(0)).first()["coverage"] is None


def test_precision_times_length_is_recall_times_relevant(lists):
    recs, relevant = lists
    for r in metrics.precision_recall_points(recs, relevant).collect():
        assert r["precision"] * r["k"] == pytest.approx(r["recall"] * len(RELEVANT))
