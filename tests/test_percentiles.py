"""Percentiles of groups against numpy, ordered at once or narrowed down first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import percentiles
from kindred.operators import activity as act


# Sketches of the last size are so crude that brackets often miss.
@pytest.mark.parametrize("at_once,sketch", [(1_000_000, percentiles.SKETCH), (60, percentiles.SKETCH), (60, 8)])
def test_against_numpy(spark, monkeypatch, at_once, sketch):
    monkeypatch.setattr(percentiles, "SKETCH", sketch)
    rng = np.random.default_rng(3)
    groups = {
        ("distinct", "a"): rng.permutation(3000) * 0.7, ("few", None): rng.integers(0, 4, 500) * 1.5, (None, None): np.array([4.0]),
        ("same", "b"): np.full(400, 2.5), ("outlier", "c"): np.append(rng.normal(size=300), 1e12),
    }
    rows = [(x, y, float(v)) for (x, y), values in groups.items() for v in values] + [("few", None, None), ("nothing", None, None)]
    df = spark.createDataFrame(rows, "x string, y string, value double").select(F.struct("x", "y").alias("group"), "value")
    got = {(tuple(r["group"]), r["share"]): r["value"] for r in percentiles.group_percentiles(df, [0.0, 0.5, 0.95, 1.0], at_once).collect()}
    assert len(got) == 4 * len(groups)
    for key, values in groups.items():
        for share in (0.0, 0.5, 0.95, 1.0):
            assert got[key, share] == pytest.approx(np.percentile(values, 100 * share), rel=1e-12)


def test_report_of_calls_without_latency_or_calls(spark):
    kind = "type string, api string, status string, latency_ms double"
    rows = [("external_api", "a", "ok", 1.0), ("external_api", "a", "ok", 2.0), ("external_api", None, "ok", None), ("request", "a", "ok", 9.0)]
    got = {r["api"]: (r["calls"], r["max_ms"], r["p50_ms"]) for r in act.api_report(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"a": (2, 2.0, 1.5), None: (1, None, None)}
    assert act.api_report(spark.createDataFrame([], kind)).count() == 0
