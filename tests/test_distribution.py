import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmap.operators.distribution import exact_percentiles, score_curve, threshold_counts


def _frame(spark, rows, parts):
    return spark.createDataFrame(rows, "g string, v double, y int").repartition(parts)


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_exact_percentiles_match_numpy_with_ties_and_hot_value(spark, parts):
    rng = np.random.default_rng(0)
    a = np.round(rng.random(700), 2)                 # many ties
    b = np.concatenate([np.full(400, 0.5), rng.random(300)])   # a hot value (> 1/3 of rows)
    rows = [("a", float(x), 0) for x in a] + [("b", float(x), 1) for x in b] + [("a", None, 0)]
    df = _frame(spark, rows, parts)
    qs = [0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0]
    got = {(r.g, r.q): r.value for r in exact_percentiles(df, ["g"], "v", qs).collect()}
    for g, arr in (("a", a), ("b", b)):
        for q in qs:
            assert got[(g, q)] == pytest.approx(float(np.quantile(arr, q)), abs=1e-12)


def test_even_count_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    r = exact_percentiles(df, None, "v", [0.5]).collect()
    assert r[0]["value"] == 2.5


def test_score_curve_brute_force(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.random(500), 2)
    y = (rng.random(500) < 0.3).astype(int)
    df = spark.createDataFrame([("m", float(a), int(b)) for a, b in zip(p, y)], "model string, p double, y int")
    cur = {r.p: r for r in score_curve(df.repartition(5), ["model"]).collect()}
    for t in np.unique(p):
        f = p >= t
        assert cur[t].tp == int((f & (y == 1)).sum())
        assert cur[t].fp == int((f & (y == 0)).sum())


def test_threshold_counts_includes_ties(spark):
    df = spark.createDataFrame([("m", 0.2, 1), ("m", 0.5, 0), ("m", 0.5, 1), ("m", 0.9, 1)],
                               "model string, p double, y int")
    thr = spark.createDataFrame([("m", 0.5), ("m", 0.95), ("m", float("-inf"))], "model string, threshold double")
    got = {r.threshold: (r.flagged_n, r.tp) for r in threshold_counts(df, ["model"], thr).collect()}
    assert got[0.5] == (3, 2)
    assert got[0.95] == (0, 0)
    assert got[float("-inf")] == (4, 3)
