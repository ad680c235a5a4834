import numpy as np
import pytest
from pyspark.sql import functions as F

from riskmap.operators import metrics as M
from tests import reference_impl as R


def _scored(spark, p, y, model="m"):
    return spark.createDataFrame([(i, model, int(b), float(a)) for i, (a, b) in enumerate(zip(p, y))],
                                 "id long, model string, y int, p double")


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    y = (rng.random(800) < 0.3).astype(int)
    p = np.round(np.clip(0.3 * y + rng.random(800) * 0.7, 0, 1), 3)
    return p, y


def test_curve_summary_matches_brute_force(spark, data):
    p, y = data
    s = M.curve_summary(_scored(spark, p, y)).collect()[0]
    assert s.roc_auc == pytest.approx(R.roc_auc(y, p), abs=1e-12)
    assert s.pr_auc == pytest.approx(R.average_precision(y, p), abs=1e-12)
    assert s.recall_at_p50 == pytest.approx(R.recall_at_precision(y, p, 0.5), abs=1e-12)
    assert s.recall_at_p70 == pytest.approx(R.recall_at_precision(y, p, 0.7), abs=1e-12)


def test_tune_threshold_f1_lowest_on_ties(spark, data):
    p, y = data
    t = M.tune_threshold(_scored(spark, p, y), "f1").collect()[0].threshold
    assert t == pytest.approx(R.tune_f1(y, p))


def test_unknown_objective_raises(spark, data):
    p, y = data
    with pytest.raises(ValueError):
        M.tune_threshold(_scored(spark, p, y), "accuracy")


def test_precision_floor_unreachable(spark):
    p = [0.1, 0.2, 0.3, 0.4]
    y = [1, 0, 0, 0]
    sc = _scored(spark, p, y)
    assert M.recall_at_precision(sc, 0.9).collect()[0][1] == 0.0
    f1 = M.tune_threshold(sc, "f1").collect()[0].threshold
    rp = M.tune_threshold(sc, "recall_at_precision", min_precision=0.9).collect()[0].threshold
    assert rp == f1                                   # falls back to the F1 rule


def test_single_class_gives_null_auc(spark):
    s = M.curve_summary(_scored(spark, [0.1, 0.5, 0.9], [0, 0, 0])).collect()[0]
    assert s.roc_auc is None and s.pr_auc is None


def test_all_scores_equal(spark):
    s = M.curve_summary(_scored(spark, [0.5] * 10, [1, 0] * 5)).collect()[0]
    assert s.roc_auc == 0.5
    assert s.pr_auc == pytest.approx(0.5)


def test_confusion_at_threshold_inclusive(spark):
    sc = _scored(spark, [0.5, 0.5, 0.2, 0.8], [1, 0, 1, 0])
    thr = spark.createDataFrame([("m", 0.5)], "model string, threshold double")
    c = M.confusion_counts(sc, thr).collect()[0]
    assert (c.tp, c.fp, c.fn, c.tn) == (1, 2, 1, 0)
    assert c.precision == pytest.approx(1 / 3)
    frame = M.confusion_frame(M.confusion_counts(sc, thr)).collect()
    assert len(frame) == 4                            # zero cells kept


def test_calibration_duplicate_edges_drop_empty_bins(spark):
    p = [0.0] * 50 + [1.0] * 50
    y = [0] * 50 + [1] * 50
    t = M.calibration_table(_scored(spark, p, y)).collect()
    assert sum(r.n for r in t) == 100
    assert len(t) < 10


def test_topk_ties_may_exceed_k(spark):
    p = [0.9, 0.9, 0.9, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1]
    y = [1, 0, 1, 0, 0, 0, 0, 0, 0, 1]
    r = M.topk_operating_points(_scored(spark, p, y), [0.1]).collect()[0]
    assert r.threshold == pytest.approx(float(np.quantile(p, 0.9)))
    assert r.flagged_n == 3
    assert r.precision == pytest.approx(2 / 3)
    assert r.recall == pytest.approx(2 / 3)


def test_partition_invariance(spark, data):
    p, y = data
    base = _scored(spark, p, y)
    outs = [sorted(M.curve_summary(base.repartition(n)).collect()) for n in (1, 4, 7)]
    assert outs[0] == outs[1] == outs[2]
