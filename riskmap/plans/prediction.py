"""Registered prediction-track queries (M rows, S3, V14) on ``cust_features``.

Model fitting is not SQL-expressible, so most of these have no DuckDB twin;
``tests/test_segment_models.py`` carries their invariants.  The class-weight table
(M2) is plain SQL and is checked.
"""

from __future__ import annotations

import math
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmap.operators import clean as C
from riskmap.operators import features as E
from riskmap.operators import metrics as V
from riskmap.operators import models as M
from riskmap.operators import split as S
from riskmap.plans.common import SessionCache, q6, sql_q6
from riskmap.plans.prepare import CF_SQL, FOLD_SEED, SEED, _split_sql
from riskmap.sources import fixtures as fx
from riskmap.spec import CUSTOMER_SPEC as SPEC


JOIN_ROWS_PER_TASK = 100_000


class Matrix:
    """Cleaned customers, the feature model fitted on all of them, and their matrix: files that
    the prediction and the segmentation queries share."""

    def __init__(self, spark, sf: str):
        self.cleaned = M.materialize(C.clean(fx.cust_features(spark, sf), SPEC))
        self.fm = E.fit_feature_model(self.cleaned, SPEC)        # parity: fitted on all rows
        self.all = M.materialize(M.safe_matrix(self.fm, self.cleaned, keep=["k", "y"]))


_MATRIX = SessionCache(Matrix)


def matrix(spark, sf: str) -> Matrix:
    return _MATRIX(spark, sf)


class Prepared:
    """Cleaned table, fitted feature model, and the keyed train/test matrices."""

    def __init__(self, spark, sf: str):
        both = matrix(spark, sf)
        self.fm, X = both.fm, both.all
        sp = S.stratified_split(X.select("k", "y"), "k", "y", 0.2, SEED)
        folds = S.stratified_folds(sp.where(F.col("split") == "train").drop("split"), "k", "y", 5, FOLD_SEED)
        # wide rows are dealt once, a bounded number to a task; rows without a fold are the test rows
        rows, numbers = X.count(), folds.select("k", "fold")
        if rows > JOIN_ROWS_PER_TASK:
            tasks = max(spark.sparkContext.defaultParallelism, math.ceil(rows / JOIN_ROWS_PER_TASK))
            X, numbers = X.repartition(tasks, "k"), numbers.repartition(tasks, "k")
        dealt = M.materialize(X.join(numbers, "k", "left"))
        self.train = dealt.where("fold IS NOT NULL")
        self.test = dealt.where("fold IS NULL").drop("fold")
        self.n_train = self.train.count()
        self.n_test = self.test.count()
        self._searches: dict = {}
        self._lock = threading.Lock()

    def search_all(self, families) -> dict:
        """M8 results per family; families that no query has searched yet share one pool."""
        with self._lock:
            new = [f for f in families if f.name not in self._searches]
            if new:
                self._searches |= M.search_all(self.fm, new, self.train)
            return {f.name: self._searches[f.name] for f in families}

    def search(self, family: M.Family):
        return self.search_all([family])[family.name]


_CACHE = SessionCache(Prepared)


def prepared(spark, sf: str) -> Prepared:
    return _CACHE(spark, sf)


def _test_scores(p: Prepared, family: M.Family, params: dict, name: str, weighted: bool = False) -> DataFrame:
    train = M.with_label(p.train)
    if weighted:
        train = M.class_weight_column(train)
    _, s = M.fit_and_score(p.fm, family, params, train, p.test, ["k", "y"], weighted, float(p.n_train))
    return M.materialize(s.select("k", F.lit(name).alias("model"), "y", "p"))


def m01_logreg_coefficients(spark, sf):
    """M1 + M11: LR at C = 1 on the training split; top 20 |coef|."""
    p = prepared(spark, sf)
    train = M.with_label(p.train)
    model = M.fit_pipeline(p.fm, M.lr_family(), {"C": 1.0}, train, weight_sum=float(p.n_train))
    return M.coefficient_table(model, p.fm, 20)


def m02_class_weights(spark, sf):
    """M2: balanced weights per class on the training split."""
    p = prepared(spark, sf)
    w = M.class_weight_column(p.train.select("k", "y"))
    return q6(w.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.first("w").alias("weight")))


M02_SQL = f"""WITH {CF_SQL}, {_split_sql('cf')},
trc AS (SELECT y, count(*) AS n FROM sp WHERE split = 'train' GROUP BY y)
SELECT y, CAST(n AS BIGINT) AS n, {sql_q6('sum(n) OVER () / (count(*) OVER () * n)')} AS weight FROM trc"""


def m03_svm_lin_summary(spark, sf):
    """M3: linear SVM (C = 1) test ranking quality from its margins."""
    p = prepared(spark, sf)
    s = _test_scores(p, M.svm_lin_family(), {"C": 1.0}, "SVM-Lin")
    return V.curve_summary(s)


def m05_lr_kernel_summary(spark, sf):
    """M5: Nystroem RBF (300 landmarks, gamma 0.05) + LR (C = 1)."""
    p = prepared(spark, sf)
    s = _test_scores(p, M.lr_kernel_family(), {"gamma": 0.05, "C": 1.0}, "LR-Kernel")
    return V.curve_summary(s)


def m04_svm_rbf_summary(spark, sf):
    """M4 (re-aimed): Nystroem RBF (gamma 'scale') + linear SVM."""
    p = prepared(spark, sf)
    s = _test_scores(p, M.svm_rbf_family(), {"gamma": "scale", "C": 1.0}, "SVM-RBF (Nystroem)")
    return V.curve_summary(s)


def m06_rf_importances(spark, sf):
    """M6 + M12: random forest (300 trees, unlimited depth -> 30) importances."""
    p = prepared(spark, sf)
    train = M.with_label(p.train)
    model = M.fit_pipeline(p.fm, M.rf_family(), {"max_depth": None, "min_leaf": 1}, train,
                           weight_sum=float(p.n_train))
    return M.importance_table(model, p.fm, 20)


def _calibrated(p: Prepared, family: M.Family, params: dict, name: str, weighted: bool,
                oof: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """M7: test scores and out-of-fold scores of an SVM as probabilities.  Each strategy
    gets the sigmoid of its own out-of-fold margins: balanced weights move them."""
    if oof is None:
        oof = M.oof_scores(p.fm, family, params, p.train, weighted=weighted)
    a, b = M.platt_fit(oof)
    return M.platt_apply(_test_scores(p, family, params, name, weighted), a, b), M.platt_apply(oof, a, b)


def m07_platt_calibration(spark, sf):
    """M7: Platt sigmoids of both strategies, fitted on out-of-fold margins and applied
    to test margins; reported as the quantile-binned calibration table (V16)."""
    p = prepared(spark, sf)
    fam = M.svm_lin_family()
    parts = [_calibrated(p, fam, {"C": 1.0}, f"SVM-Lin ({s})", s == "balanced")[0] for s in ("none", "balanced")]
    return V.calibration_table(parts[0].unionByName(parts[1]))


def m08_grid_search(spark, sf):
    """M8: LR grid by mean 5-fold average precision; best row flagged."""
    p = prepared(spark, sf)
    table, _, _ = p.search(M.lr_family())
    return table


def m09_balanced_refit(spark, sf):
    """M9: refit at the searched C with balanced weights; metrics at 0.50."""
    p = prepared(spark, sf)
    _, best, _ = p.search(M.lr_family())
    s = _test_scores(p, M.lr_family(), best, "LR (balanced)", weighted=True)
    plan = spark.createDataFrame([("LR - balanced (thr=0.50)", "LR (balanced)", 0.5)],
                                 "row string, model string, threshold double")
    return V.metrics_table(s, plan)


def m10_batch_scores(spark, sf):
    """Long (id, model, p) test scores of several fitted models."""
    p = prepared(spark, sf)
    a = _test_scores(p, M.lr_family(), {"C": 1.0}, "LR (none)")
    b = _test_scores(p, M.lr_family(), {"C": 1.0}, "LR (balanced)", weighted=True)
    return a.unionByName(b)


def s03_oof_scores(spark, sf):
    """S3: out-of-fold LR probabilities for every training row."""
    p = prepared(spark, sf)
    return M.oof_scores(p.fm, M.lr_family(), {"C": 1.0}, p.train)


def results_table(spark, sf, families=None) -> DataFrame:
    """Three rows per family: no adjust at 0.50, balanced at 0.50, F1-tuned threshold
    (from out-of-fold scores of the unbalanced model).  Two rounds of fits, each in one
    pool: the searches of all families, then the refits of their best points with the
    balanced out-of-fold margins that calibrate the SVMs."""
    p = prepared(spark, sf)
    fams = families or [M.lr_family(), M.lr_kernel_family(), M.svm_lin_family(), M.svm_rbf_family()]
    found = p.search_all(fams)
    train = M.class_weight_column(M.with_label(p.train)).persist()
    sizes = M.fold_sizes(p.train)
    works, oofs = [], {}
    for f in fams:
        best = found[f.name][1]
        points = [M.Point(f"{f.name} (none)", best), M.Point(f"{f.name} (balanced)", best, True)]
        works.append(M.Work(f, points, train, p.test, float(p.n_train), ["k", "y"]))
    for f in fams:
        if f.kind == "svm":
            mine = M.fold_works(f, [M.Point("balanced", found[f.name][1], True)], M.with_label(p.train), sizes, "k", "y", "fold")
            oofs[f.name] = range(len(works), len(works) + len(mine))
            works += mine
    done = M.run_fits(p.fm, works)
    train.unpersist()
    scores, tuned = [], []
    for f, scored in zip(fams, done):
        oof = found[f.name][2]
        if f.kind == "svm":
            # each strategy gets the sigmoid of its own out-of-fold margins: weights move them
            margins = {"none": oof, "balanced": M._union([done[i] for i in oofs[f.name]])}
            fitted = {s: M.platt_fit(m) for s, m in margins.items()}
            parts = [M.platt_apply(scored.where(F.col("point") == f"{f.name} ({s})"), *fitted[s]) for s in margins]
            scored, oof = parts[0].unionByName(parts[1]), M.platt_apply(oof, *fitted["none"])
        scores.append(scored.select("k", F.col("point").alias("model"), "y", "p"))
        tuned.append(oof.select(F.lit(f"{f.name} (none)").alias("model"), "k", "y", "p"))
    best = V.tune_threshold(M.materialize(M._union(tuned)), "f1")
    plan = V.results_plan_rows(spark, [f.name for f in fams], best)
    return V.metrics_table(M.materialize(M._union(scores)), plan, digits=4)


def v14_results_table(spark, sf):
    return results_table(spark, sf)


def m06_forest_results(spark, sf):
    """M6, M8, M9: the forest family's three rows: six grid points by five folds, refits of the
    best point with and without balanced weights, and the tuned threshold."""
    return results_table(spark, sf, [M.rf_family()])


QUERIES = {
    "m01_logreg_coefficients": (m01_logreg_coefficients, None),
    "m02_class_weights": (m02_class_weights, M02_SQL),
    "m03_svm_lin_summary": (m03_svm_lin_summary, None),
    "m04_svm_rbf_summary": (m04_svm_rbf_summary, None),
    "m05_lr_kernel_summary": (m05_lr_kernel_summary, None),
    "m06_rf_importances": (m06_rf_importances, None),
    "m06_forest_results": (m06_forest_results, None),
    "m07_platt_calibration": (m07_platt_calibration, None),
    "m08_grid_search": (m08_grid_search, None),
    "m09_balanced_refit": (m09_balanced_refit, None),
    "m10_batch_scores": (m10_batch_scores, None),
    "s03_oof_scores": (s03_oof_scores, None),
    "v14_results_table": (v14_results_table, None),
}
