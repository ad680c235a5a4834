"""Classification evaluation on a long ``scored(id, group..., y, p)`` table.

Every operator takes a list of group columns (typically ``model``), so all
models are evaluated in the same jobs.  The curve operators rest on
``distribution.score_curve`` (exact running counts without a one-partition
window); thresholds are evaluated with ``distribution.threshold_counts`` (one
pass for any number of thresholds).

Conventions kept from the analysis this reproduces:

* PR curve: one point per distinct score plus a final (recall 0, precision 1)
  point; recall is 1 everywhere when a group has no positives.
* Average precision is the step-wise sum  sum_i (R_i - R_{i-1}) P_i.
* ROC-AUC counts ties one half (trapezoids between distinct scores).
* Hard prediction is ``p >= threshold``; zero divisions give 0.
* F1-optimal threshold: argmax of 2PR/(P+R+1e-12), ties to the lowest threshold.
* Threshold under a precision floor: largest recall among points with
  precision >= floor, ties to the lowest threshold, falling back to the F1 rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmap.operators.distribution import (
    _groups, exact_percentiles, score_counts, score_curve, threshold_counts)

F1_EPS = 1e-12


def _safe_div(num, den, zero=0.0):
    return F.when(den == 0, F.lit(zero)).otherwise(num / den)


# -- V1 -----------------------------------------------------------------------

def curve_points(scored: DataFrame, group_cols=("model",), score_col="p",
                 label_col="y", counted: bool = False) -> DataFrame:
    """Distinct-score points with precision and recall (no final point)."""
    g = _groups(group_cols)
    c = score_curve(scored, g, score_col, label_col, counted=counted)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.when(F.col("tot_pos") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("tot_pos"))
    return c.select(*g, F.col("p").alias("threshold"), "n", "pos", "neg", "tp", "fp",
                    "tot_pos", "tot_neg", prec.alias("precision"), rec.alias("recall"))


def pr_curve(scored: DataFrame, group_cols=("model",), score_col="p",
             label_col="y") -> DataFrame:
    """V1: (group..., threshold, precision, recall); final point has null threshold."""
    g = _groups(group_cols)
    pts = curve_points(scored, g, score_col, label_col)
    body = pts.select(*g, "threshold", "precision", "recall")
    final = pts.select(*g).distinct().select(
        *g, F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return body.unionByName(final)


# -- V2, V3, V9 -------------------------------------------------------------

def curve_summary(scored: DataFrame, group_cols=("model",), score_col="p",
                  label_col="y", floors: Sequence[float] = (0.5, 0.7),
                  points: DataFrame | None = None) -> DataFrame:
    """Per group: n, positives, ROC-AUC (V2), AP (V3), recall at precision floors (V9).

    AUC and AP are null when a class is absent.
    """
    g = _groups(group_cols)
    pts = points if points is not None else curve_points(scored, g, score_col, label_col)
    P = F.col("tot_pos")
    # trapezoid between consecutive distinct scores: neg_i * (tp_{i-1} + tp_i) / 2
    auc_term = F.col("neg").cast("double") * (2 * F.col("tp") - F.col("pos")).cast("double")
    ap_term = (F.col("pos") / P) * F.col("precision")
    aggs = [
        F.first("tot_pos").alias("_P"), F.first("tot_neg").alias("_N"),
        F.sum(auc_term).alias("_auc"),
        F.sum(F.when(P > 0, ap_term)).alias("_ap"),
    ]
    for fl in floors:
        aggs.append(F.coalesce(F.max(F.when(F.col("precision") >= fl, F.col("recall"))),
                               F.lit(0.0)).alias(_floor_name(fl)))
    s = pts.groupBy(*g).agg(*aggs)
    auc = F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                 F.col("_auc") / (F.lit(2.0) * F.col("_P").cast("double") * F.col("_N").cast("double")))
    ap = F.when(F.col("_P") > 0, F.col("_ap"))
    return s.select(*g, (F.col("_P") + F.col("_N")).alias("n"), F.col("_P").alias("positives"),
                    auc.alias("roc_auc"), ap.alias("pr_auc"),
                    *[F.col(_floor_name(fl)) for fl in floors])


def _floor_name(fl: float) -> str:
    return f"recall_at_p{int(round(fl * 100)):02d}"


def recall_at_precision(scored: DataFrame, min_precision: float, group_cols=("model",),
                        score_col="p", label_col="y") -> DataFrame:
    """V9: largest recall with precision >= floor; 0.0 if never reached."""
    g = _groups(group_cols)
    s = curve_summary(scored, g, score_col, label_col, floors=(min_precision,))
    return s.select(*g, F.col(_floor_name(min_precision)).alias("recall_at_precision"))


# -- V4-V8 --------------------------------------------------------------------

def brier(scored: DataFrame, group_cols=("model",), score_col="p", label_col="y") -> DataFrame:
    """V4: mean squared error of the probability."""
    g = _groups(group_cols)
    d = F.col(score_col) - F.col(label_col).cast("double")
    return scored.groupBy(*g).agg(F.avg(d * d).alias("brier"))


def hard_prediction(score_col: str = "p", threshold=0.5):
    """V5: inclusive threshold."""
    thr = threshold if hasattr(threshold, "alias") else F.lit(float(threshold))
    return (F.col(score_col) >= thr).cast("int")


def confusion_counts(scored: DataFrame, thresholds: DataFrame, group_cols=("model",),
                     key_cols: Sequence[str] = (), score_col="p", label_col="y",
                     threshold_col="threshold", counted: bool = False) -> DataFrame:
    """V6-V8: tp, fp, fn, tn and precision/recall/F1/accuracy per threshold row, from
    one hash aggregate (no sort); ``counted`` takes a ``score_counts`` table."""
    g = _groups(group_cols)
    tc = threshold_counts(scored, g, thresholds, score_col, label_col,
                          threshold_col=threshold_col, key_cols=key_cols,
                          **({"weight_col": "n", "positive_col": "pos"} if counted else {}))
    tp = F.col("tp")
    fp = F.col("flagged_n") - F.col("tp")
    fn = F.col("tot_pos") - F.col("tp")
    tn = F.col("n_total") - F.col("tot_pos") - fp
    out = tc.select(*g, *key_cols, threshold_col, tp.alias("tp"), fp.alias("fp"),
                    fn.alias("fn"), tn.alias("tn"), F.col("n_total").alias("n"))
    return out.select(
        "*",
        _safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _safe_div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        _safe_div(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"))


def confusion_frame(conf: DataFrame, group_cols=("model",)) -> DataFrame:
    """V8: labelled 2x2 frame, zero cells kept: (group..., actual, pred, count)."""
    g = _groups(group_cols)
    cells = F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("pred"), F.col("tn").alias("count")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("pred"), F.col("fp").alias("count")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("pred"), F.col("fn").alias("count")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("pred"), F.col("tp").alias("count")))
    return conf.select(*g, "threshold", F.explode(cells).alias("c")).select(
        *g, "threshold", "c.actual", "c.pred", F.col("c.count").cast("long").alias("count"))


# -- V10-V12 ------------------------------------------------------------------

def tune_threshold(scored: DataFrame, objective: str = "f1", min_precision: float = 0.5,
                   group_cols=("model",), score_col="p", label_col="y",
                   points: DataFrame | None = None) -> DataFrame:
    """(group..., threshold) chosen on the curve points."""
    if objective not in ("f1", "recall_at_precision"):
        raise ValueError(f"objective must be f1 or recall_at_precision, got {objective!r}")
    g = _groups(group_cols)
    pts = points if points is not None else curve_points(scored, g, score_col, label_col)
    P, R = F.col("precision"), F.col("recall")
    f1 = F.lit(2.0) * P * R / (P + R + F.lit(F1_EPS))
    # max of (objective, -threshold) picks ties at the lowest threshold
    best_f1 = pts.groupBy(*g).agg(
        F.max(F.struct(f1.alias("o"), (-F.col("threshold")).alias("nt"))).alias("b"))
    best_f1 = best_f1.select(*g, (-F.col("b.nt")).alias("threshold_f1"))
    if objective == "f1":
        return best_f1.select(*g, F.col("threshold_f1").alias("threshold"))
    ok = pts.where(P >= F.lit(min_precision)).groupBy(*g).agg(
        F.max(F.struct(R.alias("o"), (-F.col("threshold")).alias("nt"))).alias("b"))
    ok = ok.select(*g, (-F.col("b.nt")).alias("threshold_rp"))
    res = best_f1.join(ok, on=g, how="left")
    return res.select(*g, F.coalesce("threshold_rp", "threshold_f1").alias("threshold"))


# -- V13, V14 -----------------------------------------------------------------

METRIC_COLUMNS = ("threshold", "roc_auc", "pr_auc", "brier", "precision", "recall",
                  "f1", "recall_at_p50", "recall_at_p70", "accuracy")


def metrics_table(scored: DataFrame, plan: DataFrame, group_cols=("model",),
                  score_col="p", label_col="y", digits: int | None = None,
                  counts: DataFrame | None = None) -> DataFrame:
    """One metrics row per plan row; ``counts`` takes an existing
    ``score_counts`` table, so that tuning and metrics share one scan.

    ``plan`` has columns ``row`` (report label), the group columns and
    ``threshold``; several rows may share a model.  Curve metrics are computed
    once per model and joined to the plan (a handful of rows).
    """
    g = _groups(group_cols)
    if counts is None:
        counts = score_counts(scored, g, score_col, label_col)
    pts = curve_points(counts, g, score_col, label_col, counted=True)
    summ = curve_summary(counts, g, score_col, label_col, points=pts)
    p = F.col(score_col)
    br = counts.groupBy(*g).agg((F.sum(F.col("pos") * (p - 1) * (p - 1) + (F.col("n") - F.col("pos")) * p * p)
                                 / F.sum("n")).alias("brier"))
    thr = plan.select(*g, F.col("threshold").cast("double").alias("threshold")).distinct()
    conf = confusion_counts(counts, thr, g, score_col=score_col, label_col=label_col, counted=True)
    out = (plan.select("row", *g, F.col("threshold").cast("double").alias("threshold"))
           .join(summ, on=g, how="left").join(br, on=g, how="left")
           .join(conf.drop("n"), on=g + ["threshold"], how="left"))
    cols = [F.col(c) for c in METRIC_COLUMNS]
    if digits is not None:
        cols = [F.round(F.col(c), digits).alias(c) for c in METRIC_COLUMNS]
    return out.select("row", *g, *cols, "tp", "fp", "fn", "tn")


def results_plan_rows(spark, families: Sequence[str], tuned: DataFrame,
                      default_threshold: float = 0.5, none_suffix=" (none)",
                      balanced_suffix=" (balanced)") -> DataFrame:
    """V14 plan: per family, no-adjust at 0.5, balanced at 0.5, F1-tuned (on the
    unbalanced model's tuned threshold).  ``tuned`` has (model, threshold)."""
    rows = []
    for fam in families:
        rows.append((f"{fam} - no adjust (thr=0.50)", fam + none_suffix, float(default_threshold)))
        rows.append((f"{fam} - balanced (thr=0.50)", fam + balanced_suffix, float(default_threshold)))
    fixed = spark.createDataFrame(rows, "row string, model string, threshold double")
    fam_map = spark.createDataFrame([(f"{fam} - F1-tuned thr", fam + none_suffix) for fam in families],
                                    "row string, model string")
    tuned_rows = fam_map.join(tuned.select("model", "threshold"), on="model", how="inner")
    return fixed.unionByName(tuned_rows.select("row", "model", "threshold"))


# -- V15 ---------------------------------------------------------------------

def pr_curves_with_ap(scored: DataFrame, group_cols=("model",), score_col="p",
                      label_col="y") -> DataFrame:
    """Curve points of several models with their AP and the positive rate."""
    g = _groups(group_cols)
    curve = pr_curve(scored, g, score_col, label_col)
    summ = curve_summary(scored, g, score_col, label_col, floors=())
    base = summ.select(*g, "pr_auc", (F.col("positives") / F.col("n")).alias("baseline"))
    return curve.join(base, on=g, how="left")


# -- V16 ---------------------------------------------------------------------

def calibration_table(scored: DataFrame, group_cols=("model",), n_bins: int = 10,
                      score_col="p", label_col="y") -> DataFrame:
    """Quantile-binned reliability table.

    Edges are the exact quantiles at i/n_bins with the end edges forced to 0
    and 1; bin = (number of edges <= p) - 1, clipped to [0, n_bins - 1].
    Empty bins (duplicate edges) do not appear.
    """
    g = _groups(group_cols)
    qs = [i * (1.0 / n_bins) for i in range(n_bins + 1)]
    q = exact_percentiles(scored, g, score_col, qs)
    idx = F.when(F.col("q") == qs[0], F.lit(0.0)).when(F.col("q") == qs[-1], F.lit(1.0)) \
        .otherwise(F.col("value"))
    edges = q.groupBy(*g).agg(F.sort_array(F.collect_list(
        F.struct(F.col("q"), idx.alias("e")))).alias("_e"))
    edges = edges.select(*g, F.transform("_e", lambda s: s["e"]).alias("edges"))
    # bounded: one array of n_bins + 1 doubles per group
    j = scored.join(F.broadcast(edges), on=g, how="inner")
    p = F.col(score_col)
    nle = F.size(F.filter("edges", lambda e: e <= p))
    b = F.least(F.greatest(nle - 1, F.lit(0)), F.lit(n_bins - 1))
    return j.groupBy(*g, b.alias("bin")).agg(
        F.avg(p).alias("mean_pred"), F.avg(F.col(label_col).cast("double")).alias("mean_true"),
        F.count(F.lit(1)).alias("n"))


# -- V17 ---------------------------------------------------------------------

def topk_operating_points(scored: DataFrame, k_fracs: Sequence[float] = (0.1, 0.2, 0.3),
                          group_cols=("model",), score_col="p", label_col="y") -> DataFrame:
    """threshold = linear quantile at 1 - k; flag p >= threshold (ties may
    exceed k); precision = tp / max(1, flagged); recall = tp / max(1, positives)."""
    g = _groups(group_cols)
    qs = {float(1 - k): float(k) for k in k_fracs}
    counts = score_counts(scored, g, score_col, label_col)   # the only scan of the rows
    q = exact_percentiles(counts, g, score_col, list(qs), weight_col="n")
    kmap = F.create_map(*[x for qq, kk in qs.items() for x in (F.lit(qq), F.lit(kk))])
    thr = q.select(*g, kmap[F.col("q")].alias("k_frac"), F.col("value").alias("threshold"))
    tc = threshold_counts(counts, g, thr, score_col, label_col, key_cols=["k_frac"],
                          weight_col="n", positive_col="pos")
    fl = F.col("flagged_n")
    return tc.select(
        *g, "k_frac", "threshold", fl.alias("flagged_n"),
        (fl / F.col("n_total")).alias("flagged_share"),
        (F.col("tp") / F.greatest(fl, F.lit(1))).alias("precision"),
        (F.col("tp") / F.greatest(F.col("tot_pos"), F.lit(1))).alias("recall"))


# -- V18 ---------------------------------------------------------------------

def best_by_metric(results: DataFrame, candidates: Sequence[str], metric: str = "f1",
                   label_col: str = "row") -> DataFrame:
    """The candidate row with the largest metric; ties go to the first
    candidate in list order."""
    order = F.create_map(*[x for i, c in enumerate(candidates) for x in (F.lit(c), F.lit(i))])
    pick = results.where(F.col(label_col).isin(list(candidates))).select(
        "*", order[F.col(label_col)].alias("_ord"))
    best = pick.agg(F.max(F.struct(F.col(metric).alias("m"), (-F.col("_ord")).alias("o"))
                          ).alias("b")).select(F.col("b.o").alias("_best"))
    # one-row frame: broadcast
    return pick.join(F.broadcast(best), pick["_ord"] == -best["_best"]).drop("_best", "_ord")
