"""Registered evaluation queries (V1-V18) on the ``scored`` fixture, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmap.operators import metrics as M
from riskmap.plans.common import dbl, q6, sql_q6
from riskmap.sources import fixtures as fx

# ---------------------------------------------------------------------------
# DuckDB side: the fixture and the curve written as plain window SQL
# ---------------------------------------------------------------------------

SCORED_SQL = f"""
scored AS (
  SELECT event_id AS id, 'smooth' AS model, CAST(event_type = 'purchase' AS INTEGER) AS y,
         value / (value + {dbl(50)}) AS p FROM events
  UNION ALL
  SELECT event_id, 'ties', CAST(event_type = 'purchase' AS INTEGER),
         CAST((event_id * 37) % 100 AS DOUBLE) / {dbl(100)} FROM events
  UNION ALL
  SELECT event_id, 'signal', CAST(event_type = 'purchase' AS INTEGER),
         {dbl(0.25)} * CAST(CAST(event_type = 'purchase' AS INTEGER) AS DOUBLE)
         + CAST((event_id * 7919) % 1000 AS DOUBLE) / {dbl(1333)} FROM events
)"""

PTS_SQL = """
pts AS (
  SELECT model, p AS threshold, n, pos, n - pos AS neg,
         sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp,
         sum(pos) OVER (PARTITION BY model) AS tot_pos, sum(n - pos) OVER (PARTITION BY model) AS tot_neg
  FROM (SELECT model, p, count(*) AS n, sum(y) AS pos FROM scored GROUP BY model, p) d
  WINDOW w AS (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
pr AS (
  SELECT *, tp / (tp + fp) AS precision,
         CASE WHEN tot_pos = 0 THEN 1.0 ELSE tp / tot_pos END AS recall FROM pts
)"""

SUMMARY_SQL = """
summ AS (
  SELECT model, CAST(max(tot_pos) + max(tot_neg) AS BIGINT) AS n, CAST(max(tot_pos) AS BIGINT) AS positives,
         CASE WHEN max(tot_pos) > 0 AND max(tot_neg) > 0
              THEN CAST(sum(neg * (2 * tp - pos)) AS DOUBLE) / (2.0 * max(tot_pos) * max(tot_neg)) END AS roc_auc,
         CASE WHEN max(tot_pos) > 0 THEN sum(pos / tot_pos * precision) END AS pr_auc,
         coalesce(max(CASE WHEN precision >= 0.5 THEN recall END), 0.0) AS recall_at_p50,
         coalesce(max(CASE WHEN precision >= 0.7 THEN recall END), 0.0) AS recall_at_p70
  FROM pr GROUP BY model
)"""

# F1-optimal threshold: argmax f1, ties to the lowest threshold
F1THR_SQL = """
f1thr AS (
  SELECT model, threshold FROM (
    SELECT model, threshold, row_number() OVER (PARTITION BY model
        ORDER BY 2.0 * precision * recall / (precision + recall + 1e-12) DESC, threshold ASC) AS rk
    FROM pr) t WHERE rk = 1
)"""


def _conf_sql(thr_table: str) -> str:
    return f"""
conf AS (
  SELECT t.model, t.threshold,
         CAST(sum(CASE WHEN s.p >= t.threshold AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN s.p >= t.threshold AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN s.p < t.threshold AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN s.p < t.threshold AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(count(*) AS BIGINT) AS n
  FROM {thr_table} t JOIN scored s ON s.model = t.model GROUP BY t.model, t.threshold
),
confm AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
         CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn) / n END AS accuracy
  FROM conf
)"""


def _quantile_sql(qs_values: str, src: str = "scored") -> str:
    """Exact linear quantiles per model from order statistics (numpy rule)."""
    return f"""
qs(key, q) AS (VALUES {qs_values}),
ranked AS (
  SELECT model, p, row_number() OVER (PARTITION BY model ORDER BY p) - 1 AS r,
         count(*) OVER (PARTITION BY model) AS cnt FROM {src}
),
hq AS (
  SELECT m.model, qs.key, qs.q, CAST(m.cnt - 1 AS DOUBLE) * qs.q AS h
  FROM (SELECT DISTINCT model, cnt FROM ranked) m JOIN qs ON TRUE
),
quant AS (
  SELECT hq.model, hq.key, hq.q, hq.h,
         max(CASE WHEN ranked.r = floor(hq.h) THEN ranked.p END)
         + (hq.h - floor(hq.h)) * (max(CASE WHEN ranked.r = ceil(hq.h) THEN ranked.p END)
                                   - max(CASE WHEN ranked.r = floor(hq.h) THEN ranked.p END)) AS value
  FROM hq JOIN ranked ON ranked.model = hq.model
       AND (ranked.r = floor(hq.h) OR ranked.r = ceil(hq.h))
  GROUP BY hq.model, hq.key, hq.q, hq.h
)"""


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

def v01_pr_curve(spark, sf):
    return q6(M.pr_curve(fx.scored(spark, sf)))


V01_SQL = f"""WITH {SCORED_SQL}, {PTS_SQL}
SELECT model, {sql_q6('threshold')} AS threshold, {sql_q6('precision')} AS precision,
       {sql_q6('recall')} AS recall FROM pr
UNION ALL
SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM scored"""


def v02_curve_summary(spark, sf):
    return q6(M.curve_summary(fx.scored(spark, sf)))


V02_SQL = f"""WITH {SCORED_SQL}, {PTS_SQL}, {SUMMARY_SQL}
SELECT model, n, positives, {sql_q6('roc_auc')} AS roc_auc, {sql_q6('pr_auc')} AS pr_auc,
       {sql_q6('recall_at_p50')} AS recall_at_p50, {sql_q6('recall_at_p70')} AS recall_at_p70
FROM summ"""


def v04_brier(spark, sf):
    return q6(M.brier(fx.scored(spark, sf)))


V04_SQL = f"""WITH {SCORED_SQL}
SELECT model, {sql_q6('avg((p - CAST(y AS DOUBLE)) * (p - CAST(y AS DOUBLE)))')} AS brier
FROM scored GROUP BY model"""


def _half(spark, sf):
    s = fx.scored(spark, sf)
    thr = s.select("model").distinct().select("model", F.lit(0.5).alias("threshold"))
    return s, thr


def v06_confusion_at_half(spark, sf):
    s, thr = _half(spark, sf)
    return q6(M.confusion_counts(s, thr))


V06_SQL = f"""WITH {SCORED_SQL}, half AS (SELECT DISTINCT model, {dbl(0.5)} AS threshold FROM scored),
{_conf_sql('half')}
SELECT model, {sql_q6('threshold')} AS threshold, tp, fp, fn, tn, n,
       {sql_q6('precision')} AS precision, {sql_q6('recall')} AS recall,
       {sql_q6('f1')} AS f1, {sql_q6('accuracy')} AS accuracy FROM confm"""


def v08_confusion_frame(spark, sf):
    s, thr = _half(spark, sf)
    return q6(M.confusion_frame(M.confusion_counts(s, thr)))


V08_SQL = f"""WITH {SCORED_SQL}, half AS (SELECT DISTINCT model, {dbl(0.5)} AS threshold FROM scored),
{_conf_sql('half')}
SELECT model, {sql_q6('threshold')} AS threshold, 0 AS actual, 0 AS pred, tn AS count FROM conf
UNION ALL SELECT model, {sql_q6('threshold')}, 0, 1, fp FROM conf
UNION ALL SELECT model, {sql_q6('threshold')}, 1, 0, fn FROM conf
UNION ALL SELECT model, {sql_q6('threshold')}, 1, 1, tp FROM conf"""


def v10_f1_threshold(spark, sf):
    return q6(M.tune_threshold(fx.scored(spark, sf), "f1"))


V10_SQL = f"""WITH {SCORED_SQL}, {PTS_SQL}, {F1THR_SQL}
SELECT model, {sql_q6('threshold')} AS threshold FROM f1thr"""


def v11_threshold_at_precision(spark, sf):
    return q6(M.tune_threshold(fx.scored(spark, sf), "recall_at_precision", min_precision=0.5))


V11_SQL = f"""WITH {SCORED_SQL}, {PTS_SQL}, {F1THR_SQL},
rp AS (
  SELECT model, threshold FROM (
    SELECT model, threshold, row_number() OVER (PARTITION BY model ORDER BY recall DESC, threshold ASC) AS rk
    FROM pr WHERE precision >= 0.5) t WHERE rk = 1
)
SELECT f.model, {sql_q6('coalesce(rp.threshold, f.threshold)')} AS threshold
FROM f1thr f LEFT JOIN rp ON rp.model = f.model"""


def _metrics_plan(counts):
    """0.50 and the F1-tuned threshold of every model, from its score counts; a few
    rows, checkpointed because several steps read them."""
    tuned = M.tune_threshold(counts, "f1", points=M.curve_points(counts, counted=True))
    half = counts.select("model").distinct().select(
        F.concat(F.col("model"), F.lit(" (thr=0.50)")).alias("row"), "model",
        F.lit(0.5).alias("threshold"))
    tun = tuned.select(F.concat(F.col("model"), F.lit(" - F1-tuned thr")).alias("row"),
                       "model", "threshold")
    return half.unionByName(tun).checkpoint(eager=True)


def v13_metrics_table(spark, sf):
    s = fx.scored(spark, sf)
    counts = M.score_counts(s, ["model"])
    return q6(M.metrics_table(s, _metrics_plan(counts), counts=counts))


V13_SQL = f"""WITH {SCORED_SQL}, {PTS_SQL}, {SUMMARY_SQL}, {F1THR_SQL},
plan AS (
  SELECT DISTINCT model || ' (thr=0.50)' AS row, model, {dbl(0.5)} AS threshold FROM scored
  UNION ALL SELECT model || ' - F1-tuned thr', model, threshold FROM f1thr
),
brier AS (SELECT model, avg((p - CAST(y AS DOUBLE)) * (p - CAST(y AS DOUBLE))) AS brier FROM scored GROUP BY model),
{_conf_sql('plan')}
SELECT plan.row, plan.model, {sql_q6('plan.threshold')} AS threshold,
       {sql_q6('summ.roc_auc')} AS roc_auc, {sql_q6('summ.pr_auc')} AS pr_auc,
       {sql_q6('brier.brier')} AS brier, {sql_q6('confm.precision')} AS precision,
       {sql_q6('confm.recall')} AS recall, {sql_q6('confm.f1')} AS f1,
       {sql_q6('summ.recall_at_p50')} AS recall_at_p50, {sql_q6('summ.recall_at_p70')} AS recall_at_p70,
       {sql_q6('confm.accuracy')} AS accuracy, confm.tp, confm.fp, confm.fn, confm.tn
FROM plan JOIN summ ON summ.model = plan.model JOIN brier ON brier.model = plan.model
JOIN confm ON confm.model = plan.model AND confm.threshold = plan.threshold"""


def v15_pr_curves_ap(spark, sf):
    return q6(M.pr_curves_with_ap(fx.scored(spark, sf)))


V15_SQL = f"""WITH {SCORED_SQL}, {PTS_SQL}, {SUMMARY_SQL},
curve AS (
  SELECT model, threshold, precision, recall FROM pr
  UNION ALL SELECT DISTINCT model, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM scored
)
SELECT c.model, {sql_q6('c.threshold')} AS threshold, {sql_q6('c.precision')} AS precision,
       {sql_q6('c.recall')} AS recall, {sql_q6('s.pr_auc')} AS pr_auc,
       {sql_q6('s.positives / s.n')} AS baseline
FROM curve c JOIN summ s ON s.model = c.model"""


def v16_calibration(spark, sf):
    return q6(M.calibration_table(fx.scored(spark, sf), n_bins=10))


def _calib_sql(n_bins: int = 10) -> str:
    qs = [i * (1.0 / n_bins) for i in range(n_bins + 1)]
    vals = ", ".join(f"({i}, {dbl(q)})" for i, q in enumerate(qs))
    return f"""WITH {SCORED_SQL}, {_quantile_sql(vals)},
edges AS (
  SELECT model, key, CASE WHEN key = 0 THEN 0.0 WHEN key = {n_bins} THEN 1.0 ELSE value END AS e
  FROM quant
),
binned AS (
  SELECT s.model, s.p, s.y,
         least(greatest(CAST((SELECT count(*) FROM edges e WHERE e.model = s.model AND e.e <= s.p) AS BIGINT) - 1, 0), {n_bins - 1}) AS bin
  FROM scored s
)
SELECT model, CAST(bin AS INTEGER) AS bin, {sql_q6('avg(p)')} AS mean_pred,
       {sql_q6('avg(CAST(y AS DOUBLE))')} AS mean_true, CAST(count(*) AS BIGINT) AS n
FROM binned GROUP BY model, bin"""


V16_SQL = _calib_sql(10)

TOPK = (0.10, 0.20, 0.30)


def v17_topk_operating_points(spark, sf):
    return q6(M.topk_operating_points(fx.scored(spark, sf), TOPK))


def _topk_sql(ks=TOPK) -> str:
    vals = ", ".join(f"({dbl(k)}, {dbl(1 - k)})" for k in ks)
    return f"""WITH {SCORED_SQL}, {_quantile_sql(vals)},
flags AS (
  SELECT quant.model, quant.key AS k_frac, quant.value AS threshold,
         CAST(sum(CASE WHEN s.p >= quant.value THEN 1 ELSE 0 END) AS BIGINT) AS flagged_n,
         CAST(sum(CASE WHEN s.p >= quant.value AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(s.y) AS BIGINT) AS pos, CAST(count(*) AS BIGINT) AS n
  FROM quant JOIN scored s ON s.model = quant.model
  GROUP BY quant.model, quant.key, quant.value
)
SELECT model, {sql_q6('k_frac')} AS k_frac, {sql_q6('threshold')} AS threshold, flagged_n,
       {sql_q6('flagged_n / n')} AS flagged_share,
       {sql_q6('tp / greatest(flagged_n, 1)')} AS precision,
       {sql_q6('tp / greatest(pos, 1)')} AS recall
FROM flags"""


V17_SQL = _topk_sql()

CANDIDATES = ("smooth (thr=0.50)", "ties (thr=0.50)", "signal (thr=0.50)")


def v18_best_model_confusion(spark, sf):
    """Best candidate by F1 at 0.50, then its confusion at its tuned threshold."""
    s = fx.scored(spark, sf)
    counts = M.score_counts(s, ["model"])
    plan = _metrics_plan(counts)
    res = M.metrics_table(s, plan, counts=counts)
    best = M.best_by_metric(res, CANDIDATES, "f1").select("model")
    tuned = plan.where(~F.col("row").contains("(thr=")).select("model", "threshold").join(best, on="model")
    conf = M.confusion_counts(counts, tuned, counted=True)
    return q6(M.confusion_frame(conf))


V18_SQL = f"""WITH {SCORED_SQL}, {PTS_SQL}, {F1THR_SQL},
half AS (SELECT DISTINCT model, {dbl(0.5)} AS threshold FROM scored),
{_conf_sql('half')},
ranked AS (
  SELECT model, row_number() OVER (ORDER BY f1 DESC,
     CASE model || ' (thr=0.50)' {' '.join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CANDIDATES))} END ASC) AS rk
  FROM confm WHERE model || ' (thr=0.50)' IN ({', '.join(f"'{c}'" for c in CANDIDATES)})
),
best AS (SELECT f.model, f.threshold FROM f1thr f JOIN ranked r ON r.model = f.model AND r.rk = 1),
c2 AS (
  SELECT b.model, b.threshold,
         CAST(sum(CASE WHEN s.p >= b.threshold AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN s.p >= b.threshold AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN s.p < b.threshold AND s.y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN s.p < b.threshold AND s.y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM best b JOIN scored s ON s.model = b.model GROUP BY b.model, b.threshold
)
SELECT model, {sql_q6('threshold')} AS threshold, 0 AS actual, 0 AS pred, tn AS count FROM c2
UNION ALL SELECT model, {sql_q6('threshold')}, 0, 1, fp FROM c2
UNION ALL SELECT model, {sql_q6('threshold')}, 1, 0, fn FROM c2
UNION ALL SELECT model, {sql_q6('threshold')}, 1, 1, tp FROM c2"""


QUERIES = {
    "v01_pr_curve": (v01_pr_curve, V01_SQL),
    "v02_curve_summary": (v02_curve_summary, V02_SQL),
    "v04_brier": (v04_brier, V04_SQL),
    "v06_confusion_at_half": (v06_confusion_at_half, V06_SQL),
    "v08_confusion_frame": (v08_confusion_frame, V08_SQL),
    "v10_f1_threshold": (v10_f1_threshold, V10_SQL),
    "v11_threshold_at_precision": (v11_threshold_at_precision, V11_SQL),
    "v13_metrics_table": (v13_metrics_table, V13_SQL),
    "v15_pr_curves_ap": (v15_pr_curves_ap, V15_SQL),
    "v16_calibration": (v16_calibration, V16_SQL),
    "v17_topk_operating_points": (v17_topk_operating_points, V17_SQL),
    "v18_best_model_confusion": (v18_best_model_confusion, V18_SQL),
}
