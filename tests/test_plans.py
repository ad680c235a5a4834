"""Physical-plan checks for the scale properties the operators promise."""

import re

from pyspark.sql import functions as F

from riskmap.operators import metrics as M
from riskmap.operators.distribution import score_curve
from riskmap.plans import evaluation, prepare
from riskmap.sources import fixtures as fx


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_curve_windows_are_bucketed(spark, sf_small):
    plan = _plan(score_curve(fx.scored(spark, sf_small), ["model"]))
    windows = [ln for ln in plan.splitlines() if re.search(r"\bWindow \[", ln)]
    assert windows
    # the row-level running sum is partitioned by (model, bucket), never by model alone
    assert any("_bkt" in ln and "model" in ln for ln in windows)


def test_no_cartesian_products(spark, sf_small):
    for df in (evaluation.v17_topk_operating_points(spark, sf_small),
               M.curve_summary(fx.scored(spark, sf_small)),
               prepare.s01_stratified_split(spark, sf_small)):
        plan = _plan(df)
        assert "CartesianProduct" not in plan
        assert "BroadcastNestedLoopJoin" not in plan


def test_scans_are_pruned(spark, sf_small):
    plan = _plan(M.curve_summary(fx.scored(spark, sf_small)))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert schemas
    for s in schemas:
        assert "props" not in s and "ts:" not in s and "user_id" not in s


def test_customer_features_prune_lineitem(spark, sf_small):
    plan = _plan(fx.cust_features(spark, sf_small))
    li = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) if "l_orderkey" in s]
    assert li and all("l_shipdate" not in s and "l_tax" not in s for s in li)


def _scans(df) -> int:
    """File scans in the plan that is left after checkpoints."""
    return len(re.findall(r"FileScan parquet", _plan(df)))


def test_targeting_reads_the_rows_once(spark, sf_small):
    """G11-G13, V13 and V17 work from one checkpointed (group, score) table: what is
    left of the plan scans no source table, and nothing is a Cartesian product."""
    from riskmap.plans import synthesis
    for q in (evaluation.v17_topk_operating_points, evaluation.v13_metrics_table,
              synthesis.g11_persona_mix_at_cuts, synthesis.g12_precision_recall_vs_fraction,
              synthesis.g13_persona_targeting_summary):
        df = q(spark, sf_small)
        assert _scans(df) == 0, q.__name__
        assert "CartesianProduct" not in _plan(df), q.__name__


def test_threshold_counts_do_not_sort_scores(spark, sf_small):
    thr = spark.createDataFrame([("smooth", 0.5), ("ties", 0.25)], "model string, threshold double")
    plan = _plan(M.confusion_counts(fx.scored(spark, sf_small), thr))
    windows = [ln for ln in plan.splitlines() if re.search(r"\bWindow \[", ln)]
    # running sums go over the few threshold buckets, never over scores
    assert windows and not any(re.search(r"\[_s#\d+ (ASC|DESC)", ln) for ln in windows)
    assert any("_bkt" in ln for ln in windows)
