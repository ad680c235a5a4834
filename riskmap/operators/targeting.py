"""Targeting synthesis (G8-G13): scores joined with persona assignments.

The rows are aggregated once to (persona, score) counts; exact quantiles
(``distribution.exact_percentiles``) and the counts at all cut-offs
(``distribution.threshold_counts``) both come from that table.  Totals are over
all rows, whatever their persona (null and unlisted ones too); ``n_personas`` only
says which personas are displayed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmap.operators.distribution import exact_percentiles, score_counts, threshold_counts

NEG_INF = float("-inf")


def value_shares(df: DataFrame, key: str) -> DataFrame:
    """Normalised value counts in key order; rows without a key are left out."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(F.lit(0)))      # <= keys rows
    return g.select(key, "n", (F.col("n") / tot).alias("share")).orderBy(key)


def attach_names(df: DataFrame, key: str, names: Mapping[int, str], default: str = "?",
                 name_col: str = "name") -> DataFrame:
    """Id -> display name through a small lookup; unknown ids get ``default``."""
    spark = df.sparkSession
    kt = df.schema[key].dataType.simpleString()
    lut = spark.createDataFrame([(k, v) for k, v in names.items()], f"{key} {kt}, {name_col} string")
    # the lookup has one row per named id
    return df.join(F.broadcast(lut), on=key, how="left").withColumn(
        name_col, F.coalesce(F.col(name_col), F.lit(default)))


def targeting_table(scores: DataFrame, assignments: DataFrame, id_col: str = "id") -> DataFrame:
    """Score, persona and truth per id (inner join on the key)."""
    return scores.join(assignments, on=id_col, how="inner")


def _cut_thresholds(counts: DataFrame, cuts: Sequence[float], score_col: str,
                    all_rows_at_one: bool = True) -> list[tuple[float, float]]:
    """(cut, threshold): quantile at 1 - cut; cut 1.0 -> -inf (all rows)."""
    q = {float(1 - c): float(c) for c in cuts}
    found = exact_percentiles(counts, [], score_col, list(q), weight_col="n").collect()   # one row per cut
    return [(q[r["q"]], NEG_INF if all_rows_at_one and q[r["q"]] >= 1.0 else r["value"]) for r in found]


def _plan(spark, thresholds: list[tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame(thresholds, "cut double, threshold double")


def persona_mix_at_cuts(table: DataFrame, cuts: Sequence[float] = (0.05, 0.10, 0.20, 0.30, 0.50, 1.00),
                        n_personas: int = 5, score_col: str = "p", persona_col: str = "persona",
                        truth_col: str = "y", prefix: str = "P") -> DataFrame:
    """Flagged n, precision, recall and persona shares at each top-share cut.

    Counts and denominators cover every row; one column per displayed persona
    (0 when absent from the flagged set).
    """
    counts = score_counts(table, [persona_col], score_col, truth_col)
    plan = _plan(table.sparkSession, _cut_thresholds(counts, cuts, score_col))
    shown = F.col(persona_col)
    for i in range(n_personas):
        counts = counts.withColumn(f"_n{i}", F.when(shown == i, F.col("n")).otherwise(0))
    kw = dict(score_col=score_col, key_cols=["cut"], weight_col="n")
    tot = threshold_counts(counts, [], plan, positive_col="pos", **kw)
    parts = [threshold_counts(counts, [], plan, positive_col=f"_n{i}", **kw)
             .select("cut", F.col("tp").alias(f"_f{i}")) for i in range(n_personas)]
    for part in parts:
        tot = tot.join(part, "cut")
    fl = F.col("flagged_n")
    return tot.select(
        F.col("cut").alias("top_share"), fl.alias("flagged_n"),
        F.when(fl > 0, F.col("tp") / fl).otherwise(F.lit(0.0)).alias("precision"),
        (F.col("tp") / F.greatest(F.col("tot_pos"), F.lit(1))).alias("recall"),
        *[F.when(fl > 0, F.col(f"_f{i}") / fl).otherwise(F.lit(0.0)).alias(f"{prefix}{i}")
          for i in range(n_personas)])


def fraction_grid(start: float = 0.01, stop: float = 1.0, num: int = 100) -> list[float]:
    """The evenly spaced targeting fractions (numpy's linspace values)."""
    return [float(x) for x in np.linspace(start, stop, num)]


def precision_recall_vs_fraction(table: DataFrame, fractions: Sequence[float] | None = None,
                                 score_col: str = "p", truth_col: str = "y") -> DataFrame:
    """Precision and recall when the top fraction f is targeted, for many f,
    in one pass (threshold = quantile at 1 - f, flag p >= threshold)."""
    fr = list(fractions) if fractions is not None else fraction_grid()
    counts = score_counts(table, [], score_col, truth_col)
    plan = _plan(table.sparkSession, _cut_thresholds(counts, fr, score_col, all_rows_at_one=False))
    tc = threshold_counts(counts, [], plan, score_col, key_cols=["cut"], weight_col="n", positive_col="pos")
    fl = F.col("flagged_n")
    return tc.select(F.col("cut").alias("fraction"), "threshold", fl.alias("flagged_n"),
                     (F.col("tp") / F.greatest(fl, F.lit(1))).alias("precision"),
                     (F.col("tp") / F.greatest(F.col("tot_pos"), F.lit(1))).alias("recall"))


def persona_targeting_summary(table: DataFrame, n_personas: int = 5, top_q: float = 0.90,
                              names: Mapping[int, str] | None = None, score_col: str = "p",
                              persona_col: str = "persona", truth_col: str = "y",
                              prefix: str = "P", positives_name: str = "positives_share",
                              top_name: str = "top_share") -> DataFrame:
    """Per displayed persona -- population share, share of all positives, mean
    score, share of the top group (score >= quantile ``top_q``), each of all rows."""
    counts = score_counts(table, [persona_col], score_col, truth_col)
    cut = exact_percentiles(counts, [], score_col, [top_q], weight_col="n").first()
    top = F.col(score_col) >= F.lit(cut["value"] if cut else None)
    n = F.col("n")
    base = counts.groupBy(persona_col).agg(
        F.sum("n").alias("_n"), F.sum("pos").alias("_pos"),
        (F.sum(F.col(score_col) * n) / F.sum("n")).alias("mean_pred_proba"),
        F.sum(F.when(top, n).otherwise(0)).alias("_top"))
    total = counts.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.when(top, n)).alias("top")).first()
    every = {k: max(1, int(total[k] or 0)) for k in ("n", "pos", "top")}
    allp = table.sparkSession.range(n_personas).select(
        F.col("id").cast(table.schema[persona_col].dataType).alias(persona_col))
    share = lambda c, k: F.coalesce(F.col(c), F.lit(0)) / F.lit(every[k])
    out = allp.join(base, on=persona_col, how="left").select(
        F.concat(F.lit(prefix), F.col(persona_col).cast("string")).alias("persona"),
        share("_n", "n").alias("population_share"), share("_pos", "pos").alias(positives_name),
        F.col("mean_pred_proba"), share("_top", "top").alias(top_name), F.col(persona_col).alias("_pid"))
    if names is not None:
        out = attach_names(out, "_pid", dict(names))
    return out.drop("_pid")
