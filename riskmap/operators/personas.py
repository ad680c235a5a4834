"""Cluster / persona profiles, crosstabs and rule-based names.

All inputs are keyed row-level frames with a cluster column; outputs have one
row per cluster (a handful), so joins between the per-cluster results are
small and the row-level work is one grouped aggregate each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmap.functions.columns import capitalize, qcol


def cluster_means(df: DataFrame, cluster_col: str, feats: Sequence[str]) -> DataFrame:
    """G1: mean of each listed feature per cluster; nulls skipped, and rows without a
    cluster are left out (G1-G7 describe clusters)."""
    feats = [c for c in feats if c in df.columns]
    return df.where(F.col(cluster_col).isNotNull()).groupBy(cluster_col).agg(*[F.avg(qcol(c)).alias(c) for c in feats])


def cluster_sizes(df: DataFrame, cluster_col: str) -> DataFrame:
    """N and share per cluster."""
    g = df.where(F.col(cluster_col).isNotNull()).groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"))
    return g.select(cluster_col, "n", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("share"))


def crosstab_normalized(df: DataFrame, row_col: str, col_col: str,
                        levels: Sequence | None = None, prefix: str = "") -> DataFrame:
    """Row-normalised crosstab, wide; null keys dropped, absent cells 0.

    Shares are of all rows of a row key; ``levels`` only says which columns are shown
    (without it, every level: one more job to discover them).
    """
    d = df.where(F.col(row_col).isNotNull() & F.col(col_col).isNotNull())
    lv = list(levels) if levels is not None else [r[0] for r in d.select(col_col).distinct().orderBy(col_col).collect()]
    return d.groupBy(row_col).agg(*[
        (F.count(F.when(F.col(col_col) == F.lit(v), 1)) / F.count(F.lit(1))).alias(f"{prefix}{v}") for v in lv])


def crosstab_long(df: DataFrame, row_col: str, col_col: str, levels: Sequence) -> DataFrame:
    """G3 in long form (row, level, share) with zero cells kept."""
    wide = crosstab_normalized(df, row_col, col_col, levels)
    names = [str(v) for v in levels]
    return wide.unpivot([row_col], [qcol(c) for c in names], "level", "share")


def cluster_table(df: DataFrame, cluster_col: str, feats: Sequence[str], xt_col: str,
                  xt_levels: Sequence, xt_prefix: str) -> DataFrame:
    """Means + n + share + crosstab shares, joined on the cluster key."""
    m = cluster_means(df, cluster_col, feats)
    s = cluster_sizes(df, cluster_col)
    x = crosstab_normalized(df, cluster_col, xt_col, xt_levels, xt_prefix)
    return m.join(s, on=cluster_col).join(x, on=cluster_col, how="left")


def z_profile(df: DataFrame, cluster_col: str, feats: Sequence[str]) -> DataFrame:
    """(cluster mean - overall mean) / overall sample std, std 0 -> 1. Wide."""
    feats = [c for c in feats if c in df.columns]
    df = df.where(F.col(cluster_col).isNotNull())
    means = cluster_means(df, cluster_col, feats)
    overall = df.agg(*[F.struct(F.avg(qcol(c)).alias("m"), F.stddev_samp(qcol(c)).alias("s")).alias(c)
                       for c in feats]).collect()[0]          # 2 x d scalars
    cols = []
    for c in feats:
        mu, sd = overall[c]["m"], overall[c]["s"]
        if sd is None or sd == 0:
            sd = 1.0
        cols.append(((qcol(c) - F.lit(mu)) / F.lit(float(sd))).alias(c))
    return means.select(cluster_col, *cols)


# --- fixed values: the narrative naming rules --------------------------------
# Slots are tried in order; inside a slot the first matching alternative adds
# its fragment.  A condition is (table, column, op, value) on the z-profile
# ("z") or the plain profile means ("m"); a column that is absent reads 0.
HOUSEHOLD_NAME_RULES = (
    ((("any", (("z", "rural", ">", 0.5), ("z", "nonmetro", ">", 0.5))), "Rural"),
     (("any", (("z", "rural", "<", -0.5),)), "Urban")),
    ((("all", (("z", "num_elderly", ">", 0.5), ("z", "head_age", ">", 0.3))), "elderly-headed"),
     (("any", (("z", "num_children", ">", 0.5),)), "with children"),
     (("any", (("z", "any_employed_adult", ">", 0.3),)), "working-age")),
    ((("any", (("m", "snap_any", ">", 0.6),)), "on SNAP"),
     (("any", (("z", "snap_any", "<", -0.5),)), "not on SNAP")),
    ((("any", (("z", "vehiclenum", "<", -0.5), ("z", "anyvehicle", "<", -0.5))), "limited vehicle access"),),
)
FALLBACK_NAME = "mixed profile"
# --- end fixed values ---------------------------------------------------------


def _cond(term, z_cols, m_cols):
    table, column, op, value = term
    avail = z_cols if table == "z" else m_cols
    x = F.col(f"{table}_{column}") if column in avail else F.lit(0.0)
    return x > F.lit(value) if op == ">" else x < F.lit(value)


def name_clusters(z: DataFrame, means: DataFrame, cluster_col: str,
                  rules=HOUSEHOLD_NAME_RULES, fallback: str = FALLBACK_NAME) -> DataFrame:
    """Narrative name per cluster from the z-profile and plain means.

    The name is the matched fragments joined by spaces, else ``fallback``;
    the result is capitalised (first letter upper, the rest lower).
    """
    zc = [c for c in z.columns if c != cluster_col]
    mc = [c for c in means.columns if c != cluster_col]
    zz = z.select(cluster_col, *[qcol(c).alias(f"z_{c}") for c in zc])
    mm = means.select(cluster_col, *[qcol(c).alias(f"m_{c}") for c in mc])
    j = zz.join(mm, on=cluster_col, how="inner")
    frags = []
    for slot in rules:
        expr = None
        for (mode, terms), frag in slot:
            conds = [_cond(t, zc, mc) for t in terms]
            c = conds[0]
            for more in conds[1:]:
                c = (c | more) if mode == "any" else (c & more)
            expr = F.when(c, F.lit(frag)) if expr is None else expr.when(c, F.lit(frag))
        frags.append(expr)
    joined = F.concat_ws(" ", *frags)
    name = F.when(joined == "", F.lit(fallback)).otherwise(joined)
    return j.select(cluster_col, capitalize(name).alias("narrative_name"))


def persona_table(df: DataFrame, persona_col: str, share_feats: dict[str, str],
                  xt_col: str, xt_levels: Sequence, xt_prefix: str) -> DataFrame:
    """N, share, named means (e.g. rural_share) and the persona x cluster crosstab."""
    s = cluster_sizes(df, persona_col)
    m = df.groupBy(persona_col).agg(*[F.avg(qcol(src)).alias(out) for out, src in share_feats.items()])
    x = crosstab_normalized(df, persona_col, xt_col, xt_levels, xt_prefix)
    return s.join(m, on=persona_col).join(x, on=persona_col, how="left")
