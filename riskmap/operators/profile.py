"""Profiling and descriptive statistics.

Each operator is one aggregate pass (partial aggregation on every executor,
a tiny final merge); per-column results are unpivoted into long tables so the
output schema does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shape_summary(df: DataFrame, outcome: str) -> DataFrame:
    """B1: rows, columns, positive rate."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).cast("long").alias("n_cols"),
                  F.avg(F.col(outcome).cast("double")).alias("positive_rate"))


def head(df: DataFrame, key: str, n: int = 3) -> DataFrame:
    """B2: first n rows in key order (order made explicit)."""
    return df.orderBy(key).limit(n)


def _type_class(dt) -> str:
    name = dt.typeName()
    if name in ("integer", "long", "short", "byte"):
        return "int"
    if name in ("double", "float", "decimal"):
        return "float"
    if name == "boolean":
        return "bool"
    return "string" if name == "string" else name


def missing_summary(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """Type class and missing count per column (columns with missing > 0)."""
    cols = df.columns
    agg = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    types = {f.name: _type_class(f.dataType) for f in df.schema.fields}
    long = agg.unpivot([], cols, "column", "n_missing")
    tmap = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(types[c]))])
    out = long.select("column", tmap[F.col("column")].alias("dtype"),
                      F.col("n_missing").cast("long").alias("n_missing"))
    return out.where(F.col("n_missing") > 0) if only_missing else out


def sentinel_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Min, max, mean and count of negative codes per column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.struct(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
                          F.count_if(x < 0).cast("long").alias("n_negative_codes")).alias(c)]
    wide = df.agg(*aggs)
    return wide.unpivot([], list(cols), "column", "s").select("column", "s.*")


def column_quality(df: DataFrame, cols: Sequence[str], max_missing_share: float = 0.9,
                   min_variance: float = 1e-3) -> DataFrame:
    """Share of sentinel (negative) or null rows, mean, population variance,
    and the drop decision (> 90 % missing or near-zero variance)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        bad = F.when(x.isNull() | (x < 0), 1.0).otherwise(0.0)
        aggs.append(F.struct(F.avg(bad).alias("missing_share"), F.avg(x).alias("mean"),
                             F.var_pop(x).alias("variance")).alias(c))
    long = df.agg(*aggs).unpivot([], list(cols), "column", "s").select("column", "s.*")
    drop = (F.col("missing_share") > max_missing_share) | (F.coalesce(F.col("variance"), F.lit(0.0)) < min_variance)
    return long.select("*", drop.alias("drop"))


def class_balance(df: DataFrame, outcome: str) -> DataFrame:
    """Count and percent per class (the total is a window over <= classes rows)."""
    from pyspark.sql import Window
    g = df.groupBy(F.col(outcome).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return g.select("class", "n", (F.col("n") * 100.0 / tot).alias("pct"))


def marginal_rate(df: DataFrame, group_col: str, outcome: str, min_n: int = 20) -> DataFrame:
    """Outcome rate and n per level, levels with n >= min_n, rate descending.
    A null level is dropped (pandas groupby default)."""
    g = (df.where(F.col(group_col).isNotNull()).groupBy(F.col(group_col).alias("level"))
           .agg(F.avg(F.col(outcome).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")))
    return g.where(F.col("n") >= min_n).orderBy(F.desc("rate"))


def marginal_panels(df: DataFrame, cols: Sequence[str], outcome: str, min_n: int = 20) -> DataFrame:
    """B7 over several columns in one aggregate, plus the overall rate."""
    levels = df.select(F.col(outcome).cast("double").alias("_y"),
                       *[F.col(c).cast("string").alias(c) for c in cols])
    long = levels.unpivot(["_y"], list(cols), "feature", "level").where(F.col("level").isNotNull())
    g = long.groupBy("feature", "level").agg(F.avg("_y").alias("rate"), F.count(F.lit(1)).alias("n"))
    overall = df.agg(F.avg(F.col(outcome).cast("double"))).collect()[0][0]   # one scalar
    return g.where(F.col("n") >= min_n).withColumn("overall", F.lit(overall).cast("double"))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 40) -> DataFrame:
    """Equal-width bins between min and max; right edge of the last bin
    closed; empty bins kept.  Output: column, bin, lo, hi, count."""
    cols = list(cols)
    rng = df.agg(*[F.struct(F.min(F.col(c).cast("double")).alias("lo"),
                            F.max(F.col(c).cast("double")).alias("hi")).alias(c) for c in cols])
    rng = rng.unpivot([], cols, "column", "r").select("column", "r.lo", "r.hi")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "column", "x").where(F.col("x").isNotNull())
    # one row per column: broadcast
    j = long.join(F.broadcast(rng), on="column")
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    raw = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins))))
    b = F.least(raw, F.lit(bins - 1)).cast("int")
    counts = j.groupBy("column", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select("column", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    out = grid.join(counts, on=["column", "bin"], how="left")
    return out.select("column", "bin", (F.col("lo") + F.col("bin") * w).alias("lo"),
                      (F.col("lo") + (F.col("bin") + 1) * w).alias("hi"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def feature_group_sizes(spark, groups: dict[str, list[str]]) -> DataFrame:
    """Number of columns per feature group."""
    return spark.createDataFrame([(k, len(v)) for k, v in groups.items()],
                                 "group string, n_columns long")
