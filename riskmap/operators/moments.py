"""Second moments of many columns at once.

One pass over the rows: every task multiplies its batches into d x d sums and sends
d(d+1)/2 rows, which meet in a grouped sum.  The plan holds one array of columns,
whatever their number, and rows are centred first, so that large means do not cancel.
Pairs are complete pairs: a row counts for a pair of columns where both are known.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmap.functions.columns import qcol

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def column_array(cols: Sequence[str]) -> Column:
    return F.array(*[qcol(c).cast("double") for c in cols])


def pair_sums(df: DataFrame, x: Column, d: int) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) for positions i <= j of the array ``x`` of length
    ``d``; sums of values less their column's mean over complete pairs.  NaN counts
    as missing."""
    rows = df.select(x.alias("x"))
    known = F.col("v").isNotNull() & ~F.isnan("v")
    means = np.zeros(d)
    for r in (rows.select(F.posexplode("x").alias("i", "v")).where(known)
              .groupBy("i").agg(F.avg("v").alias("m")).collect()):      # one row per column
        means[r["i"]] = r["m"]

    def run(batches):
        n, s, ss, both = (np.zeros((d, d)) for _ in range(4))
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) - means
            have = ~np.isnan(values)
            values = np.where(have, values, 0.0)
            have = have.astype(float)
            n += have.T @ have
            s += values.T @ have
            ss += (values * values).T @ have
            both += values.T @ values
        i, j = np.triu_indices(d)
        out = [i.astype(np.int32), j.astype(np.int32), n[i, j], s[i, j], s[j, i], ss[i, j], ss[j, i], both[i, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["i", "j", *_SUMS])

    schema = "i int, j int, " + ", ".join(f"{c} double" for c in _SUMS)
    return rows.mapInArrow(run, schema).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])


def _named(pairs: DataFrame, names: Sequence[str], value: str) -> DataFrame:
    """Both orders of every pair, with names for positions."""
    name = F.array(*[F.lit(c) for c in names])
    upper = pairs.select(name[F.col("i")].alias("a"), name[F.col("j")].alias("b"), value, (F.col("i") < F.col("j")).alias("off"))
    return upper.select("a", "b", value).unionByName(
        upper.where("off").select(F.col("b").alias("a"), F.col("a").alias("b"), value))


def _co(x: str, y: str, xy: str) -> Column:
    return F.col(xy) - F.col(x) * F.col(y) / F.col("n")


def correlation_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, r) of every pair of columns, both orders, diagonal 1; r is null where a
    column of the pair is constant or fewer than two rows are complete."""
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    scale = F.sqrt(F.greatest(_co("sx", "sx", "sxx"), F.lit(0.0)) * F.greatest(_co("sy", "sy", "syy"), F.lit(0.0)))
    r = F.when(F.col("i") == F.col("j"), F.lit(1.0)).when((F.col("n") > 1) & (scale > 0), _co("sx", "sy", "sxy") / scale)
    return _named(pair_sums(df, column_array(cols), len(cols)).select("i", "j", r.alias("r")), cols, "r")


def covariance_table(df: DataFrame, x: Column, names: Sequence[str]) -> DataFrame:
    """K1: (a, b, cov), population covariance of the positions of an array column."""
    sums = pair_sums(df, x, len(names))
    return _named(sums.select("i", "j", F.when(F.col("n") > 0, _co("sx", "sy", "sxy") / F.col("n")).alias("cov")), names, "cov")
