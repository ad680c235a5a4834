"""Feature encoding (E1-E8): impute, one-hot, assemble, standardize.

``fit_feature_model`` runs two small actions -- exact medians of every numeric
column (one job, bucketed exact quantiles over an unpivoted long table) and the
distinct levels of every nominal column (one job) -- and returns a
``FeatureModel`` whose ``transform`` is a single projection with literal
medians and level tests: no join, no shuffle, fully inside codegen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import ElementwiseProduct, StandardScaler
from pyspark.ml.linalg import Vectors
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from riskmap.functions.columns import qcol
from riskmap.operators.clean import outcome_int, present, require_outcome
from riskmap.operators.distribution import exact_percentiles
from riskmap.spec import RoleSpec

UNKNOWN = "unknown"
COLUMNS_PER_JOB = 128        # groups of one quantile job
MAX_LITERAL_LEVELS = 5000    # one-hot columns that a projection of literals can hold


def level_expr(df: DataFrame, c: str):
    """Category value as string, missing -> 'unknown'.

    Integral numeric codes are rendered without a fractional part, so a code
    stored as double reads '1', not '1.0'.
    """
    x = F.col(c)
    dt = df.schema[c].dataType
    if isinstance(dt, NumericType):
        s = F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))
    else:
        s = x.cast("string")
    return F.coalesce(s, F.lit(UNKNOWN))


def medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """Exact medians (mean of the two middle values), nulls ignored."""
    if not cols:
        return {}
    got = {}
    for i in range(0, len(cols), COLUMNS_PER_JOB):          # any number of columns
        part = list(cols[i:i + COLUMNS_PER_JOB])
        long = df.select(*[F.col(c).cast("double").alias(c) for c in part]).unpivot([], part, "feature", "value")
        q = exact_percentiles(long, ["feature"], "value", [0.5])
        got |= {r["feature"]: r["value"] for r in q.collect()}   # one value per column
    return {c: got.get(c) for c in cols}


def levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Distinct levels per nominal column, string-sorted (one job).  They become columns of
    the plan, so ``MAX_LITERAL_LEVELS`` of them at most; ``operators.wide`` builds the same
    matrix for columns of any width."""
    if not cols:
        return {}
    long = df.select(*[level_expr(df, c).alias(c) for c in cols]).unpivot(
        [], list(cols), "feature", "level").distinct()
    found = long.limit(MAX_LITERAL_LEVELS + 1).collect()
    if len(found) > MAX_LITERAL_LEVELS:
        raise ValueError(f"more than {MAX_LITERAL_LEVELS} one-hot levels: use operators.wide.fit_sparse_features")
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in found:
        out[r["feature"]].append(r["level"])
    return {c: sorted(v) for c, v in out.items()}


@dataclass
class FeatureModel:
    """E5: fitted imputation medians and one-hot levels."""

    spec: RoleSpec
    numeric: list[str]
    passthrough: list[str]
    onehot: list[tuple[str, str, str]]        # (source column, level, output name)
    medians: dict[str, float | None] = field(default_factory=dict)
    source_types: dict[str, object] = field(default_factory=dict)

    @property
    def onehot_columns(self) -> list[str]:
        return [o[2] for o in self.onehot]

    @property
    def binary(self) -> list[str]:
        return self.passthrough + self.onehot_columns

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.binary

    @property
    def groups(self) -> dict[str, list[str]]:
        return {"numeric_continuous": list(self.numeric),
                "binary_or_count": list(self.passthrough),
                "one_hot": self.onehot_columns}

    def feature_columns(self, df: DataFrame) -> list:
        cols = []
        for c in self.numeric + self.passthrough:
            m = self.medians.get(c)
            cols.append(F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double")).alias(c))
        lv = {}
        for src, level, name in self.onehot:
            if src not in lv:
                lv[src] = level_expr(df, src)
            cols.append((lv[src] == F.lit(level)).cast("int").alias(name))
        return cols

    def transform(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """Wide matrix: id, outcome (int) when present, then every feature column."""
        spec = self.spec
        keep = list(keep) if keep is not None else present(df, [spec.id])
        head = [F.col(c) for c in keep]
        if spec.outcome in df.columns and spec.outcome not in keep:
            head.append(outcome_int(spec))
        return df.select(*head, *self.feature_columns(df))

    def to_long(self, df: DataFrame) -> DataFrame:
        """(id, feature, value) -- the matrix without a data-dependent schema."""
        spec = self.spec
        wide = df.select(F.col(spec.id), *[c.cast("double") for c in self.feature_columns(df)])
        return wide.unpivot([spec.id], [qcol(c) for c in self.columns], "feature", "value")


def fit_feature_model(df_clean: DataFrame, spec: RoleSpec,
                      fit_rows: DataFrame | None = None) -> FeatureModel:
    """E5: fit medians and levels.

    ``fit_rows`` selects the rows the statistics are fitted on: ``None`` uses
    every row (parity with the original analysis, where test rows leak into
    the medians); pass the training split for leak-free work.
    """
    require_outcome(df_clean, spec)
    # a column listed under two roles is used once, in its first role
    numeric = list(dict.fromkeys(present(df_clean, spec.numeric_candidates)))
    passthrough = [c for c in dict.fromkeys(present(df_clean, spec.passthrough)) if c not in numeric]
    nominal = [c for c in dict.fromkeys(present(df_clean, spec.nominal))
               if c not in numeric and c not in passthrough]
    fit_df = fit_rows if fit_rows is not None else df_clean
    # several jobs read the same columns: materialize them once for the fit
    fit_df = fit_df.select(*numeric, *passthrough, *nominal).persist()
    try:
        med = medians(fit_df, numeric + passthrough)
        missing = [c for c, v in med.items() if v is None]
        if missing:
            raise ValueError(f"cannot impute all-null columns: {missing}")
        lv = levels(fit_df, nominal)
    finally:
        fit_df.unpersist()
    onehot = [(c, level, f"{c}={level}") for c in nominal for level in lv[c]]
    return FeatureModel(spec, numeric, passthrough, onehot, med,
                        {c: df_clean.schema[c].dataType for c in nominal})


# -- E6-E8: standardization --------------------------------------------------

def moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """(mean, population std, sample std) per column in one aggregate."""
    aggs = []
    for c in cols:
        aggs += [F.avg(qcol(c)), F.stddev_pop(qcol(c)), F.stddev_samp(qcol(c))]
    r = df.agg(*aggs).collect()[0]
    return {c: (r[3 * i], r[3 * i + 1], r[3 * i + 2]) for i, c in enumerate(cols)}


class PopulationStandardScaler(Estimator, HasInputCol, HasOutputCol):
    """Vector standardizer with the population std (sklearn's convention).

    Fits MLlib's ``StandardScaler`` (sample std) and a constant
    ``ElementwiseProduct`` of sqrt(n / (n - 1)); the fitted model is a plain
    ``PipelineModel`` of built-in stages, so it saves and loads as usual.
    Constant features map to 0, as in sklearn.
    """

    def __init__(self, inputCol: str = "features", outputCol: str = "scaled"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> Model:
        tmp = f"{self.getOutputCol()}__s"
        sm = StandardScaler(inputCol=self.getInputCol(), outputCol=tmp,
                            withMean=True, withStd=True).fit(dataset)
        n = dataset.count()
        d = len(sm.mean)
        f = math.sqrt(n / (n - 1)) if n > 1 else 1.0
        ep = ElementwiseProduct(scalingVec=Vectors.dense([f] * d), inputCol=tmp,
                                outputCol=self.getOutputCol())
        return PipelineModel([sm, ep])
