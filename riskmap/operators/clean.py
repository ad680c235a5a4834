"""Cleaning, projections and predicates (C1-C14), generic over a RoleSpec.

``clean`` folds every rule into one projection: Catalyst collapses it into the
scan's whole-stage-codegen stage, so cleaning costs no extra pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmap.functions import columns as X
from riskmap.spec import RoleSpec


def present(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """The listed columns that exist, in list order (absent ones skipped)."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def require_outcome(df: DataFrame, spec: RoleSpec) -> None:
    """A missing outcome is an error, not a skip."""
    if spec.outcome not in df.columns:
        raise KeyError(f"no outcome column {spec.outcome!r} in the cleaned table")


def clean_columns(df: DataFrame, spec: RoleSpec) -> list:
    """The C1-C5 projection as a list of columns (raw columns kept)."""
    cols = set(df.columns)
    out = []
    for c in df.columns:
        e = F.col(c)
        if c in spec.sentinel_columns:
            e = X.recode_sentinels(c, spec.sentinel_values)            # C1
        elif c in spec.refusal_columns:
            e = X.recode_refusal(c, spec.refusal_code)                  # C2
        if c in spec.bool_columns:
            e = e.cast("int")                                           # C3
        out.append(e.alias(c))
    base = {c: e for c, e in zip(df.columns, out)}
    for c in spec.distance:                                             # C4
        if c in cols:
            out.append(X.log1p_clipped(base[c]).alias(f"{c}_log1p"))
    for name, num, den in spec.ratios:                                  # C5
        # unlike the other helpers, a ratio with a missing input fails loudly
        if num not in cols or den not in cols:
            raise KeyError(f"ratio {name} needs {num} and {den}")
        out.append(X.ratio(base[num], base[den], spec.ratio_eps).alias(name))
    return out


def clean(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Sentinels -> null, refusals -> null, bool -> int, log1p twins, ratios."""
    return df.select(*clean_columns(df, spec))


def drop_roles(df: DataFrame, spec: RoleSpec, keep_id: bool = True) -> DataFrame:
    """Drop leak, low-quality, weight and outcome columns (id kept as key)."""
    drop = set(spec.leak) | set(spec.low_quality) | set(spec.weight) | {spec.outcome}
    if not keep_id:
        drop |= set(spec.ids)
    return df.drop(*[c for c in df.columns if c in drop])


def outcome_int(spec: RoleSpec, name: str | None = None):
    """Outcome as int."""
    return F.col(spec.outcome).cast("int").alias(name or spec.outcome)


def positive_subset(df: DataFrame, spec: RoleSpec) -> DataFrame:
    """Rows of the positive class (one keyed frame carries matrix and raw columns)."""
    return df.where(F.col(spec.outcome) == 1)


def exclude_by_substring(cols: Sequence[str], substrings: Sequence[str]) -> list[str]:
    """C11: drop names that contain any substring (the _log1p twins go too)."""
    return [c for c in cols if not any(s in c for s in substrings)]


def round_report(df: DataFrame, digits: int, cols: Sequence[str] | None = None) -> DataFrame:
    """Round at the report edge only."""
    cols = set(cols) if cols is not None else {
        f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])
