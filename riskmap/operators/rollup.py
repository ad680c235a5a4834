"""Documented upstream table derivations (D1-D7): the roll-ups that turn
person-level and event-level tables into one row per entity.

Every roll-up is a grouped aggregate with map-side partial aggregation, so
an entity holding a third of all rows costs one partial row per task before
the shuffle; distinct counts go through Spark's (key, value) pre-aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmap.functions.columns import band


def schema_check(df: DataFrame, dictionary: Sequence[tuple[str, str]]) -> DataFrame:
    """Every documented column against the table, types and values.

    ``dictionary`` is (variable, type class) with classes int / float / string / bool.
    Output: variable, expected, actual (null when absent), n_rows, n_values (not null),
    n_fit (values of the class: whole numbers, finite numbers, non-empty strings), ok
    (present, of the class -- an int serves as a float -- and every value fits).  One
    aggregate over the table.
    """
    def cls(dt) -> str:
        n = dt.typeName()
        if n in ("integer", "long", "short", "byte"):
            return "int"
        if n in ("double", "float", "decimal"):
            return "float"
        return {"boolean": "bool"}.get(n, n)

    def fits(v: str, t: str) -> Column:
        x = F.col(f"`{v}`")
        if t == "string":
            return F.length(x.cast("string")) > 0
        if t == "bool":
            return x.isNotNull()
        d = x.cast("double")
        finite = ~F.isnan(d) & (F.abs(d) < float("inf"))
        return finite & (d == F.floor(d)) if t == "int" else finite

    actual = {f.name: cls(f.dataType) for f in df.schema.fields}
    rows = []
    for v, t in dictionary:
        there = v in actual
        match = there and (actual[v] == t or (t == "float" and actual[v] == "int"))
        values = F.count(F.col(f"`{v}`")) if there else F.lit(0).cast("long")
        fit = F.count(F.when(fits(v, t), 1)) if there else F.lit(0).cast("long")
        rows.append(F.struct(
            F.lit(v).alias("variable"), F.lit(t).alias("expected"), F.lit(actual.get(v)).cast("string").alias("actual"),
            F.count(F.lit(1)).alias("n_rows"), values.alias("n_values"), fit.alias("n_fit"),
            (F.lit(bool(match)) & (values == fit)).alias("ok")))
    return df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def member_rollup(df: DataFrame, key: str, counts: Mapping[str, Column],
                  flags: Mapping[str, Column] | None = None, size_col: str = "size") -> DataFrame:
    """Group size, conditional counts and any-of flags per entity."""
    aggs = [F.count(F.lit(1)).alias(size_col)]
    aggs += [F.count_if(c).cast("long").alias(n) for n, c in counts.items()]
    aggs += [F.max(c.cast("int")).alias(n) for n, c in (flags or {}).items()]
    return df.groupBy(key).agg(*aggs)


def attach_reference(base: DataFrame, rows: DataFrame, base_key: str, row_key: str,
                     is_reference: Column, attrs: Sequence[str], order: Sequence[str],
                     prefix: str = "ref_") -> DataFrame:
    """D3: attributes of each entity's reference row (first by ``order`` when an
    entity has several) attached by a left join; absent -> null."""
    ref = rows.where(is_reference).groupBy(F.col(row_key).alias("_rk")).agg(
        F.min_by(F.struct(*attrs), F.struct(*order)).alias("_r"))
    ref = ref.select("_rk", *[F.col(f"_r.{a}").alias(f"{prefix}{a}") for a in attrs])
    return base.join(ref, base[base_key] == ref["_rk"], "left").drop("_rk")


def event_rollup(events: DataFrame, key: str, category_col: str, flag: Column) -> DataFrame:
    """Event count, distinct categories and flagged events per entity."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.count_distinct(category_col).alias("category_unique"),
        F.sum(flag.cast("long")).alias("flagged_events"))


def merge_rollup(base: DataFrame, rollup: DataFrame, base_key: str, rollup_key: str,
                 zero_cols: Sequence[str]) -> DataFrame:
    """Entity table left-joined to a roll-up; entities without events get 0."""
    r = rollup.withColumnRenamed(rollup_key, "_rk")
    j = base.join(r, base[base_key] == r["_rk"], "left").drop("_rk")
    return j.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c in zero_cols else F.col(c)
                      for c in j.columns])


def clean_ratio(c, scale: float = 100.0, cap: float = 10.0) -> Column:
    """Percent / scale clipped at cap; null stays null (``least`` skips nulls)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNotNull(), F.least(x / F.lit(float(scale)), F.lit(float(cap))))


# --- fixed values: the income bands of the ratio (right-closed) -------------
RATIO_BAND_EDGES = (1.0, 1.3, 2.0, 4.0)
RATIO_BAND_LABELS = ("<=1.0", "1.0-1.3", "1.3-2.0", "2.0-4.0", ">4.0")
# --- end fixed values ---------------------------------------------------------


def ratio_band(c) -> Column:
    """Right-closed bands."""
    return band(c, RATIO_BAND_EDGES, RATIO_BAND_LABELS)


def label_from_set(c, values: Sequence) -> Column:
    """1 when the category is in the set, else 0 (null stays null)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isNotNull(), x.isin(list(values)).cast("int"))


def any_of(cols: Sequence[Column]) -> Column:
    """1 if any flag is true (nulls count as false)."""
    return F.greatest(*[F.coalesce(c.cast("int"), F.lit(0)) for c in cols], F.lit(0))
