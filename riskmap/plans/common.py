"""Shared helpers for the registered queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, FloatType

from riskmap.functions.columns import quantize

DIGITS = 6


def q6(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Quantize every floating column (report edge of a registered query)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(quantize(f.name, digits).alias(f.name))
        else:
            cols.append(df[f"`{f.name}`"])
    return df.select(*cols)


def sql_q6(expr: str, digits: int = DIGITS) -> str:
    """DuckDB twin of :func:`quantize`."""
    s = f"{float(10 ** digits)!r}"
    return (f"(CAST(floor(CAST({expr} AS DOUBLE) * CAST({s} AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS DOUBLE)"
            f" / CAST({s} AS DOUBLE))")


def dbl(x: float) -> str:
    """A DuckDB double literal (a bare 0.1 is DECIMAL)."""
    return f"CAST({float(x)!r} AS DOUBLE)"


class SessionCache:
    """Prepared inputs of the last (application, sf_dir); a new one drops what the old
    one persisted, so nothing outlives its session or piles up."""

    def __init__(self, make: Callable):
        self.make, self.key, self.value = make, None, None

    def __call__(self, spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key != self.key:
            self.release()
            self.value, self.key = self.make(spark, sf_dir), key
        return self.value

    def release(self) -> None:
        for x in vars(self.value).values() if self.value is not None else ():
            if isinstance(x, DataFrame):
                try:
                    x.unpersist()
                except Exception:  # noqa: BLE001 -- its session has ended
                    pass
        self.key = self.value = None
