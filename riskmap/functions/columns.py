"""Column expressions (JVM side, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qcol(name: str) -> Column:
    """A column by exact name (names like ``band=1.0-1.3`` hold dots)."""
    return F.col(f"`{name}`")


def recode_sentinels(c, codes: Sequence[int]) -> Column:
    """Listed codes -> null; null stays null."""
    x = col(c)
    return F.when(~x.isin([float(v) for v in codes]), x)


def recode_refusal(c, code: str = "R") -> Column:
    """A refusal string -> null."""
    x = col(c)
    return F.when(x != F.lit(code), x)


def bool_to_int(c) -> Column:
    """C3."""
    return col(c).cast("int")


def log1p_clipped(c) -> Column:
    """C4: log1p(max(x, 0)); a null stays null (``greatest`` alone skips nulls)."""
    x = col(c).cast("double")
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def ratio(num, den, eps: float = 1e-3) -> Column:
    """Num / (den + eps); eps also keeps ANSI mode from raising on 0."""
    return col(num).cast("double") / (col(den).cast("double") + F.lit(float(eps)))


def quantize(c, digits: int = 6) -> Column:
    """Round half up on the binary value: floor(x * 10^d + 0.5) / 10^d.

    The same IEEE operations in every engine, so results compare bit for bit
    (``round`` differs between engines on decimal ties).
    """
    s = float(10 ** digits)
    return F.floor(col(c).cast("double") * F.lit(s) + F.lit(0.5)).cast("double") / F.lit(s)


def capitalize(c) -> Column:
    """Upper-case the first character and lower-case the rest (not ``initcap``)."""
    x = col(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))


def hash_key(id_col, seed: int | str) -> Column:
    """md5 hex of ``id:seed`` -- a deterministic pseudo-random sort key that is
    independent of partitioning (replaces a seeded shuffle)."""
    return F.md5(F.concat(col(id_col).cast("string"), F.lit(f":{seed}")))


def hash_bucket(h, hex_digits: int = 4) -> Column:
    """Integer made from the first hex digits of an md5 key."""
    return F.conv(F.substring(col(h), 1, hex_digits), 16, 10).cast("long")


def band(x, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands: x <= edges[0] -> labels[0], ..., else labels[-1]."""
    v = col(x)
    expr = F.when(v.isNull(), F.lit(None).cast("string"))
    for e, lab in zip(edges, labels):
        expr = expr.when(v <= F.lit(float(e)), F.lit(lab))
    return expr.otherwise(F.lit(labels[-1]))
