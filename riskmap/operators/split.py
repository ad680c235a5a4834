"""Sampling and splitting (S1-S5) by hash rank instead of a seeded shuffle.

Every row gets ``h = md5(id:seed)``; order by (h, id) is a pseudo-random
permutation that does not depend on partitioning, executor count or retries,
so a lost executor recomputes exactly the same split.

A plain ``row_number() OVER (PARTITION BY class ORDER BY h)`` would put each
class -- half or more of the table -- into one task.  Instead (scale recipe):
the first hex digits of ``h`` define up to 65,536 buckets per class; bucket
counts (a tiny table) locate the bucket that holds the cut, rows below it are
test, rows above are train, and only the boundary bucket is ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmap.functions.columns import hash_bucket, hash_key

HEX_DIGITS = 4


def labelled(df: DataFrame, label_col: str) -> DataFrame:
    """``df``, failing when a row without a label is read: it has no stratum."""
    missing = F.raise_error(F.lit(f"null in label column {label_col}"))
    kind = df.schema[label_col].dataType
    return df.withColumn(label_col, F.coalesce(F.col(label_col), missing.cast(kind)))


def class_allocation(counts: DataFrame, label_col: str, n_draw_col: str) -> DataFrame:
    """Largest-remainder allocation of draws over classes (sklearn's approximate mode).

    ``counts`` has (label, n_c, and ``n_draw_col`` = draws for the whole table).
    Floor the proportional share, then hand the leftover draws to the largest
    remainders (ties to the smaller label).  The table has one row per class.
    """
    tot = Window.partitionBy(F.lit(0))
    cont = F.col(n_draw_col) * F.col("n_c") / F.sum("n_c").over(tot)
    c = counts.select("*", cont.alias("_cont")).select(
        "*", F.floor("_cont").alias("_fl"), (F.col("_cont") - F.floor("_cont")).alias("_rem"))
    c = c.select("*", (F.col(n_draw_col) - F.sum("_fl").over(tot)).alias("_need"))
    rk = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rem"), F.asc(label_col)))
    return c.select(label_col, "n_c", (F.col("_fl") + F.when(rk <= F.col("_need"), 1).otherwise(0))
                    .cast("long").alias("alloc"))


def _ranked_cut(df: DataFrame, id_col: str, label_col: str, cut: DataFrame, seed,
                hex_digits: int) -> DataFrame:
    """Rows with rank-in-class <= cut.alloc are flagged ``_in``; exact, bucket-parallel."""
    h = hash_key(id_col, seed)
    rows = df.select("*", h.alias("_h")).select("*", hash_bucket("_h", hex_digits).alias("_b"))
    # bucket histogram per class: at most classes x 16^hex_digits rows
    hist = rows.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    w = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.select(label_col, "_b", "_nb", F.coalesce(F.sum("_nb").over(w), F.lit(0)).alias("_before"))
    hist = hist.join(F.broadcast(cut.select(label_col, "alloc")), on=label_col)
    bnd = hist.where((F.col("_before") < F.col("alloc")) & (F.col("alloc") <= F.col("_before") + F.col("_nb")))
    bnd = bnd.select(label_col, F.col("_b").alias("_bb"), (F.col("alloc") - F.col("_before")).alias("_need"))
    # one row per class (classes with alloc 0 have no boundary: all rows out)
    tagged = rows.join(F.broadcast(bnd), on=label_col, how="left")
    direct = tagged.where(F.col("_bb").isNull() | (F.col("_b") != F.col("_bb"))).select(
        "*", (F.col("_bb").isNotNull() & (F.col("_b") < F.col("_bb"))).alias("_in"))
    edge = tagged.where(F.col("_b") == F.col("_bb"))
    rk = F.row_number().over(Window.partitionBy(label_col, "_b").orderBy("_h", id_col))
    edge = edge.select("*", (rk <= F.col("_need")).alias("_in"))
    return direct.unionByName(edge).drop("_h", "_b", "_bb", "_need")


def stratified_split(df: DataFrame, id_col: str, label_col: str, test_size: float = 0.2,
                     seed: int = 42, hex_digits: int = HEX_DIGITS,
                     split_col: str = "split") -> DataFrame:
    """Stratified hold-out.  n_test = ceil(test_size * n); train shares are
    allocated first and the test share of each class is the rest (as sklearn).
    A null label is an error."""
    df = labelled(df, label_col)
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    tot = Window.partitionBy(F.lit(0))
    n = F.sum("n_c").over(tot)
    counts = counts.select("*", (n - F.ceil(n * F.lit(float(test_size)))).alias("_ntrain"))
    train_alloc = class_allocation(counts, label_col, "_ntrain")
    rem = train_alloc.select(label_col, (F.col("n_c") - F.col("alloc")).alias("n_c"))
    rem = rem.select("*", F.sum("n_c").over(tot).alias("_ntest"))
    test_alloc = class_allocation(rem, label_col, "_ntest")
    cut = _ranked_cut(df, id_col, label_col, test_alloc, seed, hex_digits)
    return cut.withColumn(split_col, F.when(F.col("_in"), F.lit("test")).otherwise(F.lit("train"))
                          ).drop("_in")


def stratified_folds(df: DataFrame, id_col: str, label_col: str, n_splits: int = 5,
                     seed: int = 4242, hex_digits: int = HEX_DIGITS,
                     fold_col: str = "fold") -> DataFrame:
    """Stratified k-fold labels.

    Rows sorted by (label, h, id) are dealt round-robin over folds, which gives
    sklearn's per-fold class counts; the global rank is offset(class) +
    offset(bucket) + rank inside the bucket, so no window spans a class.
    """
    h = hash_key(id_col, seed)
    rows = labelled(df, label_col).select("*", h.alias("_h")).select("*", hash_bucket("_h", hex_digits).alias("_b"))
    hist = rows.groupBy(label_col, "_b").agg(F.count(F.lit(1)).alias("_nb"))
    inside = Window.partitionBy(label_col).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(label_col).rowsBetween(Window.unboundedPreceding, -1)     # one row per class
    classes = hist.groupBy(label_col).agg(F.sum("_nb").alias("_nc")).select(
        label_col, F.coalesce(F.sum("_nc").over(before), F.lit(0)).alias("_first"))
    offs = hist.select(label_col, "_b", F.coalesce(F.sum("_nb").over(inside), F.lit(0)).alias("_in")).join(
        classes, label_col).select(label_col, "_b", (F.col("_first") + F.col("_in")).alias("_off"))
    # classes x 16^hex_digits rows at most; Spark chooses the join by its size
    j = rows.join(offs, on=[label_col, "_b"])
    rk = F.row_number().over(Window.partitionBy(label_col, "_b").orderBy("_h", id_col))
    return j.select("*", ((F.col("_off") + rk - 1) % n_splits).cast("int").alias(fold_col)).drop(
        "_h", "_b", "_off")


def bounded_sample(df: DataFrame, id_col: str, n: int = 2000, seed: int = 42,
                   oversample: float = 2.0) -> DataFrame:
    """The first min(n, rows) rows in (md5(id:seed), id) order.

    A plain ``orderBy().limit(n)`` moves n rows from *every* partition into
    one task.  Instead a prefix of the hash order is cut out first: the top 48
    bits of the md5 are uniform, so ``u < c * n / N`` keeps about c * n rows and
    always keeps a prefix of the order; if fewer than n survive, c doubles.
    The final top-n then runs on that small set.  Exact, whatever N is.
    """
    h = hash_key(id_col, seed)
    top48 = F.conv(F.substring(h, 1, 12), 16, 10).cast("long")
    total = df.count()
    if total <= n:
        return df
    span = float(16 ** 12)
    frac = min(1.0, oversample * n / total)
    while True:
        cand = df.where(top48 < F.lit(int(frac * span)))
        if frac >= 1.0 or cand.count() >= n:
            break
        frac = min(1.0, frac * 2)
    return cand.orderBy(h, F.col(id_col)).limit(n)


def union_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """S5."""
    return a.unionByName(b)
