"""Exact order statistics and running counts without one-partition windows.

Plain ``Window.partitionBy(model).orderBy(p)`` puts every row of a model into a
single task, and Spark's exact ``percentile`` keeps a map of every distinct
value in one buffer per group.  Both break when a group holds billions of
rows.  Everything here uses one pattern instead:

1. pooled split points from per-group ``percentile_approx`` (a bounded list:
   ``groups x n_edges`` doubles, size-checked before it reaches the driver);
2. ``Bucketizer`` (binary search, JVM side) assigns each row a bucket;
3. per-(group, bucket) totals -- a tiny table after map-side combine -- give
   exact offsets through a window over at most ``n_edges`` rows per group;
4. running sums / ranks only *inside* a (group, bucket) partition, after the
   rows were pre-aggregated by distinct value (a hot value collapses to one
   row before any shuffle).

The result is exact: bucket edges only decide how work is split, never the
answer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmap.session import ensure_checkpoint_dir

BUCKET = "_bkt"
MAX_GROUPS = 512          # groups x n_edges doubles reach the driver
FINE_EDGES = 4096         # quantiles asked for; large groups use them all
MIN_EDGES = 256
ROWS_PER_BUCKET = 2_000_000
POOLED_EDGES = 8192       # at most this many split points, so offsets are groups x this
APPROX_ACCURACY = 10000


def _groups(group_cols: Sequence[str] | str | None) -> list[str]:
    if group_cols is None:
        return []
    if isinstance(group_cols, str):
        return [group_cols]
    return list(group_cols)


_DUMMY = "_g0"


def _grouped(df: DataFrame, group_cols) -> tuple[DataFrame, list[str], bool]:
    """Add a constant group key when none is given, so one code path serves both."""
    g = _groups(group_cols)
    if g:
        return df, g, False
    return df.withColumn(_DUMMY, F.lit(0)), [_DUMMY], True


def quantile_edges(df: DataFrame, group_cols, value_col: str, n_edges: int | None = None,
                   max_groups: int = MAX_GROUPS) -> list[float]:
    """Sorted distinct split points pooled over the per-group approximate quantiles.

    A group contributes one split per ``ROWS_PER_BUCKET`` rows (``MIN_EDGES`` at
    least, ``FINE_EDGES`` at most), unless ``n_edges`` fixes the number.  Pooling
    keeps one ``Bucketizer`` for all groups; the pool is thinned evenly to
    ``POOLED_EDGES``, so the offset tables stay bounded by groups x edges.
    """
    g = _groups(group_cols)
    fine = n_edges or FINE_EDGES
    probs = [i / fine for i in range(1, fine)]
    v = F.col(value_col).cast("double")
    agg = (df.select(*g, v.alias("_v"))
             .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
             .groupBy(*g)
             .agg(F.percentile_approx("_v", probs, APPROX_ACCURACY).alias("_e"),
                  F.count(F.lit(1)).alias("_n")))
    rows = agg.limit(max_groups + 1).collect()
    if len(rows) > max_groups:
        raise ValueError(f"{len(rows)} groups exceed max_groups={max_groups}; "
                         "group by a low-cardinality key")
    edges: set[float] = set()
    for r in rows:
        own = [float(x) for x in (r["_e"] or []) if x is not None and math.isfinite(x)]
        want = fine if n_edges else max(MIN_EDGES, r["_n"] // ROWS_PER_BUCKET)
        edges.update(own[::max(1, fine // want)])
    pooled = sorted(edges)
    return pooled[::max(1, -(-len(pooled) // POOLED_EDGES))]


def add_bucket(df: DataFrame, value_col: str, edges: list[float],
               out: str = BUCKET) -> DataFrame:
    """Bucket index (double) by binary search over ``edges``; NaN gets the last bucket."""
    splits = [-math.inf] + [e for e in edges] + [math.inf]
    if len(splits) < 3:
        splits = [-math.inf, 0.0, math.inf]
    tmp = "_bv"
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return b.transform(df.withColumn(tmp, F.col(value_col).cast("double"))).drop(tmp)


def _offsets(totals: DataFrame, g: list[str], measures: list[str],
             descending: bool) -> DataFrame:
    """Exclusive prefix sums of bucket totals per group (small table)."""
    order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    w = Window.partitionBy(*g).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy(*g)
    cols = [F.coalesce(F.sum(m).over(w), F.lit(0)).alias(f"_off_{m}") for m in measures]
    cols += [F.sum(m).over(wall).alias(f"_tot_{m}") for m in measures]
    return totals.select(*g, BUCKET, *cols)


def running_sums(df: DataFrame, group_cols, order_col: str, measures: dict,
                 descending: bool = True, tie_col: str | None = None,
                 keep_cols: Sequence[str] = (), n_edges: int | None = None,
                 edges: list[float] | None = None) -> DataFrame:
    """Cumulative sums of ``measures`` in ``order_col`` order, per group.

    ``measures`` maps output name -> Column evaluated per input row.  Rows are
    first summed per distinct (group, order value, tie value, keep cols); the
    result has one row per such key with columns ``<m>`` (sum at the key),
    ``cum_<m>`` (inclusive running sum) and ``tot_<m>`` (group total).
    Ties in ``order_col`` are ordered by ``tie_col`` ascending.
    """
    df, g, dummy = _grouped(df, group_cols)
    keys = [order_col] + ([tie_col] if tie_col else []) + list(keep_cols)
    base = df.select(*g, *keys, *[c.alias(m) for m, c in measures.items()])
    if edges is None:
        edges = quantile_edges(base, [] if dummy else g, order_col, n_edges=n_edges)
    b = add_bucket(base, order_col, edges)
    names = list(measures)
    distinct = b.groupBy(*g, BUCKET, *keys).agg(*[F.sum(m).alias(m) for m in names])
    totals = distinct.groupBy(*g, BUCKET).agg(*[F.sum(m).alias(m) for m in names])
    # bounded: groups x (len(edges) + 2) rows
    offs = F.broadcast(_offsets(totals, g, names, descending))
    joined = distinct.join(offs, on=g + [BUCKET], how="inner")
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    order = [o] + ([F.col(tie_col).asc()] if tie_col else [])
    w = (Window.partitionBy(*g, BUCKET).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = joined.select(
        *g, *keys, *names,
        *[(F.col(f"_off_{m}") + F.sum(m).over(w)).alias(f"cum_{m}") for m in names],
        *[F.col(f"_tot_{m}").alias(f"tot_{m}") for m in names])
    return out.drop(_DUMMY) if dummy else out


def score_counts(scored: DataFrame, group_cols, score_col: str = "p", label_col: str = "y") -> DataFrame:
    """(group..., score, n, pos) in one scan, checkpointed: quantiles, curves and
    counts at thresholds all read this table instead of the rows."""
    ensure_checkpoint_dir(scored.sparkSession)
    return (scored.where(F.col(score_col).isNotNull()).groupBy(*_groups(group_cols), score_col)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label_col).cast("long")).alias("pos"))
            .checkpoint(eager=True))


def score_curve(scored: DataFrame, group_cols, score_col: str = "p", label_col: str = "y",
                n_edges: int | None = None, counted: bool = False) -> DataFrame:
    """One row per (group, distinct score), scores descending.  ``counted`` says that
    ``scored`` is a ``score_counts`` table.

    Columns: group..., ``p``, ``n`` rows at p, ``pos`` positives at p, ``neg``,
    ``tp``/``fp`` = positives/negatives with score >= p, ``tot_pos``/``tot_neg``.
    """
    g = _groups(group_cols)
    measures = ({"n": F.col("n"), "pos": F.col("pos")} if counted
                else {"n": F.lit(1).cast("long"), "pos": F.col(label_col).cast("long")})
    rs = running_sums(scored.where(F.col(score_col).isNotNull()), g, score_col, measures,
                      descending=True, n_edges=n_edges)
    return rs.select(
        *g, F.col(score_col).alias("p"), "n", "pos",
        (F.col("n") - F.col("pos")).alias("neg"),
        F.col("cum_pos").alias("tp"),
        (F.col("cum_n") - F.col("cum_pos")).alias("fp"),
        F.col("tot_pos").alias("tot_pos"),
        (F.col("tot_n") - F.col("tot_pos")).alias("tot_neg"))


def exact_percentiles(df: DataFrame, group_cols, value_col: str,
                      probs: Sequence[float] | DataFrame,
                      n_edges: int | None = None, edges: list[float] | None = None,
                      weight_col: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy's default rule), nulls ignored.

    With ``weight_col`` a row stands for that many equal rows.  ``probs`` is a list of q in [0, 1] or a DataFrame with columns (group...,
    ``q``) for per-group probabilities.  Output: group..., ``q``, ``value``
    with value = x[lo] + (h - lo) * (x[hi] - x[lo]), h = (n - 1) q.
    Only rows in the buckets that hold a target rank are ranked.
    """
    df, g, dummy = _grouped(df, group_cols)
    if isinstance(probs, DataFrame) and dummy:
        probs = probs.withColumn(_DUMMY, F.lit(0))
    weight = F.col(weight_col) if weight_col else F.lit(1)
    base = (df.select(*g, F.col(value_col).cast("double").alias("_v"), weight.cast("long").alias("_w"))
              .where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    if edges is None:
        edges = quantile_edges(base, [] if dummy else g, "_v", n_edges=n_edges)
    b = add_bucket(base, "_v", edges)
    totals = b.groupBy(*g, BUCKET).agg(F.sum("_w").alias("n"))
    offs = _offsets(totals, g, ["n"], descending=False)
    ranges = (totals.join(offs, on=g + [BUCKET])
                    .select(*g, BUCKET, F.col("_off_n").alias("start"),
                            (F.col("_off_n") + F.col("n")).alias("end"),
                            F.col("_tot_n").alias("N")))
    # written once (groups x edges rows at most): the steps below would each repeat its plan
    ensure_checkpoint_dir(df.sparkSession)
    ranges = ranges.checkpoint(eager=True)
    grp = ranges.select(*g, "N").distinct()
    if isinstance(probs, DataFrame):
        qdf = probs.select(*g, F.col("q").cast("double").alias("q"))
        targets = grp.join(qdf, on=g, how="inner")
    else:
        qs = F.array(*[F.lit(float(q)) for q in probs])
        targets = grp.select(*g, "N", F.explode(qs).alias("q"))
    h = (F.col("N") - 1).cast("double") * F.col("q")
    targets = targets.select(*g, "q", h.alias("h"),
                             F.floor(h).cast("long").alias("r_lo"),
                             F.ceil(h).cast("long").alias("r_hi"))
    ranks = targets.select(*g, "q", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("r_lo").alias("r")),
        F.struct(F.lit(1).alias("which"), F.col("r_hi").alias("r")))).alias("t")
    ).select(*g, "q", "t.which", "t.r").alias("rk")
    rg = ranges.select(*[F.col(c).alias(f"_rg_{c}") for c in g], F.col(BUCKET).alias("_rg_b"),
                       "start", "end")
    cond = [F.col(f"rk.{c}") == F.col(f"_rg_{c}") for c in g] + [
        F.col("rk.r") >= F.col("start"), F.col("rk.r") < F.col("end")]
    # bounded: groups x len(probs) x 2 ranks
    located = F.broadcast(ranks).join(rg, on=cond, how="inner").select(
        *[F.col(f"rk.{c}").alias(c) for c in g], F.col("rk.q").alias("q"),
        F.col("rk.which").alias("which"), (F.col("rk.r") - F.col("start")).alias("r_in"),
        F.col("_rg_b").alias(BUCKET))
    need = located.select(*g, BUCKET).distinct()
    # bounded: at most groups x len(probs) x 2 buckets
    rows = b.join(F.broadcast(need), on=g + [BUCKET], how="left_semi")
    dist = rows.groupBy(*g, BUCKET, "_v").agg(F.sum("_w").alias("c"))
    w = (Window.partitionBy(*g, BUCKET).orderBy("_v")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    dist = dist.withColumn("_cum", F.sum("c").over(w))
    dist = dist.select(*[F.col(c).alias(f"_d_{c}") for c in g], F.col(BUCKET).alias("_d_b"), "_v",
                       (F.col("_cum") - F.col("c")).alias("lo_in"), F.col("_cum").alias("hi_in"))
    cond2 = [F.col(c) == F.col(f"_d_{c}") for c in g] + [
        F.col(BUCKET) == F.col("_d_b"),
        F.col("r_in") >= F.col("lo_in"), F.col("r_in") < F.col("hi_in")]
    picked = F.broadcast(located).join(dist, on=cond2, how="inner").select(*g, "q", "which", "_v")
    vals = picked.groupBy(*g, "q").agg(
        F.max(F.when(F.col("which") == 0, F.col("_v"))).alias("x_lo"),
        F.max(F.when(F.col("which") == 1, F.col("_v"))).alias("x_hi"))
    res = vals.join(targets.select(*g, "q", "h"), on=g + ["q"], how="inner")
    frac = F.col("h") - F.floor("h")
    out = res.select(*g, "q", (F.col("x_lo") + frac * (F.col("x_hi") - F.col("x_lo"))).alias("value"))
    return out.drop(_DUMMY) if dummy else out


def threshold_counts(scored: DataFrame, group_cols, thresholds: DataFrame,
                     score_col: str = "p", label_col: str = "y",
                     threshold_col: str = "threshold", key_cols: Sequence[str] = (),
                     weight_col: str | None = None, positive_col: str | None = None) -> DataFrame:
    """Counts of rows with score >= each threshold, in one hash aggregate.

    ``thresholds`` (a report plan: groups x cut-offs, a few rows) has group...,
    ``key_cols`` and ``threshold_col``.  The distinct thresholds become the splits
    of a ``Bucketizer``; rows are counted per (group, bucket), and suffix sums over
    those few buckets give every count, without sorting any scores.  Pre-aggregated
    rows give their row and positive counts in ``weight_col`` and ``positive_col``.
    Output: group..., key_cols..., threshold, ``flagged_n``, ``tp``, ``tot_pos``, ``n_total``.
    """
    scored, g, dummy = _grouped(scored, group_cols)
    keys = list(key_cols)
    plan = thresholds.select(*([] if dummy else g), *keys,
                             F.col(threshold_col).cast("double").alias(threshold_col)).dropDuplicates()
    if dummy:
        plan = plan.withColumn(_DUMMY, F.lit(0))
    cuts = sorted({r[0] for r in plan.select(threshold_col).distinct().collect()
                   if r[0] is not None and math.isfinite(r[0])})
    n = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    pos = F.col(positive_col or label_col).cast("long")
    data = add_bucket(scored.where(F.col(score_col).isNotNull()).select(
        *g, F.col(score_col).alias("_s"), n.alias("_n"), pos.alias("_pos")), "_s", cuts)
    hist = data.groupBy(*g, BUCKET).agg(F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos"))
    marked = add_bucket(plan, threshold_col, cuts)
    marks = marked.select(*g, BUCKET, F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_pos"))
    both = hist.unionByName(marks.distinct()).groupBy(*g, BUCKET).agg(F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos"))
    down = (Window.partitionBy(*g).orderBy(F.col(BUCKET).desc())
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))  # thresholds + 2 rows a group
    every = Window.partitionBy(*g)
    sums = both.select(*g, BUCKET, F.sum("_n").over(down).alias("flagged_n"), F.sum("_pos").over(down).alias("tp"),
                       F.sum("_pos").over(every).alias("tot_pos"), F.sum("_n").over(every).alias("n_total"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*g, BUCKET]]
    res = marked.alias("m").join(sums.alias("s"), on=same).select(
        *[F.col(f"m.{c}").alias(c) for c in [*g, *keys, threshold_col]], "flagged_n", "tp", "tot_pos", "n_total")
    return res.drop(_DUMMY) if dummy else res


def numbered(df: DataFrame, order: Sequence[str], out: str = "place") -> DataFrame:
    """``df`` with the 0-based place of each row in the order, without a global window: rows
    are dealt by range and sorted inside their partitions, the sorted table is
    written once, and the driver gets one count per partition."""
    ensure_checkpoint_dir(df.sparkSession)
    fixed = df.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint(eager=True)
    fixed = fixed.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33).cast("int")
    starts, total = [], 0
    for row in sorted(fixed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((row["p"], total))
        total += row["n"]
    starts = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (fixed.withColumn("_part", part).join(F.broadcast(starts), "_part")
            .withColumn(out, F.col("_start") + within).drop("_at", "_part", "_start"))
