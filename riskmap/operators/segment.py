"""Dimensionality reduction and clustering.

PCA and K-Means are MLlib's.  Driver-side objects stay bounded by the model
size: d explained-variance ratios, the d x m loading matrix, k x m centroids,
and the <= 2,000-row sample of K8 given labels (the analysis' own sample bound).  The
sweep's silhouette covers all pairs of rows.

Determinism (K-Means with the same seed fits differently when the input is
partitioned differently): ``deterministic_layout`` fixes the partitioning by
id and the in-partition order before any fit, and cluster ids are renumbered
by (size desc, first centroid coordinate asc) before anything is reported.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, PCAModel, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmap.operators.features import PopulationStandardScaler
from riskmap.operators.split import bounded_sample

SILHOUETTE_SAMPLE = 2000
ROWS_PER_TASK = 50_000
PAIR_ROWS = 65_536        # rows whose distances to all rows one task adds up
PAIR_TILE = 1024          # rows by rows of distances that a task holds at once


def deterministic_layout(df: DataFrame, id_col: str, partitions: int | None = None) -> DataFrame:
    """A fixed hash layout by id and sorted rows, cached for iterative fits; about
    ``ROWS_PER_TASK`` rows per partition unless the number is given."""
    if partitions is None:
        partitions = max(1, math.ceil(df.count() / ROWS_PER_TASK))
    return df.repartition(partitions, id_col).sortWithinPartitions(id_col).persist()


def standardize_all(df: DataFrame, features_col: str = "features", out: str = "std") -> DataFrame:
    """Every column standardized (population std, constant -> 0)."""
    return PopulationStandardScaler(features_col, out).fit(df).transform(df)


# -- K1, K2 ------------------------------------------------------------------

def full_pca(df: DataFrame, features_col: str = "std", out: str = "pcs") -> PCAModel:
    """K1: all d components, fitted once; the first m of them serve K3."""
    d = len(df.select(features_col).first()[0])
    return PCA(k=d, inputCol=features_col, outputCol=out).fit(df)


def pca_variance(model: PCAModel) -> list[float]:
    """K1: explained-variance ratios (d values)."""
    return [float(x) for x in model.explainedVariance.toArray()]


def components_for(ratios: Sequence[float], target: float = 0.80) -> int:
    """K2: smallest m whose cumulative ratio reaches ``target``."""
    cum = np.cumsum(ratios)
    return int(np.searchsorted(cum, target) + 1)


def variance_table(spark, ratios: Sequence[float], target: float = 0.80) -> DataFrame:
    m = components_for(ratios, target)
    cum = np.cumsum(ratios)
    rows = [(i + 1, float(r), float(c), i + 1 == m) for i, (r, c) in enumerate(zip(ratios, cum))]
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double, chosen boolean")


# -- K3-K5 --------------------------------------------------------------------

def pca_project(model: PCAModel, m: int, out: str = "pca") -> PipelineModel:
    """K3: projection to the first m components (input is already mean-centred by E8)."""
    return PipelineModel([model, VectorSlicer(inputCol=model.getOutputCol(), outputCol=out, indices=list(range(m)))])


def fixed_sign_components(model: PCAModel, m: int) -> np.ndarray:
    """d x m loadings with each component's largest |loading| made positive."""
    pc = model.pc.toArray()[:, :m].copy()
    for j in range(pc.shape[1]):
        i = int(np.argmax(np.abs(pc[:, j])))
        if pc[i, j] < 0:
            pc[:, j] = -pc[:, j]
    return pc


def loadings_table(spark, model: PCAModel, m: int, names: Sequence[str]) -> DataFrame:
    """K4: long (feature, pc, loading)."""
    pc = fixed_sign_components(model, m)
    rows = [(names[i], f"PC{j + 1}", float(pc[i, j])) for i in range(pc.shape[0]) for j in range(pc.shape[1])]
    return spark.createDataFrame(rows, "feature string, pc string, loading double")


def top_loadings(loadings: DataFrame, pcs: Sequence[str] = ("PC1", "PC2", "PC3"), k: int = 8) -> DataFrame:
    """K5: top k features by |loading| per component, listed in signed order."""
    w = Window.partitionBy("pc").orderBy(F.desc(F.abs("loading")), "feature")
    t = loadings.where(F.col("pc").isin(list(pcs))).withColumn("rank", F.row_number().over(w))
    return t.where(F.col("rank") <= k).orderBy("pc", "loading")


# -- K6-K10 ------------------------------------------------------------------

def kmeans_tolerance(df: DataFrame, k: int, features_col: str = "pca", relative: float = 1e-4) -> float:
    """Movement per centre at which a fit stops: the squared movements of all centres
    add up to ``relative`` times the mean variance of the columns."""
    var = df.select(Summarizer.variance(F.col(features_col)).alias("v")).first()["v"]
    mean = float(np.mean(var.toArray())) if var is not None and len(var) else 0.0
    return math.sqrt(relative * mean / k)


def kmeans_pool(df: DataFrame, runs: Sequence[tuple[int, int]], n_init: int = 20, features_col: str = "pca",
                max_iter: int = 300, parallelism: int = 8) -> list[KMeansModel]:
    """K6: for every (k, seed) the lowest-cost fit of ``n_init`` seeded restarts.  MLlib
    seeds each restart; ``restart_costs`` follows all of them to their ends together, a
    scan of the rows per iteration whatever their number; then MLlib fits the restart of
    each run whose cost is lowest (the first of those equal but for rounding)."""
    tol = {k: kmeans_tolerance(df, k, features_col) for k in {k for k, _ in runs}}

    def fit(task, iterations=max_iter):
        (k, seed), i = task
        return KMeans(k=k, seed=seed + 7919 * i, featuresCol=features_col, maxIter=iterations,
                      tol=tol[k], predictionCol="cluster").fit(df)

    tasks = [(run, i) for run in runs for i in range(n_init)]
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(tasks)))) as ex:
        if n_init > 1:
            starts = list(ex.map(lambda t: np.array(fit(t, 0).clusterCenters(), dtype=float), tasks))
            costs = restart_costs(df, starts, [tol[k] for (k, _), _ in tasks], features_col, max_iter).reshape(-1, n_init)
            tasks = [(run, int(np.argmax(c <= c.min() * (1 + 1e-12)))) for run, c in zip(runs, costs)]
        return list(ex.map(fit, tasks))


def restart_costs(df: DataFrame, starts: Sequence[np.ndarray], tols: Sequence[float], features_col: str = "pca",
                  max_iter: int = 300) -> np.ndarray:
    """Cost at which Lloyd's iteration ends from every start (k x d centres): as MLlib's, it
    ends once no centre moves further than the tolerance, the cost is that of the last
    assignment, and a centre without rows stays.  One job an iteration assigns the rows
    for all starts that still move; the driver gets a row per centre."""
    spark, d = df.sparkSession, len(starts[0][0])
    rows = df.select(vector_to_array(features_col).alias("x"))
    centres, costs, moving = [c.copy() for c in starts], np.full(len(starts), np.inf), list(range(len(starts)))
    sums = ", ".join(f"s{i} double" for i in range(d + 2))
    for _ in range(max_iter):
        if not moving:
            break
        sent = spark.sparkContext.broadcast([centres[i] for i in moving])

        def assign_all(batches, sent=sent):
            totals = [np.zeros((len(c), d + 2)) for c in sent.value]      # sum of rows, their number, cost
            for batch in batches:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
                wide = np.column_stack([x, np.ones(len(x)), (x * x).sum(1)])
                for total, c in zip(totals, sent.value):
                    away = (c * c).sum(1) - 2.0 * x @ c.T
                    near = np.argmin(away, axis=1)
                    mine = (near[:, None] == np.arange(len(c))).astype(float)
                    total += mine.T @ wide
                    total[:, d + 1] += (mine * away).sum(0)
            at = np.concatenate([np.full(len(t), i, dtype=np.int32) for i, t in enumerate(totals)])
            which = np.concatenate([np.arange(len(t), dtype=np.int32) for t in totals])
            every = np.concatenate(totals)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(which)] + [pa.array(every[:, i]) for i in range(d + 2)],
                                             names=["start", "centre"] + [f"s{i}" for i in range(d + 2)])

        got = (rows.mapInArrow(assign_all, f"start int, centre int, {sums}").groupBy("start", "centre")
               .agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(d + 2)]).toArrow())
        sent.destroy()
        start, which = got.column("start").to_numpy(), got.column("centre").to_numpy()
        every = np.column_stack([got.column(f"s{i}").to_numpy() for i in range(d + 2)])
        still = []
        for at, i in enumerate(moving):
            mine, old = start == at, centres[i]
            new = old.copy()
            filled = mine & (every[:, d] > 0)
            new[which[filled]] = every[filled, :d] / every[filled, d:d + 1]
            costs[i], centres[i] = float(every[mine, d + 1].sum()), new
            if np.sqrt(((new - old) ** 2).sum(1)).max() > tols[i]:
                still.append(i)
        moving = still
    return costs


def kmeans_best_of(df: DataFrame, k: int, n_init: int = 20, seed: int = 42,
                   features_col: str = "pca", max_iter: int = 300, parallelism: int = 8) -> KMeansModel:
    """K6 for one k."""
    return kmeans_pool(df, [(k, seed)], n_init, features_col, max_iter, parallelism)[0]


def canonical_labels(model: KMeansModel, df: DataFrame, features_col: str = "pca") -> dict[int, int]:
    """Renumber clusters by size desc, then first centroid coordinate asc."""
    sizes = {r[0]: r[1] for r in model.transform(df).groupBy("cluster").count().collect()}
    cents = model.clusterCenters()
    order = sorted(range(len(cents)), key=lambda c: (-sizes.get(c, 0), float(cents[c][0])))
    return {old: new for new, old in enumerate(order)}


def assign(model: KMeansModel, df: DataFrame, mapping: dict[int, int] | None = None,
           out: str = "cluster") -> DataFrame:
    """Nearest centroid, optionally renumbered canonically."""
    res = model.transform(df)
    if mapping:
        m = F.create_map(*[x for a, b in mapping.items() for x in (F.lit(a), F.lit(b))])
        res = res.withColumn("cluster", m[F.col("cluster")])
    return res.withColumnRenamed("cluster", out) if out != "cluster" else res


def nearest_centroid(df: DataFrame, array_col: str, centroids: DataFrame, out: str = "cluster") -> DataFrame:
    """K14 over a centroid table (cluster, coords): the cluster at the smallest Euclidean
    distance, ties to the smaller id; null for a null array.  The table (k rows)
    becomes one literal array, and the argmin stays in native expressions."""
    rows = sorted(((r["cluster"], r["coords"]) for r in centroids.select("cluster", "coords").collect()))
    if not rows:
        raise ValueError("no centroids")
    table = F.array(*[F.struct(F.lit(c).alias("cluster"), F.array(*[F.lit(float(v)) for v in x]).alias("x")) for c, x in rows])

    def away(c):
        return F.aggregate(F.zip_with(F.col(array_col), c["x"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)

    best = F.array_min(F.transform(table, lambda c: F.struct(away(c).alias("d"), c["cluster"].alias("cluster"))))
    return df.withColumn(out, F.when(F.col(array_col).isNotNull(), best["cluster"]))


def silhouette_exact(df: DataFrame, id_col: str, features_col: str, label_col: str,
                     sample_size: int = SILHOUETTE_SAMPLE, seed: int = 42,
                     partitions: int = 8) -> float:
    """K8: mean Euclidean silhouette on a bounded hash-ranked sample.

    The sample (<= ``sample_size`` rows x m dims) is broadcast; rows of the
    sample are spread over tasks and each task computes its rows' a(i), b(i)
    against the whole sample with numpy.  A singleton cluster scores 0.
    """
    spark = df.sparkSession
    s = bounded_sample(df.select(id_col, features_col, label_col), id_col, sample_size, seed)
    rows = s.select(id_col, vector_to_array(features_col).alias("x"), label_col).collect()
    if not rows:
        return float("nan")
    X = np.array([r["x"] for r in rows], dtype=float)
    lab = np.array([r[label_col] for r in rows])
    b_x = spark.sparkContext.broadcast(X)
    b_l = spark.sparkContext.broadcast(lab)
    n = len(rows)

    def part(it):
        Xa, La = b_x.value, b_l.value
        sq = (Xa * Xa).sum(1)
        labels = np.unique(La)
        masks = {c: (La == c) for c in labels}
        sizes = {c: int(m.sum()) for c, m in masks.items()}
        for pdf in it:
            idx_all = pdf["i"].to_numpy()
            for lo in range(0, idx_all.size, 256):            # bounded block: 256 x n distances
                idx = idx_all[lo:lo + 256]
                d = np.sqrt(np.maximum(sq[idx, None] + sq[None, :] - 2.0 * Xa[idx] @ Xa.T, 0.0))
                d[np.arange(idx.size), idx] = 0.0
                out = np.zeros(idx.size)
                for r, i in enumerate(idx):
                    own = La[i]
                    if sizes[own] <= 1 or labels.size < 2:
                        continue
                    a = d[r, masks[own]].sum() / (sizes[own] - 1)
                    b = min(d[r, masks[c]].mean() for c in labels if c != own)
                    out[r] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
                yield pd.DataFrame({"s": out})

    idx = spark.range(0, n, 1, max(1, min(partitions, n))).select(F.col("id").cast("long").alias("i"))
    try:
        res = idx.mapInPandas(part, "s double").agg(F.avg("s")).collect()[0][0]
    finally:
        b_x.destroy()
        b_l.destroy()
    return float(res)


def silhouette_full(df: DataFrame, features_col: str, label_col: str) -> float | None:
    """K8 on all rows: MLlib's squared-Euclidean silhouette, distributed and linear."""
    if df.select(label_col).distinct().limit(2).count() < 2:
        return None
    return float(ClusteringEvaluator(featuresCol=features_col, predictionCol=label_col,
                                     metricName="silhouette").evaluate(df))


def silhouettes_all(df: DataFrame, models: Sequence[KMeansModel], features_col: str = "pca") -> list[float]:
    """K8 on all rows: the mean Euclidean silhouette of every row under each model.

    Rows are dealt into groups of at most ``PAIR_ROWS``.  A task gets its group's rows
    first and then all rows, in order, and adds up each of its rows' distances to every
    cluster of every model, a tile at a time: distances are computed once for all models,
    and memory is bounded by the group.  All pairs are visited, so time grows with the
    square of the rows.  Rows of a cluster of one score 0, as do all rows where one
    cluster has them all.
    """
    spark = df.sparkSession
    centres = [np.array(m.clusterCenters(), dtype=float) for m in models]
    ends = np.cumsum([0] + [len(c) for c in centres])
    rows = df.select(vector_to_array(features_col).alias("x"))
    n = rows.count()
    if not n:
        return [float("nan")] * len(centres)
    groups = max(math.ceil(n / PAIR_ROWS), min(spark.sparkContext.defaultParallelism, math.ceil(n / 256)))

    def label(batches):
        at, seen = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = np.column_stack([first + np.argmin((c * c).sum(1) - 2.0 * x @ c.T, axis=1)
                                        for first, c in zip(ends, centres)]).astype(np.int32)
                order = np.arange(seen, seen + len(x))
                seen += len(x)
                stops = pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at + order), pa.array((order % groups).astype(np.int32)), batch.column(0),
                     pa.ListArray.from_arrays(stops, pa.array(near.ravel()))], names=["place", "own", "x", "near"])

    def score(held, sums, sizes):
        """Sum of the silhouettes of a group's rows, under each model."""
        out, every = [], np.arange(len(held))
        for i, (first, end) in enumerate(zip(ends, ends[1:])):
            own, size, s = held[:, i] - first, sizes[first:end], sums[:, first:end]
            others = np.where(size > 0, s / np.maximum(size, 1), np.inf)
            others[every, own] = np.inf
            a, b = s[every, own] / np.maximum(size[own] - 1, 1), others.min(1)
            top = np.maximum(a, b)
            fine = (size[own] > 1) & np.isfinite(b) & (top > 0)
            out.append(float(((b - a)[fine] / top[fine]).sum()))
        return out

    def add_up(batches):
        """Of each group in turn: its rows (role 0), then all rows (role 1)."""
        group, mine, sums = None, [], None

        def ended():
            return pa.RecordBatch.from_arrays(
                [pa.array([group] * len(centres), pa.int32()), pa.array(range(len(centres)), pa.int32()),
                 pa.array(score(near, sums, sizes))], names=["g", "model", "s"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            places, owns = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            xs = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            nears = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            cuts = np.flatnonzero((np.diff(g) != 0) | (np.diff(role) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(g)]):
                if g[lo] != group:
                    if group is not None:
                        yield ended()
                    group, mine, sums = int(g[lo]), [], None
                if role[lo] == 0:
                    mine.append((places[lo:hi], xs[lo:hi], nears[lo:hi]))
                    continue
                if sums is None:
                    place, x, near = (np.concatenate(v) for v in zip(*mine))
                    mine, sums, sizes = [], np.zeros((len(x), ends[-1])), np.zeros(ends[-1])
                    squares = (x * x).sum(1)
                for at in range(lo, hi, PAIR_TILE):
                    to = min(at + PAIR_TILE, hi)
                    y, its = xs[at:to], np.zeros((to - at, ends[-1]))
                    its[np.arange(to - at)[:, None], nears[at:to]] = 1.0
                    sizes += its.sum(0)
                    same = np.flatnonzero(owns[at:to] == group)
                    where = np.searchsorted(place, places[at:to][same])
                    for top in range(0, len(x), PAIR_TILE):
                        end = min(top + PAIR_TILE, len(x))
                        d = squares[top:end, None] + (y * y).sum(1)[None, :] - 2.0 * x[top:end] @ y.T
                        d = np.sqrt(np.maximum(d, 0.0, out=d), out=d)
                        here = (where >= top) & (where < end)
                        d[where[here] - top, same[here]] = 0.0
                        sums[top:end] += d @ its
        if group is not None:
            yield ended()

    placed = rows.mapInArrow(label, "place long, own int, x array<double>, near array<int>")
    each = F.concat(F.array(F.struct(F.col("own").alias("g"), F.lit(0).alias("role"))),
                    F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda i: F.struct(i.alias("g"), F.lit(1).alias("role"))))
    met = (placed.select(F.explode(each).alias("to"), "place", "own", "x", "near").select("to.*", "place", "own", "x", "near")
           .repartitionByRange(groups, "g").sortWithinPartitions("g", "role", "place"))
    got = met.mapInArrow(add_up, "g int, model int, s double").orderBy("model", "g").collect()      # groups x models
    return [math.fsum(r["s"] for r in got if r["model"] == i) / n for i in range(len(centres))]


def kmeans_sweep(df: DataFrame, id_col: str, ks: Sequence[int] = range(2, 9), n_init: int = 20,
                 seed: int = 42, features_col: str = "pca", parallelism: int = 8) -> tuple[DataFrame, dict]:
    """K7: (k, inertia, silhouette, silhouette_full) per k; the table and the models.
    ``silhouette`` is Euclidean over all pairs of rows, ``silhouette_full`` MLlib's squared one."""
    fitted = kmeans_pool(df, [(int(k), seed) for k in ks], n_init, features_col, parallelism=parallelism)
    euclidean = silhouettes_all(df, fitted, features_col)

    def row(task):
        k, m, s = task
        lab = m.transform(df).select(id_col, features_col, "cluster")
        return int(k), float(m.summary.trainingCost), s, silhouette_full(lab, features_col, "cluster")

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        rows = list(ex.map(row, zip(ks, fitted, euclidean)))
    t = df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, silhouette_full double")
    return t, {int(k): m for k, m in zip(ks, fitted)}


def best_k(sweep: DataFrame, cap: int | None = None, metric: str = "silhouette") -> DataFrame:
    """Argmax of ``metric`` (ties to the smaller k), inside the cap if given."""
    s = sweep if cap is None else sweep.where(F.col("k") <= cap)
    return s.orderBy(F.desc(metric), F.asc("k")).limit(1)


# -- K11-K13 -----------------------------------------------------------------

def assign_runs(models: dict[int, KMeansModel], df: DataFrame, id_col: str, features_col: str = "pca") -> DataFrame:
    """(id, run, label): nearest centroid under every run's model, in one scan.  The
    centroids of all runs (runs x k x m numbers) go out with the tasks."""
    centres = {int(r): np.array(m.clusterCenters(), dtype=float) for r, m in models.items()}

    def label(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            sq = (x * x).sum(1)[:, None]
            for run, c in centres.items():
                near = np.argmin(sq + (c * c).sum(1)[None, :] - 2.0 * x @ c.T, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(near), run, dtype=np.int32)), pa.array(near.astype(np.int32))],
                    names=[id_col, "run", "label"])

    source = df.select(id_col, vector_to_array(features_col).alias("_x"))
    schema = T.StructType([source.schema[id_col], T.StructField("run", T.IntegerType()), T.StructField("label", T.IntegerType())])
    return source.mapInArrow(label, schema)


def stability_labels(df: DataFrame, id_col: str, k: int, seeds: Sequence[int],
                     n_init: int = 20, features_col: str = "pca") -> DataFrame:
    """(id, run, label) for refits at k under several seeds."""
    models = kmeans_pool(df, [(k, int(s)) for s in seeds], n_init, features_col)
    return assign_runs({int(s): m for s, m in zip(seeds, models)}, df, id_col, features_col)


def ari_pairs(labels: DataFrame, id_col: str = "id", run_col: str = "run",
              label_col: str = "label") -> DataFrame:
    """Adjusted Rand index for every pair of runs (both orders, diagonal 1).

    Labels are gathered per id (one row per id with its runs' labels), every
    pair of runs is emitted per id (runs^2, bounded by the number of runs), and
    one grouped count builds all contingency tables at once.  ARI comes from
    the pair-confusion counts; identical partitions score 1.
    """
    runs = sorted(r[0] for r in labels.select(run_col).distinct().collect())   # a few runs
    per_id = labels.groupBy(id_col).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(run_col), F.col(label_col)))).alias("m"))
    pairs = F.array(*[F.struct(F.lit(a).alias("ra"), F.lit(b).alias("rb"),
                               F.col("m")[a].alias("a"), F.col("m")[b].alias("b"))
                      for i, a in enumerate(runs) for b in runs[i + 1:]])
    if len(runs) < 2:
        return labels.sparkSession.createDataFrame([(r, r, 1.0) for r in runs], "run_a int, run_b int, ari double")
    cont = per_id.select(F.explode(pairs).alias("p")).select("p.*").groupBy("ra", "rb", "a", "b").agg(
        F.count(F.lit(1)).cast("double").alias("nij"))
    rows_ = cont.groupBy("ra", "rb", "a").agg(F.sum("nij").alias("ai")).groupBy("ra", "rb").agg(
        F.sum(F.col("ai") * F.col("ai")).alias("A2"))
    cols_ = cont.groupBy("ra", "rb", "b").agg(F.sum("nij").alias("bj")).groupBy("ra", "rb").agg(
        F.sum(F.col("bj") * F.col("bj")).alias("B2"))
    tot = cont.groupBy("ra", "rb").agg(F.sum(F.col("nij") * F.col("nij")).alias("SS"), F.sum("nij").alias("N"))
    j = tot.join(rows_, ["ra", "rb"]).join(cols_, ["ra", "rb"])
    tp = F.col("SS") - F.col("N")
    fp = F.col("B2") - F.col("SS")
    fn = F.col("A2") - F.col("SS")
    tn = F.col("N") * F.col("N") - F.col("A2") - F.col("B2") + F.col("SS")
    ari = F.when((fn == 0) & (fp == 0), F.lit(1.0)).otherwise(
        F.lit(2.0) * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)))
    up = j.select(F.col("ra").cast("int").alias("run_a"), F.col("rb").cast("int").alias("run_b"), ari.alias("ari"))
    low = up.select(F.col("run_b").alias("run_a"), F.col("run_a").alias("run_b"), "ari")
    diag = labels.sparkSession.createDataFrame([(int(r), int(r), 1.0) for r in runs],
                                               "run_a int, run_b int, ari double")
    return up.unionByName(low).unionByName(diag)


def mean_offdiag(ari: DataFrame) -> DataFrame:
    """Mean ARI over the upper triangle."""
    return ari.where(F.col("run_a") < F.col("run_b")).agg(F.avg("ari").alias("mean_ari"))


def projection_points(df: DataFrame, id_col: str, pca_col: str = "pca", label_col: str = "cluster") -> DataFrame:
    """(id, pc1, pc2, label) for the 2-D view."""
    a = vector_to_array(pca_col)
    return df.select(id_col, a[0].alias("pc1"), a[1].alias("pc2"), label_col)
