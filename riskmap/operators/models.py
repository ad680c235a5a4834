"""Model training, search and scoring (M1-M3, M6-M12, S3) on MLlib solvers.

No optimiser is written here: LogisticRegression, LinearSVC and
RandomForestClassifier are MLlib's.  What this module adds is the mapping of
the analysis' hyper-parameters onto MLlib's objective, stratified-fold search
scored by *step-wise* average precision, out-of-fold scoring and Platt
calibration -- all keyed by id, never by row position.

Objective mapping (n rows, weights w, sklearn-style inverse strength C):
    C * sum_i w_i loss_i + 1/2 ||beta||^2  ==  (1/sum w) sum_i w_i loss_i + regParam/2 ||beta||^2
    with regParam = 1 / (C * sum w).  Features are standardized by the pipeline,
    so MLlib's own ``standardization`` is off.
"""

from __future__ import annotations

import itertools
import math
import threading
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import QuantileDiscretizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmap.functions.columns import qcol
from riskmap.operators.features import FeatureModel, PopulationStandardScaler
from riskmap.operators.metrics import curve_summary
from riskmap.operators.split import labelled

FEATURES = "features"
ROWS_PER_TASK = 200_000
MAX_DEPTH_CAP = 30        # MLlib's limit stands in for "unlimited" depth
MAX_FITS = 32             # driver threads that wait for fits


def safe_matrix(fm: FeatureModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Feature columns renamed f_0..f_{d-1} (names like 'nation=UNITED STATES'
    are not valid assembler inputs); ``fm.columns[i]`` is the name of f_i."""
    cols = fm.feature_columns(df)
    return df.select(*[qcol(c) for c in keep],
                     *[c.alias(f"f_{i}") for i, c in enumerate(cols)])


def feature_stages(fm: FeatureModel, scale: bool, out: str = FEATURES, bins: int = 0) -> list:
    """Standardize the numeric block (population std), pass binary columns.

    With ``bins`` (trees) every numeric and count column becomes its quantile bin, at most
    ``bins`` of them; the assembled vectors are sparse where most bins are the lowest.
    """
    nn = len(fm.numeric)
    num = [f"f_{i}" for i in range(nn)]
    binary = [f"f_{i}" for i in range(nn, len(fm.columns))]
    if bins:
        many = num + binary[:len(fm.passthrough)]
        binned = [f"{c}_bin" for c in many]
        cut = [QuantileDiscretizer(numBucketsArray=[bins] * len(many), inputCols=many, outputCols=binned,
                                   relativeError=0.001)] if many else []
        return cut + [VectorAssembler(inputCols=binned + binary[len(fm.passthrough):], outputCol=out)]
    if not scale:
        return [VectorAssembler(inputCols=num + binary, outputCol=out)]
    return [VectorAssembler(inputCols=num, outputCol="_num"),
            PopulationStandardScaler(inputCol="_num", outputCol="_num_s"),
            VectorAssembler(inputCols=["_num_s"] + binary, outputCol=out)]


def class_weight_column(df: DataFrame, label_col: str = "y", out: str = "w") -> DataFrame:
    """M2: 'balanced' weights n / (k * n_c) from a per-class count; a null label is an error."""
    df = labelled(df, label_col)
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy(F.lit(0))
    wt = counts.select(label_col, (F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc")))
                       .alias(out))
    return df.join(F.broadcast(wt), on=label_col, how="inner")      # one row per class


def logistic(C: float, weight_sum: float, weighted: bool = False, max_iter: int = 2000,
             tol: float = 1e-6) -> LogisticRegression:
    """M1: L2 logistic regression with sklearn's C."""
    lr = LogisticRegression(featuresCol=FEATURES, labelCol="label", regParam=1.0 / (C * weight_sum),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol)
    if weighted:
        lr.setWeightCol("w")
    return lr


def linear_svm(C: float, weight_sum: float, weighted: bool = False, max_iter: int = 100,
               tol: float = 1e-6) -> LinearSVC:
    """M3: hinge loss, L2, sklearn's C."""
    svc = LinearSVC(featuresCol=FEATURES, labelCol="label", regParam=1.0 / (C * weight_sum),
                    standardization=False, maxIter=max_iter, tol=tol)
    if weighted:
        svc.setWeightCol("w")
    return svc


def random_forest(max_depth: int | None = None, min_leaf: int = 1, n_trees: int = 300,
                  weighted: bool = False, seed: int = 42) -> RandomForestClassifier:
    """M6: bootstrap forest, sqrt features per split; depth None -> MLlib cap.  Rows carry the
    node they are in, in every tree: the trees are the same, but a job over the next nodes
    neither takes all trees along nor walks every row down from their roots."""
    depth = MAX_DEPTH_CAP if max_depth is None else min(max_depth, MAX_DEPTH_CAP)
    rf = RandomForestClassifier(featuresCol=FEATURES, labelCol="label", numTrees=n_trees,
                                maxDepth=depth, minInstancesPerNode=min_leaf,
                                featureSubsetStrategy="sqrt", seed=seed, bootstrap=True, cacheNodeIds=True)
    if weighted:
        rf.setWeightCol("w")
    return rf


def with_label(df: DataFrame, label_col: str = "y") -> DataFrame:
    return df.withColumn("label", F.col(label_col).cast("double"))


def positive_score(model_kind: str):
    """Positive-class probability, or the SVM margin (calibrated by M7)."""
    if model_kind == "svm":
        return vector_to_array("rawPrediction")[1]
    return vector_to_array("probability")[1]


@dataclass
class Family:
    """A model family: estimator factory, scaling, score kind and grid."""
    name: str
    make: Callable[..., object]        # (params: dict, weight_sum: float, weighted: bool) -> Estimator
    scale: bool
    kind: str                           # "prob" or "svm"
    grid: Sequence[dict]
    extra: Callable[[dict], list] | None = None   # params -> stages before the estimator
    bins: int = 0                       # quantile bins of the columns that trees split


def lr_family(grid_C=(0.01, 0.1, 1.0, 10.0)) -> Family:
    return Family("LR", lambda p, n, w: logistic(p["C"], n, w), True, "prob",
                  [{"C": c} for c in grid_C])


def svm_lin_family(grid_C=(0.1, 1.0)) -> Family:
    return Family("SVM-Lin", lambda p, n, w: linear_svm(p["C"], n, w), True, "svm",
                  [{"C": c} for c in grid_C])


FOREST_BINS = 32


def rf_family(depths=(None, 10, 20), leaves=(1, 5), n_trees: int = 300) -> Family:
    grid = [{"max_depth": d, "min_leaf": m} for d, m in itertools.product(depths, leaves)]
    return Family("RF", lambda p, n, w: random_forest(p["max_depth"], p["min_leaf"], n_trees, w),
                  False, "prob", grid, bins=FOREST_BINS)


def lr_kernel_family(gammas=(0.01, 0.05, 0.1), grid_C=(0.1, 1.0, 10.0), n_components: int = 300,
                     id_col: str = "k") -> Family:
    """M5: Nystroem RBF map + logistic regression."""
    from riskmap.operators.kernel import NystroemRBF
    grid = [{"gamma": g, "C": c} for g, c in itertools.product(gammas, grid_C)]
    return Family("LR-Kernel",
                  lambda p, n, w: logistic(p["C"], n, w).setFeaturesCol("kfeatures"),
                  True, "prob", grid,
                  extra=lambda p: [NystroemRBF(p["gamma"], n_components, FEATURES, "kfeatures", id_col)])


def svm_rbf_family(gammas=("scale",), grid_C=(1.0, 5.0), n_components: int = 300,
                   id_col: str = "k") -> Family:
    """M4 re-aimed: Nystroem RBF map + linear SVM ("SVM-RBF (Nystroem)").
    gamma 'scale' = 1 / (d * Var(X)) of the standardized training matrix."""
    from riskmap.operators.kernel import NystroemRBF
    grid = [{"gamma": g, "C": c} for g, c in itertools.product(gammas, grid_C)]
    return Family("SVM-RBF",
                  lambda p, n, w: linear_svm(p["C"], n, w).setFeaturesCol("kfeatures"),
                  True, "svm", grid,
                  extra=lambda p: [NystroemRBF(0.0 if p["gamma"] == "scale" else p["gamma"],
                                               n_components, FEATURES, "kfeatures", id_col)])


def _score(model: PipelineModel, df: DataFrame, kind: str, keep: Sequence[str]) -> DataFrame:
    return model.transform(df).select(*keep, positive_score(kind).alias("p"))


def prepare_features(fm: FeatureModel, family: Family, params: dict, train: DataFrame,
                     extra_stages: Sequence = ()) -> PipelineModel:
    """Every stage before the estimator, fitted on ``train``.  It depends on the
    parameters only through ``family.extra`` (the kernel width), not on C."""
    extra = list(extra_stages) + (family.extra(params) if family.extra else [])
    return Pipeline(stages=feature_stages(fm, family.scale, bins=family.bins) + extra).fit(train)


def solver_input(df: DataFrame, keep: Sequence[str], features: str, rows: float) -> DataFrame:
    """Narrow cached vectors in about ``ROWS_PER_TASK`` rows per partition: each solver
    iteration is one job over them.  The shuffle comes after feature preparation, so
    that one keeps the parallelism of its input."""
    keep = [c for c in dict.fromkeys(keep) if c in df.columns]
    return (df.select(*keep, features)
            .repartition(max(1, math.ceil(rows / ROWS_PER_TASK)), *keep[:1]).persist())


def fit_pipeline(fm: FeatureModel, family: Family, params: dict, train: DataFrame,
                 weighted: bool = False, weight_sum: float | None = None,
                 extra_stages: Sequence = (), id_col: str = "k") -> PipelineModel:
    """Fit feature stages, then the solver on narrow cached vectors."""
    n = weight_sum if weight_sum is not None else float(train.count())
    prep = prepare_features(fm, family, params, train, extra_stages)
    est = family.make(params, n, weighted)
    feats = solver_input(prep.transform(train), [id_col, "label", "w"], est.getFeaturesCol(), n)
    try:
        model = est.fit(feats)
    finally:
        feats.unpersist()
    return PipelineModel(prep.stages + [model])


def fit_and_score(fm: FeatureModel, family: Family, params: dict, train: DataFrame,
                  score: DataFrame, keep: Sequence[str], weighted: bool = False,
                  weight_sum: float | None = None, extra_stages: Sequence = ()):
    """Fit on ``train`` and return (model, scores of ``score``)."""
    model = fit_pipeline(fm, family, params, train, weighted, weight_sum, extra_stages)
    return model, _score(model, score, family.kind, keep)


def materialize(df: DataFrame) -> DataFrame:
    """Write a (small) score table to the shared checkpoint folder and cut its
    lineage: later metrics then plan over a file scan, not over every model's
    transform again."""
    from riskmap.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_at_once(spark) -> int:
    """Concurrent fits: one per core of the cluster, between 2 and ``MAX_FITS``.  The jobs of
    a fit are short; with one fit at a time most cores would wait for its driver."""
    return max(2, min(MAX_FITS, spark.sparkContext.defaultParallelism))


@dataclass
class Point:
    """One fit: its id in the result, hyper-parameters, and whether rows are weighted."""
    id: str
    params: dict
    weighted: bool = False


@dataclass
class Work:
    """Fits that share their prepared features: a training part, the rows to score, and the
    points.  ``train`` needs label (and w, where a point is weighted); ``n`` is its row
    count."""
    family: Family
    points: Sequence[Point]
    train: DataFrame
    score: DataFrame
    n: float
    keep: Sequence[str]
    extra_stages: Sequence = ()


@dataclass
class _Prepared:
    work: Work
    at: int
    features: DataFrame
    rows: DataFrame
    models: dict = field(default_factory=dict)
    left: int = 0


def run_fits(fm: FeatureModel, works: Sequence[Work], id_col: str = "k", parallelism: int | None = None) -> list[DataFrame]:
    """(point, keep..., p) for every ``Work``, in order: the scores of all its points.

    One pool of driver threads serves the preparations and the fits of all works, so no
    family, fold or value of C waits for another to end.  At most as many works as
    threads hold cached features at a time.  Every thread submits its jobs to a scheduler
    pool of its own: under FAIR scheduling fits share the cores.  Scores go to one
    checkpointed table per work.
    """
    if not works:
        return []
    spark = works[0].train.sparkSession
    threads = parallelism or fits_at_once(spark)
    pool, live, lock = ThreadPoolExecutor(max_workers=threads), threading.Semaphore(threads), threading.Lock()
    done: list[DataFrame | None] = [None] * len(works)
    waiting: list = []

    def here(fn, *args):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", threading.current_thread().name)
        return fn(*args)

    def prepare(at: int):
        work = works[at]
        try:
            prep = prepare_features(fm, work.family, work.points[0].params, work.train, work.extra_stages)
            column = work.family.make(work.points[0].params, work.n, False).getFeaturesCol()
            p = _Prepared(work, at, solver_input(prep.transform(work.train), [id_col, "label", "w"], column, work.n),
                          prep.transform(work.score).select(*work.keep, column), left=len(work.points))
        except BaseException:
            live.release()
            raise
        with lock:
            waiting.extend(pool.submit(here, fit, p, point) for point in work.points)

    def fit(p: _Prepared, point: Point):
        try:
            p.models[point.id] = p.work.family.make(point.params, p.work.n, point.weighted).fit(p.features)
        finally:
            with lock:
                p.left -= 1
                last = p.left == 0
            if last:
                finish(p)

    def finish(p: _Prepared):
        try:
            if len(p.models) == len(p.work.points):
                out, names = p.rows, p.rows.columns
                for i, point in enumerate(p.work.points):
                    out = p.models[point.id].transform(out).withColumn(f"p{i}", positive_score(p.work.family.kind)).select(
                        *names, *[f"p{j}" for j in range(i + 1)])
                each = F.explode(F.array(*[F.struct(F.lit(x.id).alias("point"), F.col(f"p{i}").alias("p"))
                                           for i, x in enumerate(p.work.points)]))
                done[p.at] = materialize(out.withColumn("s", each).select("s.point", *p.work.keep, "s.p"))
        finally:
            p.features.unpersist()
            live.release()

    with pool:
        first = []
        for at in range(len(works)):
            live.acquire()
            first.append(pool.submit(here, prepare, at))
        for f in first:
            f.result()
        for f in waiting:
            f.result()
    return done


def fold_sizes(data: DataFrame, fold_col: str = "fold") -> dict[int, int]:
    return {r[0]: r[1] for r in data.groupBy(fold_col).count().collect()}   # k rows


def fold_works(family: Family, points: Sequence[Point], data: DataFrame, sizes: dict[int, int], id_col: str,
               label_col: str, fold_col: str, extra_stages: Sequence = ()) -> list[Work]:
    """Every fold's ``Work`` for each kernel width among the points; a weighted fold gets the
    balanced weights of its own training part."""
    total = sum(sizes.values())
    shared: dict[str, list[Point]] = {}
    for point in points:
        shared.setdefault(str(point.params.get("gamma")) if family.extra else "", []).append(point)
    works = []
    for group in shared.values():
        for fold in sorted(sizes):
            train = data.where(F.col(fold_col) != fold)
            if any(x.weighted for x in group):
                train = class_weight_column(train, label_col)
            works.append(Work(family, group, train, data.where(F.col(fold_col) == fold), float(total - sizes[fold]),
                              [id_col, label_col, fold_col], extra_stages))
    return works


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_validated_scores(fm: FeatureModel, family: Family, grid: Sequence[dict], data: DataFrame,
                           id_col: str = "k", label_col: str = "y", fold_col: str = "fold",
                           weighted: bool = False, parallelism: int | None = None,
                           extra_stages: Sequence = ()) -> DataFrame:
    """(grid_id, fold, id, y, p): every row scored by models fitted without its fold."""
    data = with_label(data, label_col).persist()
    points = [Point(str(i), params, weighted) for i, params in enumerate(grid)]
    works = fold_works(family, points, data, fold_sizes(data, fold_col), id_col, label_col, fold_col, extra_stages)
    parts = run_fits(fm, works, id_col, parallelism)
    data.unpersist()
    return _union(parts).select(F.col("point").cast("int").alias("grid_id"), fold_col, id_col, label_col, "p")


def search_all(fm: FeatureModel, families: Sequence[Family], data: DataFrame, id_col: str = "k",
               label_col: str = "y", fold_col: str = "fold", parallelism: int | None = None) -> dict[str, tuple]:
    """M8 for several families at once: name -> (table, best params, out-of-fold scores of the
    best point).  All fits share one pool, and the AP of every (family, grid point, fold)
    comes from one job.  Ties go to the first grid point."""
    data = with_label(data, label_col).persist()
    sizes, works, owner = fold_sizes(data, fold_col), [], []
    for f in families:
        mine = fold_works(f, [Point(str(i), params) for i, params in enumerate(f.grid)], data, sizes, id_col, label_col, fold_col)
        works += mine
        owner += [f.name] * len(mine)
    # the heavy widths first: the pool ends with short fits
    order = sorted(range(len(works)), key=lambda i: works[i].family.extra is None)
    parts = run_fits(fm, [works[i] for i in order], id_col, parallelism)
    data.unpersist()
    scores: dict[str, list[DataFrame]] = {}
    for i, part in zip(order, parts):
        scores.setdefault(owner[i], []).append(part)
    every = _union([_union(v).withColumn("family", F.lit(k)) for k, v in scores.items()])
    summ = curve_summary(every.withColumn("grid_id", F.col("point").cast("int")), ["family", "grid_id", fold_col], "p", label_col, floors=())
    rows = summ.groupBy("family", "grid_id").agg(F.avg("pr_auc").alias("mean_ap")).collect()      # grid points
    out = {}
    for f in families:
        mine = sorted((r for r in rows if r["family"] == f.name), key=lambda r: r["grid_id"])
        best = max(mine, key=lambda r: (r["mean_ap"] if r["mean_ap"] is not None else -1.0, -r["grid_id"]))["grid_id"]
        table = data.sparkSession.createDataFrame(
            [(r["grid_id"], str(f.grid[r["grid_id"]]), float(r["mean_ap"]) if r["mean_ap"] is not None else None,
              r["grid_id"] == best) for r in mine], "grid_id int, params string, mean_ap double, best boolean")
        oof = _union(scores[f.name]).where(F.col("point") == str(best)).select(id_col, fold_col, label_col, "p")
        out[f.name] = (table, f.grid[best], oof)
    return out


def grid_search(fm: FeatureModel, family: Family, data: DataFrame, id_col: str = "k",
                label_col: str = "y", fold_col: str = "fold", parallelism: int | None = None,
                return_oof: bool = False):
    """M8: mean cross-validated average precision per grid point; best refit params.  With
    ``return_oof`` also the best point's validation scores, which are its out-of-fold
    scores (S3) on the same folds."""
    table, best, oof = search_all(fm, [family], data, id_col, label_col, fold_col, parallelism)[family.name]
    return (table, best, oof) if return_oof else (table, best)


def oof_scores(fm: FeatureModel, family: Family, params: dict, data: DataFrame,
               id_col: str = "k", label_col: str = "y", fold_col: str = "fold",
               weighted: bool = False, parallelism: int | None = None, extra_stages: Sequence = ()) -> DataFrame:
    """S3: every training row scored by the model fitted without its fold.
    Output (id, fold, y, p); each row appears exactly once."""
    return cross_validated_scores(fm, family, [params], data, id_col, label_col, fold_col, weighted,
                                  parallelism, extra_stages).select(id_col, fold_col, label_col, "p")


def platt_fit(margins: DataFrame, score_col: str = "p", label_col: str = "y") -> tuple[float, float]:
    """M7: sigmoid p = 1 / (1 + exp(-(a * margin + b))) fitted to out-of-fold margins.

    Targets are smoothed, (N+ + 1) / (N+ + 2) for a positive row and 1 / (N- + 2) for a
    negative one, so the optimum is finite also where the margins separate the
    classes.  A soft target t is two weighted rows: label 1 with weight t and label 0
    with weight 1 - t; equal margins are summed first.
    """
    m = margins.select(F.col(label_col).cast("double").alias("y"), F.col(score_col).cast("double").alias("_m"))
    n_pos, n_neg = m.agg(F.count(F.when(F.col("y") == 1, 1)), F.count(F.when(F.col("y") == 0, 1))).first()
    t = F.when(F.col("y") == 1, F.lit((n_pos + 1) / (n_pos + 2))).otherwise(F.lit(1 / (n_neg + 2)))
    soft = m.select("_m", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), t.alias("w")),
                                            F.struct(F.lit(0.0).alias("label"), (1 - t).alias("w")))).alias("s"))
    d = soft.groupBy("_m", "s.label").agg(F.sum("s.w").alias("w"))
    d = VectorAssembler(inputCols=["_m"], outputCol=FEATURES).transform(d)
    fit = LogisticRegression(featuresCol=FEATURES, labelCol="label", weightCol="w", regParam=0.0,
                             standardization=True, maxIter=200, tol=1e-10).fit(d)
    return float(fit.coefficients[0]), float(fit.intercept)


def platt_apply(df: DataFrame, a: float, b: float, score_col: str = "p") -> DataFrame:
    z = F.lit(a) * F.col(score_col) + F.lit(b)
    return df.withColumn(score_col, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def coefficient_table(model: PipelineModel, fm: FeatureModel, top: int = 20) -> DataFrame:
    """(feature, coef, abs) for the linear model, top by |coef|.
    The vector layout is scaled numeric block then binary block, i.e. fm.columns."""
    est = model.stages[-1]
    coefs = est.coefficients.toArray().tolist()
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    df = s.createDataFrame([(n, float(c), abs(float(c))) for n, c in zip(fm.columns, coefs)],
                           "feature string, coef double, abs double")
    return df.orderBy(F.desc("abs"), "feature").limit(top)


def importance_table(model: PipelineModel, fm: FeatureModel, top: int = 20) -> DataFrame:
    """Impurity importances (sum to 1), top by importance."""
    est = model.stages[-1]
    imp = est.featureImportances.toArray().tolist()
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    df = s.createDataFrame([(n, float(v)) for n, v in zip(fm.columns, imp)],
                           "feature string, importance double")
    return df.orderBy(F.desc("importance"), "feature").limit(top)
