"""Sparse matrix of wide nominal columns, pairwise moments, checked CSV scan, saved kernel
models, smoothed calibration, one-scan labels, native argmin and the fit pool."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskmap.operators import features as E
from riskmap.operators import kernel as KR
from riskmap.operators import models as M
from riskmap.operators import moments as Q
from riskmap.operators import segment as K
from riskmap.operators import wide as W
from riskmap.sources.tables import CORRUPT, corrupt_rows, load_raw, sound_rows
from riskmap.spec import RoleSpec

SPEC = RoleSpec(outcome="y", ids=("k",), ordinal=("a",), passthrough=("n",), nominal=("c", "d"))


def _rows(spark, n=300):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 2)), None if i % 7 == 0 else float(rng.normal()), int(rng.integers(0, 4)),
             None if i % 11 == 0 else f"c{int(rng.integers(0, 9))}", float(rng.integers(0, 3))) for i in range(n)]
    return spark.createDataFrame(rows, "k long, y int, a double, n int, c string, d double").repartition(3)


def _matrix(df, key="k", col="features"):
    return {r[key]: r[col].toArray() for r in df.select(key, col).collect()}


@pytest.mark.parametrize("hot", [4096, 1])
def test_sparse_matrix_equals_the_dense_one(spark, monkeypatch, hot):
    """Also where no level is broadcast (``hot`` = 1: all but a constant column)."""
    monkeypatch.setattr(W, "HOT_LEVELS", hot)
    df = _rows(spark)
    dense, sparse = E.fit_feature_model(df, SPEC), W.fit_sparse_features(df, SPEC)
    assert sparse.width == len(dense.columns)
    names = [r["column"] for r in sparse.column_names().orderBy("position").collect()]
    assert names == dense.columns
    expect = {r["k"]: [float(r[c]) for c in dense.columns] for r in dense.transform(df).collect()}
    got = _matrix(sparse.transform(df))
    assert set(got) == set(expect) and all(np.allclose(got[k], expect[k]) for k in expect)
    long = {(r["k"], r["position"]): r["value"] for r in sparse.to_long(df).collect()}
    assert all(long.get((k, j), 0.0) == pytest.approx(v) for k, x in expect.items() for j, v in enumerate(x))


def test_sparse_matrix_of_unseen_levels_and_scales(spark):
    df = _rows(spark)
    model = W.fit_sparse_features(df, SPEC, fit_rows=df.where("k % 2 = 0")).scaled(df.where("k % 2 = 0"))
    new = spark.createDataFrame([(1, 0, None, 2, "never seen", None)], df.schema)
    x = _matrix(model.transform(new))[1]
    at = model.offsets()
    assert x[at["c"]:at["d"]].sum() == 0 and x[1] == 2.0
    even = np.array([x[0] for x in _matrix(model.transform(df.where("k % 2 = 0"))).values()])
    assert abs(even.mean()) < 1e-9 and even.std() == pytest.approx(1.0)
    none = W.fit_sparse_features(df, RoleSpec(outcome="y", ids=("k",), ordinal=("a",)))
    assert none.width == 1 and none.transform(df).count() == 300


def test_many_levels_train_sparse_and_are_refused_dense(spark):
    n = 30_000
    df = spark.range(0, n, 1, 4).select(
        F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("y"), F.lit(1.0).alias("a"), F.lit(0).alias("n"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("level "), F.col("id").cast("string"))).alias("c"),
        (F.col("id") % 5).cast("double").alias("d"))
    with pytest.raises(ValueError, match="fit_sparse_features"):
        E.fit_feature_model(df, SPEC)
    model = W.fit_sparse_features(df, SPEC)
    assert model.sizes["c"] == n - n // 3 + 1 and model.width == 2 + model.sizes["c"] + 5
    vectors = model.transform(df)
    first = vectors.first()["features"]
    assert first.size == model.width and len(first.indices) == 4
    fit = M.logistic(10.0, float(n), max_iter=20).fit(vectors.withColumn("label", F.col("y").cast("double")))
    right = fit.transform(vectors).where(F.col("prediction") == F.col("y")).count()
    assert right > 0.9 * (n - n // 3)


def test_correlation_and_covariance_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5)) + 1e6
    x[:, 4] = 7.0
    holes = rng.random(x.shape) < 0.1
    rows = [(i, *[None if holes[i, j] else float(x[i, j]) for j in range(5)]) for i in range(500)]
    names = [f"a.{j}" for j in range(5)]
    df = spark.createDataFrame(rows, ["id", *names]).repartition(7)
    got = {(r["a"], r["b"]): r["r"] for r in Q.correlation_table(df, names).collect()}
    assert len(got) == 25
    for i in range(5):
        for j in range(5):
            both = ~holes[:, i] & ~holes[:, j]
            if i == j:
                assert got[names[i], names[j]] == 1.0
            elif 4 in (i, j):
                assert got[names[i], names[j]] is None
            else:
                assert got[names[i], names[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    cov = {(r["a"], r["b"]): r["cov"] for r in Q.covariance_table(df, Q.column_array(names), names).collect()}
    both = ~holes[:, 0] & ~holes[:, 1]
    assert cov[names[0], names[1]] == pytest.approx(np.cov(x[both, 0], x[both, 1], bias=True)[0, 1], rel=1e-6)
    assert Q.correlation_table(df, []).count() == 0
    assert Q.correlation_table(df.limit(0), names[:2]).count() == 0


def test_correlation_plan_does_not_grow_with_pairs(spark):
    df = spark.range(10).select(*[(F.col("id") * j).cast("double").alias(f"c{j}") for j in range(1, 41)])
    plan = Q.correlation_table(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("corr(") == 0 and len(plan) < 40_000


def test_csv_scan_types_by_name_and_keeps_corrupt_rows(spark):
    base = tempfile.mkdtemp(prefix="riskmap-csv-", dir="/tmp")
    with open(os.path.join(base, "t.csv"), "w") as f:
        f.write("name,k,score,flag,extra\nann,1,0.5,true,x\n\"b,ob\",2,,false,\n,3,1.5,,y\ncy,four,2.5,true,z\ndi,5,1.0\n")
    dictionary = [("k", "int"), ("score", "float"), ("name", "string"), ("flag", "bool"), ("absent", "int")]
    raw = load_raw(spark, base, dictionary).persist()
    assert dict(raw.dtypes) == {"name": "string", "k": "bigint", "score": "double", "flag": "boolean", "extra": "string", CORRUPT: "string"}
    good = {r["k"]: r for r in sound_rows(raw).collect()}
    assert set(good) == {1, 2, 3} and good[2]["name"] == "b,ob" and good[2]["score"] is None and good[3]["name"] is None
    bad = sorted(r[CORRUPT] for r in corrupt_rows(raw).collect())
    assert bad == ["cy,four,2.5,true,z", "di,5,1.0"]
    with pytest.raises(ValueError, match="type classes"):
        load_raw(spark, base, [("k", "date")])
    other = raw.schema.__class__([raw.schema["k"], raw.schema["name"]])
    with pytest.raises(Exception):      # a schema that contradicts the header is refused
        load_raw(spark, base, schema=other).collect()


def test_kernel_model_saves_and_loads(spark):
    rng = np.random.default_rng(6)
    rows = [(i, Vectors.dense(x), float(x[0] * x[1] > 0)) for i, x in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, ["k", "features", "label"])
    model = PipelineModel([KR.NystroemRBF(0.5, 20).fit(df)])
    base = tempfile.mkdtemp(prefix="riskmap-kernel-", dir="/tmp")
    model.write().save(os.path.join(base, "m"))
    again = PipelineModel.load(os.path.join(base, "m"))
    a, b = (_matrix(m.transform(df), col="kfeatures") for m in (model, again))
    assert all(np.array_equal(a[k], b[k]) for k in a)
    assert again.stages[0].gamma_value == 0.5 and again.stages[0].uid == model.stages[0].uid
    KR.NystroemRBF(0.5, 20).write().save(os.path.join(base, "e"))
    assert KR.NystroemRBF.load(os.path.join(base, "e")).getOrDefault("nComponents") == 20
    # the loaded model scores a stream as a batch
    df.select("k", vector_to_array("features").alias("x")).write.parquet(os.path.join(base, "in"))
    stream = spark.readStream.schema("k long, x array<double>").parquet(os.path.join(base, "in"))
    q = (again.transform(stream.withColumn("features", array_to_vector("x"))).select("k", "kfeatures")
         .writeStream.format("memory").queryName("kernel_scores").trigger(availableNow=True).start())
    q.awaitTermination(120)
    s = _matrix(spark.table("kernel_scores"), col="kfeatures")
    assert all(np.array_equal(a[k], s[k]) for k in a)


def _sigmoid_optimum(m, y):
    """Newton's method on the smoothed-target likelihood."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([m, np.ones_like(m)], axis=1), np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-12 * np.eye(2), x.T @ (p - t))
        beta = beta - step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
    return beta


@pytest.mark.parametrize("noise", [1.0, 0.0])
def test_platt_equals_a_plain_optimum_also_on_separable_margins(spark, noise):
    rng = np.random.default_rng(2)
    m = np.round(rng.normal(size=200), 2)
    y = (m + noise * rng.normal(size=200) > 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(m, y)], "p double, y int").repartition(3)
    a, b = M.platt_fit(df)
    expect = _sigmoid_optimum(m, y)
    assert np.isfinite([a, b]).all() and (a, b) == pytest.approx(tuple(expect), rel=2e-3)


def test_labels_of_all_runs_in_one_scan(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, Vectors.dense(x)) for i, x in enumerate(rng.normal(size=(200, 3)))], ["id", "pca"]).repartition(4, "id")
    models = {s: M_KMEANS(df, s) for s in (1, 2, 3)}
    got = K.assign_runs(models, df, "id")
    assert got.count() == 600 and len([x for x in got._jdf.queryExecution().executedPlan().toString().split() if "MapInArrow" in x]) == 1
    for s, m in models.items():
        expect = {r["id"]: r["cluster"] for r in m.transform(df).collect()}
        assert {r["id"]: r["label"] for r in got.where(F.col("run") == s).collect()} == expect


def M_KMEANS(df, seed):
    return K.kmeans_best_of(df, 4, n_init=1, seed=seed)


def test_nearest_centroid_equals_the_fitted_model(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, Vectors.dense(x)) for i, x in enumerate(rng.normal(size=(150, 2)))], ["id", "pca"])
    m = M_KMEANS(df, 5)
    table = spark.createDataFrame([(c, [float(v) for v in x]) for c, x in enumerate(m.clusterCenters())], "cluster int, coords array<double>")
    rows = df.withColumn("x", vector_to_array("pca"))
    got = {r["id"]: r["cluster"] for r in K.nearest_centroid(rows, "x", table).collect()}
    assert got == {r["id"]: r["cluster"] for r in m.transform(df).collect()}
    tie = spark.createDataFrame([(0, [0.0]), (1, None)], "id int, x array<double>")
    two = spark.createDataFrame([(7, [1.0]), (3, [-1.0])], "cluster int, coords array<double>")
    assert {r["id"]: r["cluster"] for r in K.nearest_centroid(tie, "x", two).collect()} == {0: 3, 1: None}
    with pytest.raises(ValueError):
        K.nearest_centroid(tie, "x", two.limit(0))


def _searchable(spark):
    from riskmap.operators import split as S
    df = _rows(spark, 240).withColumn("y", (F.coalesce("a", F.lit(0.0)) > 0).cast("int"))
    fm = E.fit_feature_model(df, SPEC)
    return fm, M.materialize(S.stratified_folds(M.safe_matrix(fm, df, ["k", "y"]), "k", "y", 2, 1))


def test_families_searched_together_equal_single_searches(spark):
    fm, data = _searchable(spark)
    fams = [M.lr_family((0.001, 0.01)), M.rf_family((3,), (1, 5), n_trees=5)]
    together = M.search_all(fm, fams, data, parallelism=3)
    assert list(together) == ["LR", "RF"]
    for f in fams:
        table, best = M.grid_search(fm, f, data, parallelism=1)
        rows = {r["grid_id"]: r["mean_ap"] for r in table.collect()}
        assert {r["grid_id"]: r["mean_ap"] for r in together[f.name][0].collect()} == pytest.approx(rows, abs=1e-9)
        assert best == together[f.name][1]
        assert together[f.name][2].select("k").distinct().count() == 240


def test_a_failed_fit_ends_the_pool(spark):
    fm, data = _searchable(spark)
    bad = M.Family("bad", lambda p, n, w: M.logistic(p["C"], n, w), True, "prob", [{"C": 1.0}, {"C": 0.0}])
    with pytest.raises(Exception):
        M.search_all(fm, [bad], data, parallelism=2)


def test_forest_bins_and_weights(spark):
    fm, data = _searchable(spark)
    prep = M.prepare_features(fm, M.rf_family(), {}, M.with_label(data))
    x = np.array([r["features"].toArray() for r in prep.transform(data).collect()])
    assert x.shape[1] == len(fm.columns) and x[:, 0].max() <= M.FOREST_BINS - 1 and len(np.unique(x[:, 0])) > 20
    train = M.class_weight_column(M.with_label(data))
    work = M.Work(M.rf_family(n_trees=10), [M.Point("none", {"max_depth": 4, "min_leaf": 1}),
                                             M.Point("balanced", {"max_depth": 4, "min_leaf": 1}, True)], train, data, 240.0, ["k", "y"])
    scores, = M.run_fits(fm, [work])
    assert scores.groupBy("point").count().collect() and scores.count() == 480 and scores.where("p NOT BETWEEN 0 AND 1").count() == 0


def test_sparse_fit_sends_one_gradient_per_core(spark, sf_small, monkeypatch):
    """The solver's tasks do not grow in number with the rows: each sends all columns."""
    from riskmap.plans import wide
    seen, real = [], wide.logistic

    class Watched:
        def __init__(self, *args, **kw):
            self.made = real(*args, **kw)

        def fit(self, data):
            seen.append(data.rdd.getNumPartitions())
            return self.made.fit(data)

    monkeypatch.setattr(wide, "logistic", Watched)
    monkeypatch.setattr(wide, "_WIDE", wide.SessionCache(wide._Wide))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = wide.m01_sparse_logistic(spark, sf_small).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert seen and seen[0] <= spark.sparkContext.defaultParallelism
    assert got["n_settled"] == got["n_columns"]


def test_sparse_logistic_equals_mllib_without_wide_vectors_on_the_driver(spark, monkeypatch):
    """Coefficients of the widest column stay in a table, with common, missing and repeated keys."""
    n = 3000
    level = F.when(F.col("id") % 4 == 0, "hot").when(F.col("id") % 11 == 0, F.lit(None)).otherwise((F.col("id") * F.col("id") % 601).cast("string"))
    df = spark.range(0, n, 1, 3).select(
        (F.col("id") % 2500).alias("k"), ((F.col("id") * 7 % 13 + F.col("id") % 5) % 2).cast("int").alias("y"), F.lit(1.0).alias("a"),
        (F.col("id") % 9).cast("double").alias("n"), level.alias("c"), (F.col("id") * 3 % 7).cast("string").alias("d"))
    model = W.fit_sparse_features(df, SPEC)
    data = model.transform(df.dropDuplicates(["k"])).withColumn("label", F.col("y").cast("double")).persist()
    data = data.unionByName(data.where("k % 3 = 0")).persist()
    assert model.widest() == (model.offsets()["c"], model.sizes["c"])
    for rows in (64, 32_768):
        monkeypatch.setattr(W, "CHUNK_ROWS", rows)
        fit = W.logistic(0.5, float(data.count()), model.widest()).fit(data.repartition(3))
        assert fit.levels.count() > 100 and len(fit.rest) < 20
        plain = M.logistic(0.5, float(data.count()), tol=1e-13).fit(data)
        got = [r["beta"] for r in W.coefficient_rows(spark, fit).orderBy("position").collect()]
        assert got == pytest.approx(plain.coefficients.toArray().tolist(), abs=1e-5) and fit.intercept == pytest.approx(plain.intercept, abs=1e-5)
        p = [sorted((r["k"], round(float(r["probability"][1]), 4)) for r in m.transform(data).collect()) for m in (fit, plain)]
        assert len(p[0]) == data.count() and all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-4 for a, b in zip(*p))
    monkeypatch.setattr(W, "MAX_REST", 5)
    assert W.coefficient_rows(spark, W.logistic(0.5, float(data.count()), model.widest()).fit(data)).count() == model.width
    with pytest.raises(Exception):
        W.logistic(0.5, 10.0, model.widest()).fit(data.withColumn("label", F.when(F.col("k") > 5, F.col("label"))))
    twice = df.unionByName(df.where("k = 5"))
    with pytest.raises(Exception):            # rows of one key meet in one vector, which has places twice
        W.logistic(0.5, 10.0, model.widest()).fit(model.transform(twice).withColumn("label", F.col("y").cast("double")))
