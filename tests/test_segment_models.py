from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskmap.operators import kernel as KR
from riskmap.operators import models as M
from riskmap.operators import personas as G
from riskmap.operators import segment as K
from tests import reference_impl as R


def _blobs(spark, seed=0, n=60):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0], [6, 0], [0, 6]], float)
    X = np.vstack([c + rng.normal(0, 0.5, (n, 2)) for c in centers])
    lab = np.repeat([0, 1, 2], n)
    rows = [(int(i), Vectors.dense(x), int(l)) for i, (x, l) in enumerate(zip(X, lab))]
    return spark.createDataFrame(rows, ["id", "pca", "truth"]), X, lab


def test_silhouette_matches_brute_force(spark):
    df, X, lab = _blobs(spark)
    got = K.silhouette_exact(df, "id", "pca", "truth", 2000, 1)
    assert got == pytest.approx(R.silhouette(X, lab), abs=1e-9)


def test_singleton_cluster_scores_zero(spark):
    rows = [(0, Vectors.dense([0.0]), 0), (1, Vectors.dense([1.0]), 1), (2, Vectors.dense([1.2]), 1)]
    df = spark.createDataFrame(rows, ["id", "pca", "c"])
    assert K.silhouette_exact(df, "id", "pca", "c") == pytest.approx(R.silhouette([[0], [1], [1.2]], [0, 1, 1]))


def test_kmeans_recovers_blobs_and_ari(spark):
    df, X, lab = _blobs(spark)
    df = K.deterministic_layout(df, "id", 4)
    m = K.kmeans_best_of(df, 3, n_init=3, seed=1)
    pred = {r.id: r.cluster for r in m.transform(df).collect()}
    labels = spark.createDataFrame([(i, 0, int(l)) for i, l in enumerate(lab)] +
                                   [(i, 1, int(pred[i])) for i in range(len(lab))], "id long, run int, label int")
    a = {(r.run_a, r.run_b): r.ari for r in K.ari_pairs(labels).collect()}
    assert a[(0, 1)] == pytest.approx(1.0)
    assert a[(0, 0)] == 1.0 and a[(1, 0)] == a[(0, 1)]


def test_ari_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, 300)
    b = rng.integers(0, 3, 300)
    labels = spark.createDataFrame([(i, 0, int(x)) for i, x in enumerate(a)] +
                                   [(i, 1, int(x)) for i, x in enumerate(b)], "id long, run int, label int")
    got = {(r.run_a, r.run_b): r.ari for r in K.ari_pairs(labels).collect()}
    assert got[(0, 1)] == pytest.approx(R.ari(a, b), abs=1e-12)


def test_canonical_labels_by_size(spark):
    df, X, lab = _blobs(spark, n=30)
    extra = spark.createDataFrame([(1000 + i, Vectors.dense([6.0, 0.1 * i]), 1) for i in range(20)],
                                  ["id", "pca", "truth"])
    df = df.unionByName(extra)
    m = K.kmeans_best_of(df, 3, n_init=2, seed=2)
    mp = K.canonical_labels(m, df)
    sizes = {mp[r.cluster]: r["count"] for r in m.transform(df).groupBy("cluster").count().collect()}
    assert sizes[0] >= sizes[1] >= sizes[2]


def test_pca_variance_and_components(spark):
    rng = np.random.default_rng(5)
    Z = rng.normal(size=(200, 5)) * np.array([5, 3, 1, 0.5, 0.1])
    df = spark.createDataFrame([(Vectors.dense(z),) for z in Z], ["features"])
    std = K.standardize_all(df, "features", "std")
    model = K.full_pca(std, "std")
    ratios = K.pca_variance(model)
    assert sum(ratios) == pytest.approx(1.0)
    m = K.components_for(ratios, 0.8)
    assert np.cumsum(ratios)[m - 1] >= 0.8 and (m == 1 or np.cumsum(ratios)[m - 2] < 0.8)
    # K3: the projection is the first m columns of all components
    rows = K.pca_project(model, m).transform(std).select("std", "pca").collect()
    assert np.allclose([r.pca.toArray() for r in rows],
                       [r.std.toArray() @ model.pc.toArray()[:, :m] for r in rows])
    # K4, K5: fixed signs, the largest loadings first
    names = [f"f{i}" for i in range(5)]
    table = K.loadings_table(spark, model, m, names)
    assert table.count() == 5 * m and all(
        max((r.loading for r in table.where(F.col("pc") == f"PC{j + 1}").collect()), key=abs) > 0 for j in range(m))
    top = K.top_loadings(table, ("PC1",), 2).collect()
    assert len(top) == 2 and {abs(r.loading) for r in top} == set(
        sorted((abs(r.loading) for r in table.where("pc = 'PC1'").collect()))[-2:])


def test_nystroem_exact_when_all_rows_are_landmarks(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, Vectors.dense(x)) for i, x in enumerate(X)], ["k", "features"])
    model = KR.NystroemRBF(gamma=0.3, nComponents=300).fit(df)
    Z = np.array([r.kfeatures.toArray() for r in model.transform(df).orderBy("k").collect()])
    assert np.allclose(Z @ Z.T, KR.rbf_kernel(X, X, 0.3), atol=1e-6)


def test_logistic_gradient_optimality(spark):
    """M1: at the optimum  C * sum_i (p_i - y_i) x_i + beta = 0  (sklearn's C)."""
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 3))
    y = (X @ np.array([1.5, -1.0, 0.5]) + rng.normal(0, 1, 300) > 0).astype(int)
    df = spark.createDataFrame([(Vectors.dense(x), float(t)) for x, t in zip(X, y)], ["features", "label"])
    C = 0.5
    m = M.logistic(C, 300.0, tol=1e-12, max_iter=1000).fit(df)
    beta = m.coefficients.toArray()
    p = 1 / (1 + np.exp(-(X @ beta + m.intercept)))
    grad = C * ((p - y)[:, None] * X).sum(0) + beta
    assert np.abs(grad).max() < 1e-4
    assert abs(C * (p - y).sum()) < 1e-4                 # unpenalized intercept


def test_class_weights_sum_to_n(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)], "k long, y int")
    w = M.class_weight_column(df)
    assert w.agg(F.sum("w")).collect()[0][0] == pytest.approx(100.0)


def test_platt_is_monotone(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=200)
    y = (m + rng.normal(0, 1, 200) > 0).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(m, y)], "p double, y int")
    a, b = M.platt_fit(df)
    assert a > 0
    out = [r.p for r in M.platt_apply(df.orderBy("p"), a, b).collect()]
    assert all(x <= y2 for x, y2 in zip(out, out[1:]))


def test_naming_rules(spark):
    z = spark.createDataFrame([(0, 0.9, 0.0, 0.6, -0.9), (1, -0.8, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 0.0)],
                              "c int, rural double, nonmetro double, num_children double, vehiclenum double")
    m = spark.createDataFrame([(0, 0.7), (1, 0.1), (2, 0.2)], "c int, snap_any double")
    names = {r.c: r.narrative_name for r in G.name_clusters(z, m, "c").collect()}
    assert names[0] == "Rural with children on snap limited vehicle access"
    assert names[1] == "Urban"
    assert names[2] == "Mixed profile"


def test_crosstab_zero_cells_and_null_keys(spark):
    df = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (None, "a"), (1, None)], "p int, c string")
    x = {r.p: r for r in G.crosstab_normalized(df, "p", "c", ["a", "b"]).collect()}
    assert x[0]["a"] == 1.0 and x[0]["b"] == 0.0 and x[1]["b"] == 1.0
    assert None not in x


def test_gamma_scale(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(2.0, 3.0, size=(100, 4))
    df = spark.createDataFrame([(Vectors.dense(x),) for x in X], ["features"])
    assert KR.gamma_scale(df) == pytest.approx(1.0 / (4 * X.var()), rel=1e-9)


def test_cv_validation_scores_are_oof_scores(spark):
    """S3 identity used by the results table: the best grid point's validation
    scores equal a separate out-of-fold run on the same folds."""
    from riskmap.operators import clean as C
    from riskmap.operators import features as E
    from riskmap.operators import split as S
    from riskmap.spec import RoleSpec
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.random() < 0.3), float(rng.normal()), float(rng.normal())) for i in range(240)]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double")
    spec = RoleSpec(outcome="y", ids=("k",), ordinal=("a", "b"))
    fm = E.fit_feature_model(C.clean(df, spec), spec)
    X = S.stratified_folds(M.safe_matrix(fm, df, ["k", "y"]), "k", "y", 5, 3, hex_digits=2).persist()
    fam = M.lr_family(grid_C=(1.0,))
    _, best, oof = M.grid_search(fm, fam, X, return_oof=True, parallelism=2)
    ref = M.oof_scores(fm, fam, best, X, parallelism=2)
    a = {r.k: r.p for r in oof.collect()}
    b = {r.k: r.p for r in ref.collect()}
    assert set(a) == set(b) and len(a) == 240
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6


def test_crosstab_shares_cover_unlisted_levels(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (0, "c"), (1, "c")], "p int, c string")
    x = {r.p: r.asDict() for r in G.crosstab_normalized(df, "p", "c", ["a", "b"]).collect()}
    assert x == {0: {"p": 0, "a": 0.25, "b": 0.25}, 1: {"p": 1, "a": 0.0, "b": 0.0}}


def test_null_labels_raise(spark):
    from riskmap.operators import split as S
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i % 2) for i in range(100)], "k long, y int")
    for bad in (S.stratified_folds(df, "k", "y"), S.stratified_split(df, "k", "y"), M.class_weight_column(df)):
        with pytest.raises(Exception, match="null in label column"):
            bad.collect()


def test_medians_of_more_columns_than_one_job_takes(spark):
    from riskmap.operators import features as E
    cols = [f"c{i}" for i in range(150)]
    df = spark.createDataFrame([tuple(float(r * (i + 1)) for i in range(150)) for r in (1, 2, 5)], cols)
    assert E.medians(df, cols) == {c: 2.0 * (i + 1) for i, c in enumerate(cols)}


def test_kmeans_assignment_invariants(spark):
    """Every row sits at its nearest centre, and centres are their rows' means."""
    df, X, lab = _blobs(spark, seed=4)
    df = K.deterministic_layout(df, "id")
    assert df.rdd.getNumPartitions() == 1
    model = K.kmeans_pool(df, [(2, 3), (3, 3)], n_init=3)[1]
    rows = K.assign(model, df, K.canonical_labels(model, df), "persona").collect()
    groups = {c: np.array([r.pca.toArray() for r in rows if r.persona == c]) for c in {r.persona for r in rows}}
    centres = {c: v.mean(0) for c, v in groups.items()}
    assert len(rows) == len(X) and sorted(map(len, groups.values()), reverse=True) == [len(groups[c]) for c in range(3)]
    assert np.allclose(sorted(map(tuple, centres.values())), sorted(map(tuple, model.clusterCenters())), atol=1e-2)
    for r in rows:
        assert r.persona == min(centres, key=lambda c: ((r.pca.toArray() - centres[c]) ** 2).sum())


def test_sweep_reports_both_silhouettes(spark):
    df, X, lab = _blobs(spark, seed=6)
    df = K.deterministic_layout(df, "id")
    table, models = K.kmeans_sweep(df, "id", (2, 3, 4), n_init=3, parallelism=2)
    rows = {r.k: r for r in table.collect()}
    assert set(models) == {2, 3, 4} and rows[2].inertia > rows[3].inertia > rows[4].inertia
    assert K.best_k(table).first().k == K.best_k(table, metric="silhouette_full").first().k == 3
    assert K.best_k(table, cap=2).first().k == 2
    labels = K.stability_labels(df, "id", 3, (5, 6), n_init=2)
    assert K.mean_offdiag(K.ari_pairs(labels)).first()[0] == pytest.approx(1.0)


def test_sweep_silhouette_covers_all_rows(spark, monkeypatch):
    """Every row counts, however few a sample would have, in several groups and tiles."""
    rng = np.random.default_rng(8)
    X = np.vstack([rng.normal(c, 1.5, (230, 3)) for c in (0.0, 4.0)] + [rng.normal(9.0, 0.1, (1, 3))] + [np.zeros((9, 3))])
    df = K.deterministic_layout(spark.createDataFrame([(i % 400, Vectors.dense(x)) for i, x in enumerate(X)], ["id", "pca"]), "id", 3)
    monkeypatch.setattr(K, "SILHOUETTE_SAMPLE", 40)
    for rows, tile in ((65_536, 1024), (70, 32)):
        monkeypatch.setattr(K, "PAIR_ROWS", rows)
        monkeypatch.setattr(K, "PAIR_TILE", tile)
        table, models = K.kmeans_sweep(df, "id", (2, 3, 5), n_init=1, parallelism=2)
        for r in table.collect():
            lab = models[r.k].transform(df).select("pca", "cluster").collect()
            assert r.silhouette == pytest.approx(R.silhouette(np.array([v.pca.toArray() for v in lab]), [v.cluster for v in lab]), abs=1e-6)
    one = SimpleNamespace(clusterCenters=lambda: [np.zeros(3)])
    assert K.silhouettes_all(df, [one, models[2]]) == [0.0, pytest.approx(table.where("k = 2").first().silhouette, abs=1e-12)]


def _imbalanced(spark, n=400):
    from riskmap.operators import features as E
    from riskmap.operators import split as S
    from riskmap.spec import RoleSpec
    rng = np.random.default_rng(21)
    y = (rng.random(n) < 0.2).astype(int)
    rows = [(i, int(t), float(rng.normal(1.2 * t)), float(rng.normal())) for i, t in enumerate(y)]
    df = spark.createDataFrame(rows, "k long, y int, a double, b double")
    spec = RoleSpec(outcome="y", ids=("k",), ordinal=("a", "b"))
    fm = E.fit_feature_model(df, spec)
    return fm, S.stratified_folds(M.safe_matrix(fm, df, ["k", "y"]), "k", "y", 5, 3, hex_digits=2).persist(), y.mean()


def test_each_svm_strategy_has_its_own_sigmoid(spark):
    """M3, M7: balanced weights move the margins; calibrated by their own out-of-fold
    margins both strategies predict the positive rate on average."""
    fm, data, rate = _imbalanced(spark)
    margins = {w: M.oof_scores(fm, M.svm_lin_family(), {"C": 1.0}, data, weighted=w, parallelism=2).persist()
               for w in (False, True)}
    sigmoids = {w: M.platt_fit(d) for w, d in margins.items()}
    mean = {(w, s): M.platt_apply(margins[w], *sigmoids[s]).agg(F.avg("p")).first()[0] for w in margins for s in margins}
    assert mean[False, False] == pytest.approx(rate, abs=0.01) and mean[True, True] == pytest.approx(rate, abs=0.01)
    assert mean[True, False] > rate + 0.05


def test_search_best_is_the_argmax_and_balanced_weights_raise_scores(spark):
    """Fold coverage, the flagged row, scores in [0, 1]."""
    fm, data, rate = _imbalanced(spark)
    table, best, oof = M.grid_search(fm, M.lr_family((0.01, 1.0)), data, return_oof=True, parallelism=2)
    rows = table.collect()
    top = max(rows, key=lambda r: (r.mean_ap, -r.grid_id))
    assert [r.best for r in rows] == [r is top for r in rows] and str(best) == top.params
    scores = oof.collect()
    assert len({r.k for r in scores}) == len(scores) == 400 and all(0 <= r.p <= 1 for r in scores)
    plain, balanced = (M.oof_scores(fm, M.lr_family(), best, data, weighted=w, parallelism=2).agg(F.avg("p")).first()[0]
                       for w in (False, True))
    assert plain == pytest.approx(rate, abs=0.02) and balanced > plain + 0.1


def test_forest_importances_and_coefficients(spark):
    """M6, M11, M12."""
    fm, data, _ = _imbalanced(spark)
    train = M.with_label(data)
    forest = M.fit_pipeline(fm, M.rf_family(n_trees=20), {"max_depth": 4, "min_leaf": 1}, train)
    imp = {r.feature: r.importance for r in M.importance_table(forest, fm).collect()}
    assert sum(imp.values()) == pytest.approx(1.0) and imp["a"] > imp["b"]
    coef = M.coefficient_table(M.fit_pipeline(fm, M.lr_family(), {"C": 1.0}, train), fm).collect()
    assert [r.feature for r in coef][0] == "a" and coef[0].coef > 0 and coef[0].abs >= coef[1].abs


def test_forest_rows_carry_their_nodes(spark):
    """Deep trees do not travel with every job; they are those of MLlib's other way."""
    from pyspark.ml.linalg import Vectors
    from riskmap.operators import models as M
    rows = [(float((i * 7 % 13 + i % 5) % 2), Vectors.dense(float(i % 7), float(i * 31 % 17), float(i % 3))) for i in range(200)]
    df = spark.createDataFrame(rows, ["label", "features"]).coalesce(1)
    made = M.random_forest(None, 1, n_trees=5)
    assert made.getCacheNodeIds()
    model, other = made.fit(df), M.random_forest(None, 1, n_trees=5).setCacheNodeIds(False).fit(df)
    assert model.toDebugString.split("\n", 1)[1] == other.toDebugString.split("\n", 1)[1]


def test_restarts_followed_together_end_as_mllib_fits(spark):
    from pyspark.ml.clustering import KMeans

    df, X, lab = _blobs(spark, n=40)
    df = K.deterministic_layout(df, "id", 3)
    make = lambda k, seed, n: KMeans(k=k, seed=seed, featuresCol="pca", maxIter=n, tol=1e-3, predictionCol="cluster").fit(df)
    runs = [(2, 1), (3, 2), (4, 3), (5, 4)]
    starts = [np.array(make(k, s, 0).clusterCenters()) for k, s in runs]
    got = K.restart_costs(df, starts, [1e-3] * len(runs))
    assert got == pytest.approx([make(k, s, 100).summary.trainingCost for k, s in runs], rel=1e-9)
    best = K.kmeans_pool(df, [(4, 1)], n_init=6)[0]
    tol = K.kmeans_tolerance(df, 4)
    single = [KMeans(k=4, seed=1 + 7919 * i, featuresCol="pca", maxIter=300, tol=tol).fit(df).summary.trainingCost for i in range(6)]
    assert best.summary.trainingCost == pytest.approx(min(single), rel=1e-9)


def test_kernel_rows_work_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    rows, marks = np.empty(1500, dtype=object), rng.normal(size=(7, 4))
    rows[:] = list(rng.normal(size=(1500, 4)))
    norm, plain, seen = KR.nystroem_normalization(marks, 0.1), KR.rbf_kernel, []

    def kernel(a, b, gamma):
        seen.append(len(a))
        return plain(a, b, gamma)

    monkeypatch.setattr(KR, "rbf_kernel", kernel)
    got = KR.kernel_rows(rows, marks, norm, 0.1)
    assert max(seen) <= KR.BLOCK_ROWS and len(got) == len(rows)
    assert np.allclose(got, plain(np.stack(rows), marks, 0.1) @ norm.T)


def test_prediction_and_segmentation_share_one_matrix(spark, sf_small):
    from riskmap.plans.prediction import matrix, prepared
    from riskmap.plans.segmentation import seg

    assert seg(spark, sf_small).all is matrix(spark, sf_small).all
    assert prepared(spark, sf_small).fm is seg(spark, sf_small).fm


def test_customer_rows_dealt_over_tasks(spark, sf_small, monkeypatch):
    """Beyond one task's lines, customers, orders and lines meet in as many tasks as their
    number asks for, with the same rows."""
    from riskmap.sources import fixtures as fx

    plain = sorted(fx.cust_features(spark, sf_small).collect(), key=str)
    monkeypatch.setattr(fx, "LINES_PER_TASK", 300)
    dealt = fx.cust_features(spark, sf_small)
    assert dealt.rdd.getNumPartitions() == fx.rollup_tasks(fx.read_table(spark, sf_small, "lineitem")) > 8
    for a, b in zip(plain, sorted(dealt.collect(), key=str)):
        assert [x if not isinstance(x, float) else pytest.approx(x) for x in a] == list(b)
