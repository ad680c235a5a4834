"""Registered queries that make fitted models comparable with SQL.

A fitted coefficient has no SQL form, but what must hold for it has: every row is scored
once, gradients vanish at the optimum, a saved model scores as before, the principal
axes diagonalise the covariance matrix.  Each query computes such a statement from the
fitted objects, row by row, and its twin states what the rows must be.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskmap.operators import clean as C
from riskmap.operators import models as M
from riskmap.operators import moments as Q
from riskmap.operators import segment as K
from riskmap.plans.common import q6, sql_q6
from riskmap.plans.prediction import prepared
from riskmap.plans.prepare import CF_SQL, CL_SQL, FML_SQL, FM_SQL, FOLD_SEED, IMPUTED, NOMINAL, NUMERIC, PASS, _cleaned, _split_sql
from riskmap.plans.rollup import CUST_DICTIONARY
from riskmap.plans.segmentation import KS, PERSONA_CAP, _sweep, k14_assign_personas, seg
from riskmap.session import ensure_checkpoint_dir
from riskmap.sources import fixtures as fx
from riskmap.sources.tables import corrupt_rows, load_raw, sound_rows
from riskmap.spec import CUSTOMER_SPEC as SPEC

SPLIT_SQL = f"WITH {CF_SQL}, {_split_sql('cf')}"


def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskmap-{name}-{uuid.uuid4().hex}"


# -- A1, C7, C9, C13, E6 ------------------------------------------------------

def a01_csv_scan(spark, sf):
    """A1: the customer table as CSV, columns in another order, read back by its dictionary;
    ``n_corrupt`` counts rows that do not parse (none here)."""
    table = fx.cust_features(spark, sf)
    path = _scratch(spark, "csv")
    table.select(*reversed(table.columns)).write.option("header", True).csv(path)
    raw = load_raw(spark, path, CUST_DICTIONARY)
    bad = raw.persist().transform(corrupt_rows).count()
    return q6(sound_rows(raw).select(*table.columns)).withColumn("n_corrupt", F.lit(bad).cast("long"))


_FLOATS = {"ret_share", "acctbal_s", "dist_like", "avg_disc", "avg_qty", "w", "profile_only"}
_CF_COLUMNS = [c for c, _ in CUST_DICTIONARY if c != "poverty_ratio"]
A01_SQL = f"""WITH {CF_SQL} SELECT {', '.join(f'{sql_q6(c)} AS {c}' if c in _FLOATS else c for c in _CF_COLUMNS)},
       CAST(0 AS BIGINT) AS n_corrupt FROM cf"""


def c07_columns_left(spark, sf):
    """Columns that stay when roles are dropped (id and outcome kept as key and label),
    with the values each holds."""
    cl = _cleaned(spark, sf)
    kept = C.drop_roles(cl, SPEC, keep_id=False).columns
    counted = cl.select(*kept, C.outcome_int(SPEC, "outcome")).agg(*[F.count(c).alias(c) for c in [*kept, "outcome"]])
    return counted.unpivot([], [*kept, "outcome"], "column", "n_values")


_KEPT = ["acctbal_s", "segment_r", "region", "nation", "balance_band", "n_orders", "n_lines", "n_parts", "any_urgent",
         "dist_like", "avg_disc", "avg_qty", "profile_only", "dist_like_log1p", *SPEC.ratio_columns]
C07_SQL = f"WITH {CL_SQL}\n" + "\nUNION ALL ".join(
    [f"SELECT '{c}' AS column, count({c}) AS n_values FROM cl" for c in _KEPT] + ["SELECT 'outcome', count(y) FROM cl"])


def c13_rounded_rates(spark, sf):
    """Outcome rate and mean balance by nation, rounded at the report edge."""
    cl = _cleaned(spark, sf)
    return C.round_report(cl.groupBy("nation").agg(F.avg("y").alias("rate"), F.avg("acctbal_s").alias("balance")), 3, ["rate", "balance"])


C13_SQL = f"""WITH {CL_SQL} SELECT nation, round(avg(CAST(y AS DOUBLE)), 3) AS rate, round(avg(acctbal_s), 3) AS balance FROM cl GROUP BY nation"""


def e06_scaled_training_matrix(spark, sf):
    """Every training row's vector as the solvers get it: numeric columns standardized by
    the training rows (population std), counts and one-hot columns as they are."""
    p = prepared(spark, sf)
    model = Pipeline(stages=M.feature_stages(p.fm, True)).fit(p.train)
    names = F.array(*[F.lit(c) for c in p.fm.columns])
    entries = model.transform(p.train).select("k", F.posexplode(vector_to_array(M.FEATURES)).alias("i", "value"))
    return q6(entries.select("k", names[F.col("i")].alias("feature"), "value"))


E06_SQL = f"""WITH {FML_SQL}, {_split_sql('cf')},
trn AS (SELECT fml.* FROM fml JOIN sp USING (k) WHERE sp.split = 'train'),
mo AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM trn GROUP BY feature)
SELECT k, feature, {sql_q6(f"CASE WHEN feature NOT IN ({', '.join(repr(c) for c in NUMERIC)}) THEN value WHEN s = 0 THEN 0.0 ELSE (value - m) / s END")} AS value
FROM trn JOIN mo USING (feature)"""


# -- M1, M3, M5, M7, M8, M10, M12, S3 -----------------------------------------

def m01_gradient(spark, sf):
    """M1: at the fitted optimum C * sum (p - y) x + beta = 0 for every column and the
    unpenalised intercept (``at_optimum``), up to a thousandth of the column's size."""
    p = prepared(spark, sf)
    train = M.with_label(p.train)
    model = M.fit_pipeline(p.fm, M.lr_family(), {"C": 1.0}, train, weight_sum=float(p.n_train))
    x, error = vector_to_array(M.FEATURES), vector_to_array("probability")[1] - F.col("label")
    every = F.concat(x, F.array(F.lit(1.0)))
    sums = (model.transform(train).select(F.posexplode(every).alias("i", "v"), error.alias("e"))
            .groupBy("i").agg(F.sum(F.col("v") * F.col("e")).alias("g"), F.sum(F.abs("v")).alias("size")))
    beta = [*model.stages[-1].coefficients.toArray().tolist(), 0.0]
    table = spark.createDataFrame(list(zip(range(len(beta)), [*p.fm.columns, "(intercept)"], beta)), "i int, feature string, beta double")
    return table.join(sums, "i").select("feature", (F.abs(F.col("g") + F.col("beta")) < 0.05 + 0.001 * F.col("size")).alias("at_optimum"))


M01_SQL = f"""WITH {FM_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS feature, TRUE AS at_optimum" for c in [*IMPUTED, '(intercept)'])}
UNION ALL SELECT src || '=' || level, TRUE FROM lv"""

_STEPS = (0.0, 0.5, 0.9, 1.1, 1.5)


def m03_objective(spark, sf):
    """M3: the linear SVM's objective 1/2 |beta|^2 + C * sum hinge along the ray through the
    fitted coefficients: no multiple of them is better."""
    p = prepared(spark, sf)
    train = M.with_label(p.train)
    model = M.fit_pipeline(p.fm, M.svm_lin_family(), {"C": 1.0}, train, weight_sum=float(p.n_train))
    svm = model.stages[-1]
    size = float(np.square(svm.coefficients.toArray()).sum()) / 2
    plain = vector_to_array("rawPrediction")[1] - F.lit(float(svm.intercept))
    sign = F.lit(2.0) * F.col("label") - 1

    def objective(step):
        margin = sign * (F.lit(step) * plain + F.lit(float(svm.intercept)))
        return F.lit(step * step * size) + F.sum(F.greatest(F.lit(0.0), 1 - margin))

    scored = model.transform(train)
    values = scored.agg(objective(1.0).alias("best"), *[objective(s).alias(f"s{i}") for i, s in enumerate(_STEPS)])
    rows = F.array(*[F.struct(F.lit(s).alias("multiple"), (F.col(f"s{i}") >= F.col("best") * (1 - 1e-3)).alias("no_better"))
                     for i, s in enumerate(_STEPS)])
    return values.select(F.inline(rows))


M03_SQL = " UNION ALL ".join(f"SELECT CAST({s} AS DOUBLE) AS multiple, TRUE AS no_better" for s in _STEPS)


def m05_saved_model_scores(spark, sf):
    """M5: a fitted kernel pipeline written to the shared folder and loaded again scores every
    test row as before."""
    p = prepared(spark, sf)
    model = M.fit_pipeline(p.fm, M.lr_kernel_family(), {"gamma": 0.05, "C": 1.0}, M.with_label(p.train), weight_sum=float(p.n_train))
    path = _scratch(spark, "model")
    model.write().save(path)
    loaded = PipelineModel.load(path)
    a, b = (M._score(m, p.test, "prob", ["k", "y"]) for m in (model, loaded))
    return (M.materialize(a).join(M.materialize(b.withColumnRenamed("p", "q").drop("y")), "k")
            .select("k", "y", (F.abs(F.col("p") - F.col("q")) < 1e-12).alias("same")))


M05_SQL = f"{SPLIT_SQL}\nSELECT k, y, TRUE AS same FROM sp WHERE split = 'test'"


def m07_sigmoid_optimum(spark, sf):
    """M7: at the fitted sigmoid the sums of (p - t) and (p - t) * margin over the smoothed
    targets t vanish, for the plain and the balanced SVM."""
    p = prepared(spark, sf)
    out = []
    for name, weighted in (("none", False), ("balanced", True)):
        oof = M.oof_scores(p.fm, M.svm_lin_family(), {"C": 1.0}, p.train, weighted=weighted)
        a, b = M.platt_fit(oof)
        n = oof.agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).first()
        t = F.when(F.col("y") == 1, (n["p"] + 1) / (n["p"] + 2)).otherwise(1 / (n["n"] - n["p"] + 2))
        e = M.platt_apply(oof.withColumn("margin", F.col("p")), a, b).withColumn("e", F.col("p") - t)
        s = e.agg(F.sum("e").alias("b"), F.sum(F.col("e") * F.col("margin")).alias("a"), F.sum(F.abs("margin")).alias("m"))
        out.append(s.select(F.lit(name).alias("strategy"), (F.abs("b") < 1e-2).alias("offset_settled"),
                            (F.abs("a") < 1e-3 * F.greatest(F.col("m"), F.lit(10.0))).alias("slope_settled")))
    return out[0].unionByName(out[1])


M07_SQL = "SELECT s AS strategy, TRUE AS offset_settled, TRUE AS slope_settled FROM (VALUES ('none'), ('balanced')) t(s)"


def m08_choice(spark, sf):
    """M8: the searched grid point is the first of those with the largest mean AP."""
    table, _, _ = prepared(spark, sf).search(M.lr_family())
    top = table.agg(F.max("mean_ap").alias("top"))
    first = table.join(F.broadcast(top), F.col("mean_ap") == F.col("top")).agg(F.min("grid_id").alias("first"))
    return table.join(F.broadcast(first)).select("grid_id", "params", (F.col("best") == (F.col("grid_id") == F.col("first"))).alias("right_choice"))


M08_SQL = """SELECT CAST(i AS INTEGER) AS grid_id, '{''C'': ' || c || '}' AS params, TRUE AS right_choice
FROM (VALUES (0, '0.01'), (1, '0.1'), (2, '1.0'), (3, '10.0')) t(i, c)"""


def m10_score_coverage(spark, sf):
    """Each test row once per model, with a probability."""
    from riskmap.plans.prediction import m10_batch_scores
    return m10_batch_scores(spark, sf).select("k", "model", "y", F.col("p").between(0.0, 1.0).alias("in_range"))


M10_SQL = f"""{SPLIT_SQL}
SELECT k, m AS model, y, TRUE AS in_range FROM sp, (VALUES ('LR (none)'), ('LR (balanced)')) t(m) WHERE split = 'test'"""


def m12_importances_sum(spark, sf):
    """A forest's importances over all columns: none negative, sum 1."""
    p = prepared(spark, sf)
    model = M.fit_pipeline(p.fm, M.rf_family(n_trees=50), {"max_depth": 10, "min_leaf": 5}, M.with_label(p.train), weight_sum=float(p.n_train))
    table = M.importance_table(model, p.fm, len(p.fm.columns))
    return table.agg(F.count(F.lit(1)).alias("n_columns"), F.min(F.col("importance") >= 0).alias("none_negative"),
                     (F.abs(F.sum("importance") - 1) < 1e-9).alias("sums_to_one"))


M12_SQL = f"WITH {FM_SQL}\nSELECT {len(IMPUTED)} + count(*) AS n_columns, TRUE AS none_negative, TRUE AS sums_to_one FROM lv"


def s03_oof_coverage(spark, sf):
    """S3: every training row is scored once, in its own fold."""
    from riskmap.plans.prediction import s03_oof_scores
    return s03_oof_scores(spark, sf).select("k", "fold", "y", F.col("p").between(0.0, 1.0).alias("in_range"))


# -- K1-K7, K11, K14, K15 -------------------------------------------------------

_DIMS = [f"x{i}" for i in range(64)]


def k01_covariance(spark, sf):
    """K1: population covariance of every pair of embedding dimensions, in long form."""
    return q6(Q.covariance_table(fx.embedding_vectors(spark, sf, as_vector=False), F.col("emb"), _DIMS))


K01_COV_SQL = f"""WITH e AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(64)) AS i FROM embeddings)
SELECT 'x' || a.i AS a, 'x' || b.i AS b, {sql_q6('covar_pop(a.v, b.v)')} AS cov
FROM e a JOIN e b ON a.vec_id = b.vec_id GROUP BY a.i, b.i"""


def k01_variance_identity(spark, sf):
    """K1, K2: with S the covariance table of the standardized rows, every principal axis v has
    v' S v / trace(S) equal to its explained-variance ratio, and v' S w = 0 for the next
    axis w.  The quadratic forms come from a join of the two long tables."""
    s = seg(spark, sf)["geo"]
    names = list(s["cols"])
    std = s["scaler"].transform(s["asm"].transform(C.positive_subset(seg(spark, sf).all, SPEC)).select("features"))
    cov = M.materialize(Q.covariance_table(std.select(vector_to_array("std").alias("x")), F.col("x"), names))
    pc = s["model"].pc.toArray()
    axes = spark.createDataFrame([(names[i], j, float(pc[i, j])) for i in range(len(names)) for j in range(len(names))],
                                 "feature string, component int, v double")
    left = cov.join(axes.withColumnRenamed("feature", "a"), "a")
    other = axes.select(F.col("feature").alias("b"), F.col("component").alias("c2"), F.col("v").alias("w"))
    forms = (left.join(other, "b").where("c2 = component OR c2 = component + 1")
             .groupBy("component", "c2").agg(F.sum(F.col("cov") * F.col("v") * F.col("w")).alias("form")))
    trace = cov.where("a = b").agg(F.sum("cov").alias("trace"))
    ratios = spark.createDataFrame([(j, float(r)) for j, r in enumerate(s["ratios"])], "component int, ratio double")
    own = F.max(F.when(F.col("c2") == F.col("component"), F.abs(F.col("form") / F.col("trace") - F.col("ratio"))))
    cross = F.max(F.when(F.col("c2") != F.col("component"), F.abs(F.col("form") / F.col("trace"))))
    return (forms.join(F.broadcast(ratios), "component").join(F.broadcast(trace)).groupBy("component")
            .agg((own < 1e-9).alias("ratio_holds"), (F.coalesce(cross, F.lit(0.0)) < 1e-9).alias("uncorrelated")))


_BEHIND = f"WITH {FM_SQL}"
K01_ID_SQL = f"""{_BEHIND}
SELECT CAST(unnest(range({len(IMPUTED)} + (SELECT count(*) FROM lv))) AS INTEGER) AS component, TRUE AS ratio_holds, TRUE AS uncorrelated"""


def k04_loadings_orthonormal(spark, sf):
    """K3, K4: dot products of the first three axes' loadings, from the long table."""
    s = seg(spark, sf)["geo"]
    t = K.loadings_table(spark, s["model"], 3, s["cols"])
    other = t.select("feature", F.col("pc").alias("other"), F.col("loading").alias("l2"))
    return q6(t.join(other, "feature").groupBy("pc", "other").agg(F.sum(F.col("loading") * F.col("l2")).alias("dot")))


K04_SQL = """SELECT 'PC' || a AS pc, 'PC' || b AS other, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS dot
FROM (VALUES (1), (2), (3)) s(a), (VALUES (1), (2), (3)) t(b)"""


def k06_centroids_are_means(spark, sf):
    """K6: every centroid of the persona fit is the mean of the rows it gets, up to the
    tolerance at which Lloyd's iteration stops."""
    proj = seg(spark, sf)["behaviour"]["proj"]
    model = K.kmeans_best_of(proj, PERSONA_CAP, 20, 42)
    tol = 2 * K.kmeans_tolerance(proj, PERSONA_CAP)
    given = spark.createDataFrame([(c, i, float(v)) for c, x in enumerate(model.clusterCenters()) for i, v in enumerate(x)],
                                  "cluster int, i int, centre double")
    means = (model.transform(proj).select("cluster", F.posexplode(vector_to_array("pca")).alias("i", "v"))
             .groupBy("cluster", "i").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")))
    return (given.join(means, ["cluster", "i"], "left").groupBy("cluster")
            .agg((F.sqrt(F.sum(F.pow(F.col("centre") - F.col("mean"), 2))) <= tol).alias("is_mean")))


K06_SQL = f"SELECT CAST(unnest(range({PERSONA_CAP})) AS INTEGER) AS cluster, TRUE AS is_mean"


def k07_sweep_order(spark, sf):
    """K7: more clusters never cost more, and silhouettes lie between -1 and 1."""
    table, _ = _sweep(spark, sf, "geo")
    before = table.select((F.col("k") + 1).alias("k"), F.col("inertia").alias("before"))
    return table.join(before, "k", "left").select(
        "k", (F.col("inertia") <= F.coalesce("before", "inertia") * 1.001).alias("no_dearer"),
        (F.col("silhouette").between(-1, 1) & F.col("silhouette_full").between(-1, 1)).alias("in_range"))


K07_SQL = f"SELECT CAST(unnest(range({min(KS)}, {max(KS) + 1})) AS INTEGER) AS k, TRUE AS no_dearer, TRUE AS in_range"


def k14_nearest_centroid(spark, sf):
    """Every embedding's nearest class mean, from a centroid table."""
    emb = fx.embedding_vectors(spark, sf, as_vector=False)
    means = (emb.select("label", F.posexplode("emb").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
             .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("coords"))
             .withColumnRenamed("label", "cluster"))
    return K.nearest_centroid(emb, "emb", means).select("id", "label", "cluster")


K14_SQL = """WITH e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(64)) AS i FROM embeddings),
c AS (SELECT label AS cluster, i, avg(v) AS m FROM e GROUP BY label, i),
d AS (SELECT e.vec_id, e.label, c.cluster, sum((e.v - c.m) * (e.v - c.m)) AS d FROM e JOIN c USING (i) GROUP BY ALL)
SELECT vec_id AS id, label, arg_min(cluster, (d, cluster)) AS cluster FROM d GROUP BY vec_id, label"""


def k14_persona_coverage(spark, sf):
    """Every customer, of both classes, has one of the personas."""
    return k14_assign_personas(spark, sf).select("k", "y", F.col("persona").between(0, PERSONA_CAP - 1).alias("known"))


K14_ALL_SQL = f"WITH {CF_SQL} SELECT k, y, TRUE AS known FROM cf"


def k15_point_coverage(spark, sf):
    """Every positive customer has a point and a cluster."""
    from riskmap.plans.segmentation import k15_projection_points
    pts = k15_projection_points(spark, sf)
    return pts.select("k", (F.col("pc1").isNotNull() & F.col("pc2").isNotNull() & (F.col("cluster") >= 0)).alias("placed"))


K15_SQL = f"WITH {CF_SQL} SELECT k, TRUE AS placed FROM cf WHERE y = 1"


def _s03_sql() -> str:
    from riskmap.plans.prepare import S02_SQL
    return f"SELECT k, fold, y, TRUE AS in_range FROM ({S02_SQL})"


QUERIES = {
    "a01_csv_scan": (a01_csv_scan, A01_SQL),
    "c07_columns_left": (c07_columns_left, C07_SQL),
    "c13_rounded_rates": (c13_rounded_rates, C13_SQL),
    "e06_scaled_training_matrix": (e06_scaled_training_matrix, E06_SQL),
    "m01_gradient": (m01_gradient, M01_SQL),
    "m03_objective": (m03_objective, M03_SQL),
    "m05_saved_model_scores": (m05_saved_model_scores, M05_SQL),
    "m07_sigmoid_optimum": (m07_sigmoid_optimum, M07_SQL),
    "m08_choice": (m08_choice, M08_SQL),
    "m10_score_coverage": (m10_score_coverage, M10_SQL),
    "m12_importances_sum": (m12_importances_sum, M12_SQL),
    "s03_oof_coverage": (s03_oof_coverage, _s03_sql()),
    "k01_covariance": (k01_covariance, K01_COV_SQL),
    "k01_variance_identity": (k01_variance_identity, K01_ID_SQL),
    "k04_loadings_orthonormal": (k04_loadings_orthonormal, K04_SQL),
    "k06_centroids_are_means": (k06_centroids_are_means, K06_SQL),
    "k07_sweep_order": (k07_sweep_order, K07_SQL),
    "k14_nearest_centroid": (k14_nearest_centroid, K14_SQL),
    "k14_persona_coverage": (k14_persona_coverage, K14_ALL_SQL),
    "k15_point_coverage": (k15_point_coverage, K15_SQL),
}
