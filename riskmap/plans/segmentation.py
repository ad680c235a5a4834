"""Registered segmentation queries (K rows).

Silhouette given labels, best-run choice and ARI are exact SQL over the
``embeddings`` / ``labelings`` fixtures and have DuckDB twins.  PCA and
K-Means queries run on the positive customers of ``cust_features`` (the
analysis' "positive class" subset) and are checked by invariant tests.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskmap.operators import clean as C
from riskmap.operators import features as E
from riskmap.operators import segment as K
from riskmap.plans.common import SessionCache, q6, sql_q6
from riskmap.plans.prediction import matrix
from riskmap.sources import fixtures as fx
from riskmap.spec import CUSTOMER_SPEC as SPEC

SEED = 42
STABILITY_SEEDS = tuple(range(100, 900, 100))       # eight seeds of our own
N_INIT = 20
KS = range(2, 9)
PERSONA_CAP = 5

# ---------------------------------------------------------------------------
# SQL-checked fixture queries
# ---------------------------------------------------------------------------


def k08_silhouette_labelings(spark, sf):
    """K8 given labels: exact Euclidean silhouette of each fixture labeling."""
    emb = fx.embedding_vectors(spark, sf)
    lab = fx.labelings(spark, sf)
    runs = [r[0] for r in lab.select("run").distinct().orderBy("run").collect()]
    rows = []
    for run in runs:
        df = emb.join(lab.where(F.col("run") == run).select("id", "label").withColumnRenamed("label", "cl"), "id")
        rows.append((int(run), K.silhouette_exact(df, "id", "features", "cl", K.SILHOUETTE_SAMPLE, SEED)))
    return q6(spark.createDataFrame(rows, "run int, silhouette double"))


def _silhouette_sql() -> str:
    return f"""WITH lab AS (
  SELECT vec_id AS id, 0 AS run, label FROM embeddings
  UNION ALL SELECT vec_id, 1, (label + 3) % 10 FROM embeddings
  UNION ALL SELECT vec_id, 2, CAST(floor(label / 2) AS INTEGER) FROM embeddings
  UNION ALL SELECT vec_id, 3, CAST(vec_id % 10 AS INTEGER) FROM embeddings
),
smp AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  ORDER BY md5(CAST(vec_id AS VARCHAR) || ':{SEED}'), vec_id LIMIT {K.SILHOUETTE_SAMPLE}
),
pts AS (SELECT l.run, l.id, l.label, s.x FROM lab l JOIN smp s ON s.id = l.id),
d AS (
  SELECT a.run, a.id, a.label AS own, b.label AS other, sum(list_distance(a.x, b.x)) AS dsum,
         count(*) AS cnt
  FROM pts a JOIN pts b ON a.run = b.run AND a.id <> b.id
  GROUP BY a.run, a.id, a.label, b.label
),
sz AS (SELECT run, label, count(*) AS n FROM pts GROUP BY run, label),
ab AS (
  SELECT d.run, d.id,
         max(CASE WHEN d.other = d.own THEN d.dsum / d.cnt END) AS a,
         min(CASE WHEN d.other <> d.own THEN d.dsum / d.cnt END) AS b,
         max(CASE WHEN d.other = d.own THEN 1 ELSE 0 END) AS has_mates
  FROM d GROUP BY d.run, d.id
),
s AS (
  SELECT run, CASE WHEN has_mates = 0 OR b IS NULL THEN 0.0
                   ELSE (b - a) / greatest(a, b) END AS s FROM ab
)
SELECT CAST(run AS INTEGER) AS run, {sql_q6('avg(s)')} AS silhouette FROM s GROUP BY run"""


K08_SQL = _silhouette_sql()


def k09_best_labeling(spark, sf):
    """K9: argmax silhouette over the fixture labelings (ties to the smaller run)."""
    t = k08_silhouette_labelings(spark, sf).withColumnRenamed("run", "k")
    return K.best_k(t)


K09_SQL = f"""WITH t AS ({K08_SQL.replace('SELECT CAST(run AS INTEGER) AS run', 'SELECT CAST(run AS INTEGER) AS k')})
SELECT k, silhouette FROM t ORDER BY silhouette DESC, k ASC LIMIT 1"""


def k12_ari_labelings(spark, sf):
    """Adjusted Rand index between every pair of fixture labelings."""
    return q6(K.ari_pairs(fx.labelings(spark, sf)))


def _ari_sql(digits: bool = True) -> str:
    r = sql_q6 if digits else (lambda e: e)
    return f"""WITH lab AS (
  SELECT vec_id AS id, 0 AS run, label FROM embeddings
  UNION ALL SELECT vec_id, 1, (label + 3) % 10 FROM embeddings
  UNION ALL SELECT vec_id, 2, CAST(floor(label / 2) AS INTEGER) FROM embeddings
  UNION ALL SELECT vec_id, 3, CAST(vec_id % 10 AS INTEGER) FROM embeddings
),
cont AS (
  SELECT a.run AS ra, b.run AS rb, a.label AS la, b.label AS lb, CAST(count(*) AS DOUBLE) AS nij
  FROM lab a JOIN lab b ON a.id = b.id AND a.run < b.run GROUP BY 1, 2, 3, 4
),
rs AS (SELECT ra, rb, sum(s * s) AS A2 FROM (SELECT ra, rb, la, sum(nij) AS s FROM cont GROUP BY 1, 2, 3) GROUP BY 1, 2),
cs AS (SELECT ra, rb, sum(s * s) AS B2 FROM (SELECT ra, rb, lb, sum(nij) AS s FROM cont GROUP BY 1, 2, 3) GROUP BY 1, 2),
tt AS (SELECT ra, rb, sum(nij * nij) AS SS, sum(nij) AS N FROM cont GROUP BY 1, 2),
pc AS (
  SELECT tt.ra, tt.rb, SS - N AS tp, B2 - SS AS fp, A2 - SS AS fn, N * N - A2 - B2 + SS AS tn
  FROM tt JOIN rs USING (ra, rb) JOIN cs USING (ra, rb)
),
up AS (
  SELECT CAST(ra AS INTEGER) AS run_a, CAST(rb AS INTEGER) AS run_b,
         CASE WHEN fn = 0 AND fp = 0 THEN 1.0
              ELSE 2.0 * (tp * tn - fn * fp) / ((tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)) END AS ari
  FROM pc
),
runs AS (SELECT DISTINCT run FROM lab)
SELECT run_a, run_b, {r('ari')} AS ari FROM up
UNION ALL SELECT run_b, run_a, {r('ari')} FROM up
UNION ALL SELECT CAST(run AS INTEGER), CAST(run AS INTEGER), 1.0 FROM runs"""


K12_SQL = _ari_sql()


def k13_mean_ari_labelings(spark, sf):
    """Mean off-diagonal ARI of the fixture labelings."""
    return q6(K.mean_offdiag(K.ari_pairs(fx.labelings(spark, sf))))


K13_SQL = f"""WITH t AS ({_ari_sql(digits=False)})
SELECT {sql_q6('avg(ari)')} AS mean_ari FROM t WHERE run_a < run_b"""


# ---------------------------------------------------------------------------
# K-Means / PCA on the positive customers
# ---------------------------------------------------------------------------

class SegPrepared:
    """Positive-class standardized matrices, with ("geo") and without ("behaviour")
    geography columns; each set is built when first asked for."""

    def __init__(self, spark, sf: str):
        both = matrix(spark, sf)
        self.fm, self.all = both.fm, both.all
        self._sets: dict = {}

    def __getitem__(self, key: str) -> dict:
        if key not in self._sets:
            names = self.fm.columns
            cols = names if key == "geo" else C.exclude_by_substring(names, SPEC.geo_substrings)
            idx = [names.index(c) for c in cols]
            asm = VectorAssembler(inputCols=[f"f_{i}" for i in idx], outputCol="features")
            df = K.deterministic_layout(asm.transform(C.positive_subset(self.all, SPEC)).select("k", "features"), "k")
            scaler = E.PopulationStandardScaler("features", "std").fit(df)
            std = scaler.transform(df).select("k", "std")
            model = K.full_pca(std, "std")
            ratios = K.pca_variance(model)
            m = K.components_for(ratios)
            pca = K.pca_project(model, m)
            proj = pca.transform(std).select("k", "pca").persist()
            self._sets[key] = dict(cols=cols, idx=idx, asm=asm, scaler=scaler, ratios=ratios,
                                   m=m, model=model, pca=pca, proj=proj)
        return self._sets[key]


_SEG = SessionCache(SegPrepared)


def seg(spark, sf) -> SegPrepared:
    return _SEG(spark, sf)


def k01_pca_variance(spark, sf):
    """K1/K2: explained variance ratios and the 80 % choice."""
    s = seg(spark, sf)["geo"]
    return K.variance_table(spark, s["ratios"])


def k05_top_loadings(spark, sf):
    """K3-K5: top 8 |loading| features of PC1-PC3 (signs fixed)."""
    s = seg(spark, sf)["geo"]
    return K.top_loadings(K.loadings_table(spark, s["model"], s["m"], s["cols"]))


def _sweep(spark, sf, key):
    st = seg(spark, sf)
    if f"sweep_{key}" not in st[key]:
        st[key][f"sweep_{key}"] = K.kmeans_sweep(st[key]["proj"], "k", KS, N_INIT, SEED)
    return st[key][f"sweep_{key}"]


def k07_kmeans_sweep(spark, sf):
    """K6-K8: best-of-20 K-Means for k = 2..8, inertia and exact silhouette of all rows."""
    table, _ = _sweep(spark, sf, "geo")
    return table


def k10_persona_best_k(spark, sf):
    """Best k by silhouette on the geography-free space, capped at 5."""
    table, _ = _sweep(spark, sf, "behaviour")
    return K.best_k(table, cap=PERSONA_CAP)


def k11_stability_ari(spark, sf):
    """Refits at the best k under 8 seeds; pairwise ARI (64 rows)."""
    table, _ = _sweep(spark, sf, "geo")
    k = K.best_k(table).collect()[0]["k"]
    labels = K.stability_labels(seg(spark, sf)["geo"]["proj"], "k", k, STABILITY_SEEDS, N_INIT)
    return K.ari_pairs(labels, "k", "run", "label")


def k14_assign_personas(spark, sf):
    """Every customer (both classes) through the persona scaler + PCA to the
    nearest of 5 centroids, canonical cluster numbering."""
    st = seg(spark, sf)
    s = st["behaviour"]
    model = K.kmeans_best_of(s["proj"], PERSONA_CAP, N_INIT, SEED)
    mapping = K.canonical_labels(model, s["proj"])
    allx = s["asm"].transform(st.all).select("k", "y", "features")
    proj = s["pca"].transform(s["scaler"].transform(allx))
    return K.assign(model, proj, mapping, "persona").select("k", "y", "persona")


def k15_projection_points(spark, sf):
    """PC1/PC2 coordinates with the best-k cluster of each positive customer."""
    st = seg(spark, sf)
    table, models = _sweep(spark, sf, "geo")
    k = K.best_k(table).collect()[0]["k"]
    m = models[k]
    proj = st["geo"]["proj"]
    mapping = K.canonical_labels(m, proj)
    return K.projection_points(K.assign(m, proj, mapping), "k", "pca", "cluster")


QUERIES = {
    "k01_pca_variance": (k01_pca_variance, None),
    "k05_top_loadings": (k05_top_loadings, None),
    "k07_kmeans_sweep": (k07_kmeans_sweep, None),
    "k08_silhouette_labelings": (k08_silhouette_labelings, K08_SQL),
    "k09_best_labeling": (k09_best_labeling, K09_SQL),
    "k10_persona_best_k": (k10_persona_best_k, None),
    "k11_stability_ari": (k11_stability_ari, None),
    "k12_ari_labelings": (k12_ari_labelings, K12_SQL),
    "k13_mean_ari_labelings": (k13_mean_ari_labelings, K13_SQL),
    "k14_assign_personas": (k14_assign_personas, None),
    "k15_projection_points": (k15_projection_points, None),
}
