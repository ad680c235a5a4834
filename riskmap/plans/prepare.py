"""Registered prepare-track queries (A, B, C, E, S rows) on ``cust_features``,
with DuckDB twins generated from the same role spec."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmap.operators import clean as C
from riskmap.operators import features as E
from riskmap.operators import profile as B
from riskmap.operators import split as S
from riskmap.operators.moments import correlation_table
from riskmap.plans.common import dbl, q6, sql_q6
from riskmap.sources import fixtures as fx
from riskmap.sources.tables import read_table
from riskmap.spec import CUSTOMER_SPEC as SPEC

SEED = 42
FOLD_SEED = 4242

# ---------------------------------------------------------------------------
# DuckDB side
# ---------------------------------------------------------------------------

CF_SQL = f"""
ordr AS (
  SELECT o_custkey AS k, count(*) AS n_orders, max(o_totalprice) AS max_price,
         max(o_orderpriority = '1-URGENT') AS any_urgent
  FROM orders GROUP BY o_custkey
),
lin AS (
  SELECT o.o_custkey AS k, count(*) AS n_lines, count(DISTINCT l.l_partkey) AS n_parts,
         avg(l.l_discount) AS avg_disc, avg(l.l_quantity) AS avg_qty,
         sum(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_ret
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey
),
cf AS (
  SELECT c.c_custkey AS k,
    coalesce(CAST(CAST(lin.n_ret AS DOUBLE) / lin.n_lines > {dbl(fx.RET_SHARE_CUT)} AS INTEGER), 0) AS y,
    CAST(lin.n_ret AS DOUBLE) / lin.n_lines AS ret_share,
    CASE WHEN c.c_custkey % 11 = 0 THEN {dbl(-997)} WHEN c.c_custkey % 13 = 0 THEN {dbl(-996)}
         ELSE c.c_acctbal END AS acctbal_s,
    CASE WHEN c.c_custkey % 17 = 0 THEN 'R' ELSE c.c_mktsegment END AS segment_r,
    r.r_name AS region, n.n_name AS nation,
    CASE WHEN c.c_acctbal / {dbl(1000)} <= 1.0 THEN '<=1.0'
         WHEN c.c_acctbal / {dbl(1000)} <= 1.3 THEN '1.0-1.3'
         WHEN c.c_acctbal / {dbl(1000)} <= 2.0 THEN '1.3-2.0'
         WHEN c.c_acctbal / {dbl(1000)} <= 4.0 THEN '2.0-4.0' ELSE '>4.0' END AS balance_band,
    CAST(coalesce(ordr.n_orders, 0) AS BIGINT) AS n_orders,
    CAST(coalesce(lin.n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(lin.n_parts, 0) AS BIGINT) AS n_parts,
    coalesce(ordr.any_urgent, false) AS any_urgent,
    CASE WHEN c.c_custkey % 19 = 0 THEN CAST(NULL AS DOUBLE)
         WHEN c.c_custkey % 23 = 0 THEN -(ordr.max_price / {dbl(1000)})
         ELSE ordr.max_price / {dbl(1000)} END AS dist_like,
    lin.avg_disc, lin.avg_qty,
    CASE WHEN c.c_custkey % 500 = 0 THEN 1 ELSE 0 END AS near_const,
    CAST(1 + c.c_custkey % 3 AS DOUBLE) AS w,
    c.c_acctbal / {dbl(1000)} AS profile_only
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN ordr ON ordr.k = c.c_custkey LEFT JOIN lin ON lin.k = c.c_custkey
)"""

_codes = ", ".join(dbl(v) for v in SPEC.sentinel_values)
_ratios = ",\n    ".join(
    f"CAST({num} AS DOUBLE) / (CAST({den} AS DOUBLE) + {dbl(SPEC.ratio_eps)}) AS {name}"
    for name, num, den in SPEC.ratios)

CL_SQL = CF_SQL + f""",
cl0 AS (
  SELECT k, y, ret_share,
    CASE WHEN acctbal_s IN ({_codes}) THEN NULL ELSE acctbal_s END AS acctbal_s,
    CASE WHEN segment_r = '{SPEC.refusal_code}' THEN NULL ELSE segment_r END AS segment_r,
    region, nation, balance_band, n_orders, n_lines, n_parts,
    CAST(any_urgent AS INTEGER) AS any_urgent,
    dist_like, avg_disc, avg_qty, near_const, w, profile_only
  FROM cf
),
cl AS (
  SELECT *,
    CASE WHEN dist_like IS NULL THEN NULL ELSE ln(1 + greatest(dist_like, {dbl(0)})) END AS dist_like_log1p,
    {_ratios}
  FROM cl0
)"""

NUMERIC = list(SPEC.numeric_candidates)
PASS = list(SPEC.passthrough)
IMPUTED = NUMERIC + PASS
NOMINAL = list(SPEC.nominal)

_med_cols = ", ".join(f"median({c}) AS {c}" for c in IMPUTED)
FM_SQL = CL_SQL + f""",
med AS (SELECT {_med_cols} FROM cl),
fmw AS (
  SELECT cl.k, cl.y, {', '.join(f'coalesce(CAST(cl.{c} AS DOUBLE), CAST(med.{c} AS DOUBLE)) AS {c}' for c in IMPUTED)},
         {', '.join(f"coalesce(CAST(cl.{c} AS VARCHAR), 'unknown') AS {c}" for c in NOMINAL)}
  FROM cl JOIN med ON TRUE
),
lv AS (
  {' UNION '.join(f"SELECT DISTINCT '{c}' AS src, {c} AS level FROM fmw" for c in NOMINAL)}
)"""


def _fm_long_sql() -> str:
    nums = " UNION ALL ".join(
        f"SELECT k, '{c}' AS feature, {c} AS value FROM fmw" for c in IMPUTED)
    case = "CASE lv.src " + " ".join(f"WHEN '{c}' THEN fmw.{c}" for c in NOMINAL) + " END"
    return FM_SQL + f""",
fml AS (
  {nums}
  UNION ALL
  SELECT fmw.k, lv.src || '=' || lv.level AS feature,
         CAST(CAST({case} = lv.level AS INTEGER) AS DOUBLE) AS value
  FROM fmw JOIN lv ON TRUE
)"""


FML_SQL = _fm_long_sql()


# ---------------------------------------------------------------------------
# Spark side helpers
# ---------------------------------------------------------------------------

def _cleaned(spark, sf):
    return C.clean(fx.cust_features(spark, sf), SPEC)


def _fm(spark, sf):
    cl = _cleaned(spark, sf)
    return cl, E.fit_feature_model(cl, SPEC)


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------

def b01_shape(spark, sf):
    return q6(B.shape_summary(fx.cust_features(spark, sf), SPEC.outcome))


B01_SQL = f"""WITH {CF_SQL}
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(18 AS BIGINT) AS n_cols,
       {sql_q6('avg(CAST(y AS DOUBLE))')} AS positive_rate FROM cf"""


def b02_head(spark, sf):
    return q6(B.head(fx.cust_features(spark, sf), "k", 3))


B02_SQL = f"""WITH {CF_SQL}
SELECT k, y, {sql_q6('ret_share')} AS ret_share, {sql_q6('acctbal_s')} AS acctbal_s, segment_r,
       region, nation, balance_band, n_orders, n_lines, n_parts, any_urgent,
       {sql_q6('dist_like')} AS dist_like, {sql_q6('avg_disc')} AS avg_disc,
       {sql_q6('avg_qty')} AS avg_qty, near_const, {sql_q6('w')} AS w,
       {sql_q6('profile_only')} AS profile_only
FROM cf ORDER BY k LIMIT 3"""

_CL_TYPES = {"k": "int", "y": "int", "ret_share": "float", "acctbal_s": "float",
             "segment_r": "string", "region": "string", "nation": "string",
             "balance_band": "string", "n_orders": "int", "n_lines": "int", "n_parts": "int",
             "any_urgent": "int", "dist_like": "float", "avg_disc": "float", "avg_qty": "float",
             "near_const": "int", "w": "float", "profile_only": "float",
             "dist_like_log1p": "float", **{r[0]: "float" for r in SPEC.ratios}}


def b03_missing(spark, sf):
    return B.missing_summary(_cleaned(spark, sf))


B03_SQL = f"""WITH {CL_SQL}, m AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS column, '{t}' AS dtype, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing FROM cl" for c, t in _CL_TYPES.items())}
) SELECT * FROM m WHERE n_missing > 0"""

SENTINEL_COLS = ["acctbal_s", "dist_like"]


def b04_sentinel_summary(spark, sf):
    return q6(B.sentinel_summary(fx.cust_features(spark, sf), SENTINEL_COLS))


B04_SQL = f"""WITH {CF_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS column, {sql_q6(f'min({c})')} AS min, {sql_q6(f'max({c})')} AS max, {sql_q6(f'avg({c})')} AS mean, CAST(count(*) FILTER (WHERE {c} < 0) AS BIGINT) AS n_negative_codes FROM cf" for c in SENTINEL_COLS)}"""

QUALITY_COLS = ["acctbal_s", "near_const", "dist_like", "avg_disc"]


def b05_column_quality(spark, sf):
    return q6(B.column_quality(fx.cust_features(spark, sf), QUALITY_COLS))


def _quality_sql():
    parts = []
    for c in QUALITY_COLS:
        x = f"CAST({c} AS DOUBLE)"
        ms = f"avg(CASE WHEN {x} IS NULL OR {x} < 0 THEN 1.0 ELSE 0.0 END)"
        parts.append(f"""SELECT '{c}' AS column, {sql_q6(ms)} AS missing_share, {sql_q6(f'avg({x})')} AS mean,
   {sql_q6(f'var_pop({x})')} AS variance,
   ({ms} > 0.9 OR coalesce(var_pop({x}), 0.0) < {dbl(1e-3)}) AS drop FROM cf""")
    return f"WITH {CF_SQL}\n" + " UNION ALL ".join(parts)


B05_SQL = _quality_sql()


def b06_class_balance(spark, sf):
    return q6(B.class_balance(fx.cust_features(spark, sf), SPEC.outcome))


B06_SQL = f"""WITH {CF_SQL}
SELECT y AS class, CAST(count(*) AS BIGINT) AS n,
       {sql_q6('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct FROM cf GROUP BY y"""


def b07_marginal_rate(spark, sf):
    return q6(B.marginal_rate(_cleaned(spark, sf), "segment_r", SPEC.outcome, min_n=20))


B07_SQL = f"""WITH {CL_SQL}
SELECT segment_r AS level, {sql_q6('avg(CAST(y AS DOUBLE))')} AS rate, CAST(count(*) AS BIGINT) AS n
FROM cl WHERE segment_r IS NOT NULL GROUP BY segment_r HAVING count(*) >= 20"""

PANELS = ["balance_band", "region", "nation", "segment_r", "any_urgent", "n_orders"]


def b08_marginal_panels(spark, sf):
    return q6(B.marginal_panels(_cleaned(spark, sf), PANELS, SPEC.outcome, min_n=20))


B08_SQL = f"""WITH {CL_SQL}, long AS (
  {' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, CAST(y AS DOUBLE) AS y FROM cl" for c in PANELS)}
)
SELECT feature, level, {sql_q6('avg(y)')} AS rate, CAST(count(*) AS BIGINT) AS n,
       {sql_q6('(SELECT avg(CAST(y AS DOUBLE)) FROM cl)')} AS overall
FROM long WHERE level IS NOT NULL GROUP BY feature, level HAVING count(*) >= 20"""


def b09_correlation(spark, sf):
    cl, fm = _fm(spark, sf)
    return q6(correlation_table(fm.transform(cl), fm.numeric))


def _corr_sql():
    parts = []
    for i, a in enumerate(NUMERIC):
        for b in NUMERIC[i + 1:]:
            r = sql_q6(f"corr({a}, {b})")
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {r} AS r FROM fmw")
            parts.append(f"SELECT '{b}', '{a}', {r} FROM fmw")
    for c in NUMERIC:
        parts.append(f"SELECT '{c}', '{c}', 1.0")
    return f"WITH {FM_SQL}\n" + " UNION ALL ".join(parts)


B09_SQL = _corr_sql()

HIST_COLS = ["dist_like", "dist_like_log1p", "avg_qty", "lines_per_order"]


def b10_histogram(spark, sf):
    return q6(B.histogram(_cleaned(spark, sf), HIST_COLS, bins=40))


def _hist_sql(bins=40):
    rng = " UNION ALL ".join(
        f"SELECT '{c}' AS column, min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM cl"
        for c in HIST_COLS)
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS column, CAST({c} AS DOUBLE) AS x FROM cl WHERE {c} IS NOT NULL" for c in HIST_COLS)
    w = f"((r.hi - r.lo) / {dbl(bins)})"
    return f"""WITH {CL_SQL}, rng AS ({rng}), long AS ({long}),
cnt AS (
  SELECT l.column, CAST(least(CASE WHEN r.hi = r.lo THEN 0
         ELSE floor((l.x - r.lo) / (r.hi - r.lo) * {dbl(bins)}) END, {bins - 1}) AS INTEGER) AS bin,
         count(*) AS c
  FROM long l JOIN rng r ON r.column = l.column GROUP BY 1, 2
),
grid AS (SELECT r.column, r.lo, r.hi, CAST(b.bin AS INTEGER) AS bin FROM rng r, range(0, {bins}) b(bin))
SELECT r.column, r.bin, {sql_q6(f'r.lo + r.bin * {w}')} AS lo, {sql_q6(f'r.lo + (r.bin + 1) * {w}')} AS hi,
       CAST(coalesce(cnt.c, 0) AS BIGINT) AS count
FROM grid r LEFT JOIN cnt ON cnt.column = r.column AND cnt.bin = r.bin"""


B10_SQL = _hist_sql()


def b11_feature_groups(spark, sf):
    cl, fm = _fm(spark, sf)
    return B.feature_group_sizes(spark, fm.groups)


B11_SQL = f"""WITH {FM_SQL}
SELECT 'numeric_continuous' AS "group", CAST({len(NUMERIC)} AS BIGINT) AS n_columns
UNION ALL SELECT 'binary_or_count', CAST({len(PASS)} AS BIGINT)
UNION ALL SELECT 'one_hot', CAST(count(*) AS BIGINT) FROM lv"""


def c06_clean(spark, sf):
    return q6(_cleaned(spark, sf))


def _clean_select_sql():
    cols = []
    for c, t in _CL_TYPES.items():
        cols.append(sql_q6(c) + f" AS {c}" if t == "float" else c)
    return f"WITH {CL_SQL}\nSELECT {', '.join(cols)} FROM cl"


C06_SQL = _clean_select_sql()


def c10_positive_subset(spark, sf):
    cl = C.positive_subset(_cleaned(spark, sf), SPEC)
    kept = C.drop_roles(cl, SPEC)                      # C7: id kept, roles dropped
    return q6(kept.select("k", "n_orders", "n_lines", "dist_like_log1p", "segment_r"))


C10_SQL = f"""WITH {CL_SQL}
SELECT k, n_orders, n_lines, {sql_q6('dist_like_log1p')} AS dist_like_log1p, segment_r FROM cl WHERE y = 1"""


def c11_behavior_columns(spark, sf):
    cl, fm = _fm(spark, sf)
    kept = C.exclude_by_substring(fm.columns, SPEC.geo_substrings)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


def _behavior_sql():
    names = " UNION ALL ".join(f"SELECT '{c}' AS feature" for c in IMPUTED)
    cond = " AND ".join(f"strpos(feature, '{s}') = 0" for s in SPEC.geo_substrings)
    return f"""WITH {FM_SQL}, names AS ({names} UNION ALL SELECT src || '=' || level FROM lv)
SELECT feature FROM names WHERE {cond}"""


C11_SQL = _behavior_sql()


def e01_medians(spark, sf):
    cl = _cleaned(spark, sf)
    med = E.medians(cl, IMPUTED)
    return q6(spark.createDataFrame([(c, float(v)) for c, v in med.items()],
                                    "feature string, median double"))


E01_SQL = f"""WITH {CL_SQL}
{' UNION ALL '.join(f"SELECT '{c}' AS feature, {sql_q6(f'median(CAST({c} AS DOUBLE))')} AS median FROM cl" for c in IMPUTED)}"""


def e03_onehot_levels(spark, sf):
    cl, fm = _fm(spark, sf)
    return spark.createDataFrame([tuple(o) for o in fm.onehot], "feature string, level string, column string")


E03_SQL = f"""WITH {FM_SQL}
SELECT src AS feature, level, src || '=' || level AS column FROM lv"""


def e05_feature_matrix(spark, sf):
    """E5 in long form (k, feature, value): the schema does not depend on levels."""
    cl, fm = _fm(spark, sf)
    return q6(fm.to_long(cl))


E05_SQL = f"""WITH {FML_SQL}
SELECT k, feature, {sql_q6('value')} AS value FROM fml"""


def e08_standardize_moments(spark, sf):
    """The mean and population std each standardized column is scaled by."""
    cl, fm = _fm(spark, sf)
    X = fm.transform(cl)
    mom = E.moments(X, fm.columns)
    rows = [(c, float(m), float(sp)) for c, (m, sp, ss) in mom.items()]
    return q6(spark.createDataFrame(rows, "feature string, mean double, std double"))


def _moments_sql():
    nums = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {sql_q6(f'avg({c})')} AS mean, {sql_q6(f'stddev_pop({c})')} AS std FROM fmw"
        for c in IMPUTED)
    case = "CASE lv.src " + " ".join(f"WHEN '{c}' THEN fmw.{c}" for c in NOMINAL) + " END"
    oh = f"""SELECT lv.src || '=' || lv.level AS feature,
      {sql_q6(f'avg(CAST({case} = lv.level AS DOUBLE))')} AS mean,
      {sql_q6(f'stddev_pop(CAST({case} = lv.level AS DOUBLE))')} AS std
    FROM fmw JOIN lv ON TRUE GROUP BY lv.src, lv.level"""
    return f"WITH {FM_SQL}\n{nums} UNION ALL {oh}"


E08_SQL = _moments_sql()


def s01_stratified_split(spark, sf):
    cf = fx.cust_features(spark, sf).select("k", "y")
    return S.stratified_split(cf, "k", "y", test_size=0.2, seed=SEED)


def _split_sql(src: str, test_size=0.2, seed=SEED):
    return f"""
cnt AS (SELECT y, count(*) AS n_c FROM {src} GROUP BY y),
tr0 AS (SELECT y, n_c, sum(n_c) OVER () - ceil(sum(n_c) OVER () * {dbl(test_size)}) AS nd,
               sum(n_c) OVER () AS n FROM cnt),
tr1 AS (SELECT *, nd * n_c / n AS cont FROM tr0),
tr2 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem, nd - sum(floor(cont)) OVER () AS need FROM tr1),
tr AS (SELECT y, n_c - (fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= need THEN 1 ELSE 0 END) AS n_c
       FROM tr2),
te0 AS (SELECT y, n_c, sum(n_c) OVER () AS nd, sum(n_c) OVER () AS n FROM tr),
te1 AS (SELECT *, nd * n_c / n AS cont FROM te0),
te2 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem, nd - sum(floor(cont)) OVER () AS need FROM te1),
te AS (SELECT y, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= need THEN 1 ELSE 0 END AS alloc
       FROM te2),
rk AS (SELECT s.*, row_number() OVER (PARTITION BY s.y ORDER BY md5(CAST(s.k AS VARCHAR) || ':{seed}'), s.k) AS r
       FROM {src} s),
sp AS (SELECT rk.k, rk.y, CASE WHEN rk.r <= te.alloc THEN 'test' ELSE 'train' END AS split
       FROM rk JOIN te ON te.y = rk.y)"""


S01_SQL = f"""WITH {CF_SQL}, {_split_sql('cf')}
SELECT k, y, split FROM sp"""


def s02_stratified_folds(spark, sf):
    cf = fx.cust_features(spark, sf).select("k", "y")
    train = S.stratified_split(cf, "k", "y", 0.2, SEED).where(F.col("split") == "train")
    return S.stratified_folds(train.drop("split"), "k", "y", 5, FOLD_SEED)


S02_SQL = f"""WITH {CF_SQL}, {_split_sql('cf')}
SELECT k, y, CAST((row_number() OVER (ORDER BY y, md5(CAST(k AS VARCHAR) || ':{FOLD_SEED}'), k) - 1) % 5 AS INTEGER) AS fold
FROM sp WHERE split = 'train'"""


def s04_bounded_sample(spark, sf):
    ev = read_table(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    return S.bounded_sample(ev, "id", 2000, seed=SEED)


S04_SQL = f"""SELECT event_id AS id, event_type FROM events
ORDER BY md5(CAST(event_id AS VARCHAR) || ':{SEED}'), event_id LIMIT 2000"""


def s05_union_splits(spark, sf):
    cf = fx.cust_features(spark, sf).select("k", "y")
    sp = S.stratified_split(cf, "k", "y", 0.2, SEED)
    tr = sp.where(F.col("split") == "train")
    te = sp.where(F.col("split") == "test")
    return S.union_rows(tr, te).groupBy("split", "y").agg(F.count(F.lit(1)).alias("n"))


S05_SQL = f"""WITH {CF_SQL}, {_split_sql('cf')}
SELECT split, y, CAST(count(*) AS BIGINT) AS n FROM sp GROUP BY split, y"""


QUERIES = {
    "b01_shape": (b01_shape, B01_SQL),
    "b02_head": (b02_head, B02_SQL),
    "b03_missing": (b03_missing, B03_SQL),
    "b04_sentinel_summary": (b04_sentinel_summary, B04_SQL),
    "b05_column_quality": (b05_column_quality, B05_SQL),
    "b06_class_balance": (b06_class_balance, B06_SQL),
    "b07_marginal_rate": (b07_marginal_rate, B07_SQL),
    "b08_marginal_panels": (b08_marginal_panels, B08_SQL),
    "b09_correlation": (b09_correlation, B09_SQL),
    "b10_histogram": (b10_histogram, B10_SQL),
    "b11_feature_groups": (b11_feature_groups, B11_SQL),
    "c06_clean": (c06_clean, C06_SQL),
    "c10_positive_subset": (c10_positive_subset, C10_SQL),
    "c11_behavior_columns": (c11_behavior_columns, C11_SQL),
    "e01_medians": (e01_medians, E01_SQL),
    "e03_onehot_levels": (e03_onehot_levels, E03_SQL),
    "e05_feature_matrix": (e05_feature_matrix, E05_SQL),
    "e08_standardize_moments": (e08_standardize_moments, E08_SQL),
    "s01_stratified_split": (s01_stratified_split, S01_SQL),
    "s02_stratified_folds": (s02_stratified_folds, S02_SQL),
    "s04_bounded_sample": (s04_bounded_sample, S04_SQL),
    "s05_union_splits": (s05_union_splits, S05_SQL),
}


# -- A2-A4: sinks, checked by reading back what was written -----------------

def _artifact_dir(spark, name: str) -> str:
    import uuid
    from riskmap.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskmap-artifacts/{name}-{uuid.uuid4().hex}"


def a02_split_roundtrip(spark, sf):
    """A2/A3: persist the keyed split partitioned by ``split``; reload the test
    split (partition pruning reads only that directory)."""
    from riskmap.sources.tables import load_split, save_splits
    cf = fx.cust_features(spark, sf).select("k", "y")
    path = _artifact_dir(spark, "splits")
    save_splits(S.stratified_split(cf, "k", "y", 0.2, SEED), path)
    return load_split(spark, path, "test").select("k", "y")


A02_SQL = f"""WITH {CF_SQL}, {_split_sql('cf')}
SELECT k, y FROM sp WHERE split = 'test'"""


def a04_report_roundtrip(spark, sf):
    """A4: write a result table as one CSV file and read it back with its schema."""
    from riskmap.plans.evaluation import v17_topk_operating_points
    from riskmap.sources.tables import write_report
    res = v17_topk_operating_points(spark, sf)
    path = _artifact_dir(spark, "topk")
    write_report(res, path)
    return spark.read.schema(res.schema).option("header", True).csv(path)


def _a04_sql():
    from riskmap.plans.evaluation import V17_SQL
    return V17_SQL


QUERIES["a02_split_roundtrip"] = (a02_split_roundtrip, A02_SQL)
QUERIES["a04_report_roundtrip"] = (a04_report_roundtrip, _a04_sql())
