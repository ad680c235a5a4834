import math

import pytest
from pyspark.sql import functions as F

from riskmap.operators import clean as C
from riskmap.operators import features as E
from riskmap.operators import split as S
from riskmap.spec import RoleSpec

SPEC = RoleSpec(outcome="y", ids=("id",), sentinel_columns=("s",), sentinel_values=(-996, -997, -998),
                refusal_columns=("r",), bool_columns=("b",), distance=("d",),
                ratios=(("q", "s", "d"),), ordinal=("d",), passthrough=("b",), nominal=("r", "code"))


def _raw(spark):
    rows = [(1, 1, -997.0, "R", True, -2.0, 1.0), (2, 0, 3.0, "x", False, None, 2.0),
            (3, 1, None, "y", True, 4.0, None), (4, 0, 5.0, None, False, 9.0, 1.0)]
    return spark.createDataFrame(rows, "id long, y int, s double, r string, b boolean, d double, code double")


def test_clean_rules(spark):
    c = {r.id: r for r in C.clean(_raw(spark), SPEC).collect()}
    assert c[1].s is None and c[1].r is None            # sentinel / refusal -> null
    assert c[1].b == 1 and c[2].b == 0                  # bool -> int
    assert c[1].d_log1p == 0.0                          # clipped at 0
    assert c[2].d_log1p is None                          # null stays null
    assert c[3].d_log1p == pytest.approx(math.log1p(4.0))
    assert c[2].q == pytest.approx(3.0 / (0 + 1e-3)) if c[2].d == 0 else c[2].q is None


def test_missing_outcome_raises(spark):
    with pytest.raises(KeyError):
        E.fit_feature_model(_raw(spark).drop("y"), SPEC)


def test_feature_model_medians_levels(spark):
    cl = C.clean(_raw(spark), SPEC)
    fm = E.fit_feature_model(cl, SPEC)
    assert fm.medians["d"] == 4.0                       # median of -2, 4, 9
    assert [o[2] for o in fm.onehot if o[0] == "code"] == ["code=1", "code=2", "code=unknown"]
    assert [o[1] for o in fm.onehot if o[0] == "r"] == ["unknown", "x", "y"]
    X = {r.id: r for r in fm.transform(cl).collect()}
    assert X[2]["d"] == 4.0                             # imputed
    assert X[1]["r=unknown"] == 1 and X[1]["r=x"] == 0


def test_all_null_column_fails_loudly(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 0, None)], "id long, y int, d double")
    spec = RoleSpec(outcome="y", ids=("id",), ordinal=("d",))
    with pytest.raises(ValueError):
        E.fit_feature_model(df, spec)


@pytest.mark.parametrize("parts", [1, 4, 7])
def test_stratified_split_sizes_and_invariance(spark, parts):
    n, pos = 4826, 1344
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") < pos).cast("int").alias("y"))
    sp = S.stratified_split(df.repartition(parts), "k", "y", 0.2, 42, hex_digits=2)
    counts = {(r.split, r.y): r["count"] for r in sp.groupBy("split", "y").count().collect()}
    assert counts[("test", 1)] == 269 and counts[("test", 0)] == 697   # 966 test rows
    ref = S.stratified_split(df, "k", "y", 0.2, 42, hex_digits=2)
    a = sorted(r.k for r in sp.where("split = 'test'").collect())
    b = sorted(r.k for r in ref.where("split = 'test'").collect())
    assert a == b


def test_split_equals_plain_rank(spark):
    """The bucketed cut equals ranking each class by (md5(id:seed), id)."""
    import hashlib
    n = 3000
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    sp = {r.k: r.split for r in S.stratified_split(df, "k", "y", 0.2, 42, hex_digits=3).collect()}
    for cls, alloc in ((1, None), (0, None)):
        ids = [i for i in range(n) if (i % 3 == 0) == bool(cls)]
        ranked = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))
        n_test = sum(1 for i in ids if sp[i] == "test")
        assert all(sp[i] == "test" for i in ranked[:n_test])
        assert all(sp[i] == "train" for i in ranked[n_test:])


def test_folds_balanced(spark):
    df = spark.range(1003).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    f = S.stratified_folds(df, "k", "y", 5, 7, hex_digits=2)
    sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
    assert sizes[-1] - sizes[0] <= 1
    per = f.groupBy("fold", "y").count().collect()
    for cls in (0, 1):
        c = sorted(r["count"] for r in per if r.y == cls)
        assert c[-1] - c[0] <= 1
    assert f.count() == 1003 and f.select("k").distinct().count() == 1003


def test_bounded_sample(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    s = S.bounded_sample(df, "k", 100, 1)
    assert s.count() == 100
    assert sorted(r.k for r in s.collect()) == sorted(r.k for r in S.bounded_sample(df.repartition(3), "k", 100, 1).collect())


def test_household_roles_prepare_a_table(spark):
    """The household column roles, profile lists included, on a synthetic table of that shape."""
    from riskmap.operators import clean as C
    from riskmap.operators import personas as G
    from riskmap.spec import HOUSEHOLD_CLUSTER_PROFILE, HOUSEHOLD_PERSONA_PROFILE, HOUSEHOLD_SPEC as H
    cols = list(dict.fromkeys([*H.ids, H.outcome, *H.leak, *H.low_quality, *H.weight, *H.distance, *H.ordinal,
                               *H.passthrough, *H.nominal, *H.profile_only]))
    text = {"head_hispanic", "head_racecat", "poverty_band"}
    rows = [tuple("R" if c in text and i % 5 == 0 else f"v{i % 3}" if c in text else i % 2 == 0 if c == "snap_any"
                  else -996 if c == "vehiclenum" and i % 4 == 0 else i % 2 if c == H.outcome else i + 1 for c in cols) for i in range(40)]
    df = spark.createDataFrame(rows, cols)
    assert len(cols) == 38
    cl = C.clean(df, H)
    assert len(cl.columns) == 38 + len(H.log_columns) + len(H.ratio_columns)
    n = cl.selectExpr("count(vehiclenum)", "count(head_racecat)", "sum(snap_any)").first()
    assert tuple(n) == (30, 32, 20)
    kept = C.drop_roles(cl, H, keep_id=False).columns
    assert not set(kept) & set(H.drop_columns) and set(H.log_columns) <= set(kept)
    profile = G.cluster_means(cl.withColumn("c", cl["region"] % 2), "c", HOUSEHOLD_CLUSTER_PROFILE)
    assert profile.count() == 2 and set(HOUSEHOLD_PERSONA_PROFILE) <= set(cl.columns)


def test_line_rollup_deals_lines_over_tasks(spark, monkeypatch):
    """Tasks grow in number with the lines; results are those of one task, also for a
    customer with most of the lines, null parts and orders without lines."""
    from riskmap.sources import fixtures as fx
    orders = spark.createDataFrame([(i, 1 if i % 3 else i, 1.0) for i in range(400)], "o_orderkey long, o_custkey long, o_totalprice double")
    lines = spark.createDataFrame([(i % 390, None if i % 50 == 0 else i % 7, float(i % 5), 0.25 * (i % 4), "R" if i % 3 == 0 else "N") for i in range(2000)],
                                  "l_orderkey long, l_partkey long, l_quantity double, l_discount double, l_returnflag string")
    few = fx.line_rollup(orders, lines)
    monkeypatch.setattr(fx, "LINES_PER_TASK", 100)
    many = fx.line_rollup(orders, lines)
    text = many._jdf.queryExecution().toString()
    assert "hashpartitioning(o_custkey" in text and ", 20), REPARTITION_BY_NUM" in text
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rows(few) == rows(many) and sum(r["n_lines"] for r in many.collect()) == 2000
