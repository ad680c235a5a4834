"""Registered table-derivation queries (D1-D7) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmap.operators import rollup as D
from riskmap.plans.common import dbl, q6, sql_q6
from riskmap.plans.prepare import CF_SQL
from riskmap.sources import fixtures as fx
from riskmap.sources.tables import read_table

# documented schema of cust_features (FIXTURES.md 2.1)
CUST_DICTIONARY = (
    ("k", "int"), ("y", "int"), ("ret_share", "float"), ("acctbal_s", "float"),
    ("segment_r", "string"), ("region", "string"), ("nation", "string"),
    ("balance_band", "string"), ("n_orders", "int"), ("n_lines", "int"), ("n_parts", "int"),
    ("any_urgent", "bool"), ("dist_like", "float"), ("avg_disc", "float"), ("avg_qty", "float"),
    ("near_const", "int"), ("w", "float"), ("profile_only", "float"), ("poverty_ratio", "float"),
)


def d01_schema_check(spark, sf):
    """Documented columns vs the built table (``poverty_ratio`` is absent)."""
    return D.schema_check(fx.cust_features(spark, sf), CUST_DICTIONARY)


def _dictionary_sql() -> str:
    fit = {"int": "{v} = floor({v})", "float": "isfinite({v})", "string": "length({v}) > 0", "bool": "{v} IS NOT NULL"}
    parts = []
    for v, t in CUST_DICTIONARY:
        if v == "poverty_ratio":
            parts.append(f"SELECT '{v}' AS variable, '{t}' AS expected, CAST(NULL AS VARCHAR) AS actual, "
                         "count(*) AS n_rows, CAST(0 AS BIGINT) AS n_values, CAST(0 AS BIGINT) AS n_fit, FALSE AS ok FROM cf")
        else:
            ok = fit[t].format(v=v)
            parts.append(f"SELECT '{v}' AS variable, '{t}' AS expected, '{t}' AS actual, count(*) AS n_rows, "
                         f"count({v}) AS n_values, count(CASE WHEN {ok} THEN 1 END) AS n_fit, "
                         f"count({v}) = count(CASE WHEN {ok} THEN 1 END) AS ok FROM cf")
    return f"WITH {CF_SQL}\n" + "\nUNION ALL ".join(parts)


D01_SQL = _dictionary_sql()


def d02_order_rollup(spark, sf):
    """Per order -- lines, large / small quantity lines, any returned line."""
    li = read_table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    return D.member_rollup(li, "l_orderkey",
                           {"n_large": q >= 25, "n_small": q < 10},
                           {"any_returned": F.col("l_returnflag") == "R"}, size_col="n_lines")


D02_SQL = """SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE l_quantity >= 25) AS BIGINT) AS n_large,
       CAST(count(*) FILTER (WHERE l_quantity < 10) AS BIGINT) AS n_small,
       max(CAST(l_returnflag = 'R' AS INTEGER)) AS any_returned
FROM lineitem GROUP BY l_orderkey"""


def d03_reference_attributes(spark, sf):
    """D3: each customer's first 'signup' event (by time, then id) attached."""
    cust = read_table(spark, sf, "customer").select("c_custkey")
    ev = read_table(spark, sf, "events")
    out = D.attach_reference(cust, ev, "c_custkey", "user_id", F.col("event_type") == "signup",
                             ["event_id", "value"], ["ts", "event_id"])
    return q6(out)


D03_SQL = f"""WITH ref AS (
  SELECT user_id, arg_min(event_id, (ts, event_id)) AS ref_event_id, arg_min(value, (ts, event_id)) AS ref_value
  FROM events WHERE event_type = 'signup' GROUP BY user_id
)
SELECT c.c_custkey, ref.ref_event_id, {sql_q6('ref.ref_value')} AS ref_value
FROM customer c LEFT JOIN ref ON ref.user_id = c.c_custkey"""


def d04_event_rollup(spark, sf):
    """Events per customer (count, distinct types, purchases), 0 when none."""
    cust = read_table(spark, sf, "customer").select("c_custkey")
    ev = read_table(spark, sf, "events")
    r = D.event_rollup(ev, "user_id", "event_type", F.col("event_type") == "purchase")
    return D.merge_rollup(cust, r, "c_custkey", "user_id",
                          ["event_count", "category_unique", "flagged_events"])


D04_SQL = """WITH r AS (
  SELECT user_id, count(*) AS event_count, count(DISTINCT event_type) AS category_unique,
         sum(CAST(event_type = 'purchase' AS BIGINT)) AS flagged_events
  FROM events GROUP BY user_id
)
SELECT c.c_custkey, CAST(coalesce(r.event_count, 0) AS BIGINT) AS event_count,
       CAST(coalesce(r.category_unique, 0) AS BIGINT) AS category_unique,
       CAST(coalesce(r.flagged_events, 0) AS BIGINT) AS flagged_events
FROM customer c LEFT JOIN r ON r.user_id = c.c_custkey"""


def d05_ratio_cleaning(spark, sf):
    """Account balance as a percent-like ratio, / 100 and clipped at 10."""
    c = read_table(spark, sf, "customer")
    return q6(c.select("c_custkey", D.clean_ratio("c_acctbal", 100.0, 10.0).alias("ratio")))


D05_SQL = f"""SELECT c_custkey, {sql_q6(f'least(c_acctbal / {dbl(100)}, {dbl(10)})')} AS ratio FROM customer"""


def d06_banding(spark, sf):
    """Customers per right-closed band of acctbal / 1000."""
    c = read_table(spark, sf, "customer")
    b = D.ratio_band(F.col("c_acctbal") / F.lit(1000.0))
    return c.groupBy(b.alias("band")).agg(F.count(F.lit(1)).alias("n"))


D06_SQL = f"""SELECT CASE WHEN c_acctbal / {dbl(1000)} <= {dbl(1.0)} THEN '<=1.0'
            WHEN c_acctbal / {dbl(1000)} <= {dbl(1.3)} THEN '1.0-1.3'
            WHEN c_acctbal / {dbl(1000)} <= {dbl(2.0)} THEN '1.3-2.0'
            WHEN c_acctbal / {dbl(1000)} <= {dbl(4.0)} THEN '2.0-4.0' ELSE '>4.0' END AS band,
       CAST(count(*) AS BIGINT) AS n
FROM customer GROUP BY 1"""


def d07_label_and_flags(spark, sf):
    """Label from a category set (priority 1 or 2) and an any-of-flags column."""
    o = read_table(spark, sf, "orders")
    code = F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select("o_orderkey", D.label_from_set(code, [1, 2]).alias("label"),
                    D.any_of([F.col("o_orderstatus") == "F", F.col("o_totalprice") > 300000.0,
                              F.col("o_orderpriority") == "1-URGENT"]).alias("any_flag"))


D07_SQL = """SELECT o_orderkey,
       CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) IN (1, 2) AS INTEGER) AS label,
       greatest(CAST(o_orderstatus = 'F' AS INTEGER), CAST(o_totalprice > 300000.0 AS INTEGER),
                CAST(o_orderpriority = '1-URGENT' AS INTEGER), 0) AS any_flag
FROM orders"""


QUERIES = {
    "d01_schema_check": (d01_schema_check, D01_SQL),
    "d02_order_rollup": (d02_order_rollup, D02_SQL),
    "d03_reference_attributes": (d03_reference_attributes, D03_SQL),
    "d04_event_rollup": (d04_event_rollup, D04_SQL),
    "d05_ratio_cleaning": (d05_ratio_cleaning, D05_SQL),
    "d06_banding": (d06_banding, D06_SQL),
    "d07_label_and_flags": (d07_label_and_flags, D07_SQL),
}
