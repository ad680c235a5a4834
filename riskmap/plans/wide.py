"""Registered queries of the sparse feature matrix (E3, E5, M1) on ``orders``, whose customer
and day columns have a level for every few rows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmap.operators import wide as W
from riskmap.operators.wide import logistic
from riskmap.plans.common import SessionCache, q6, sql_q6
from riskmap.sources.tables import read_table
from riskmap.spec import RoleSpec

NOMINAL = ("customer", "priority", "day")
ORDER_SPEC = RoleSpec(outcome="y", ids=("k",), ordinal=("price",), passthrough=("late",), nominal=NOMINAL)


def wide_orders(spark, sf: str) -> DataFrame:
    """One row per order: finished or not, price (some missing), weekend flag, and three nominal
    columns of which the customer is sometimes missing."""
    k = F.col("o_orderkey")
    return read_table(spark, sf, "orders").select(
        k.alias("k"), (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        F.when(k % 19 != 0, F.col("o_totalprice")).alias("price"),
        F.dayofweek("o_orderdate").isin(1, 7).cast("int").alias("late"),
        F.when(k % 17 != 0, F.col("o_custkey")).alias("customer"), F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


ORDERS_SQL = """
o AS (SELECT o_orderkey AS k, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
             CASE WHEN o_orderkey % 19 <> 0 THEN o_totalprice END AS price,
             CAST(dayofweek(o_orderdate) IN (0, 6) AS INTEGER) AS late,
             coalesce(CAST(CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS VARCHAR), 'unknown') AS customer,
             coalesce(o_orderpriority, 'unknown') AS priority,
             coalesce(strftime(o_orderdate, '%Y-%m-%d'), 'unknown') AS day FROM orders),
lng AS (SELECT k, 'customer' AS feature, customer AS level FROM o UNION ALL SELECT k, 'priority', priority FROM o
        UNION ALL SELECT k, 'day', day FROM o),
lv AS (SELECT feature, level, row_number() OVER (PARTITION BY feature ORDER BY level) - 1 AS index, count(*) AS n
       FROM lng GROUP BY feature, level)"""


class _Wide:
    def __init__(self, spark, sf: str):
        self.rows = wide_orders(spark, sf).persist()
        self.model = W.fit_sparse_features(self.rows, ORDER_SPEC)


_WIDE = SessionCache(_Wide)


def e03_level_index(spark, sf):
    """Every level of three nominal columns, its index in string order and its rows."""
    return _WIDE(spark, sf).model.levels.select("feature", "level", "index", "n")


E03_INDEX_SQL = f"WITH {ORDERS_SQL}\nSELECT feature, level, index, n FROM lv"


def e05_sparse_matrix(spark, sf):
    """E5: stored entries (k, position, value) of every row's sparse vector."""
    w = _WIDE(spark, sf)
    return q6(w.model.to_long(w.rows).withColumn("position", F.col("position").cast("long")))


E05_SPARSE_SQL = f"""WITH {ORDERS_SQL},
sz AS (SELECT feature, count(*) AS size FROM lv GROUP BY feature),
places AS (SELECT 'customer' AS feature, 2 AS start
       UNION ALL SELECT 'priority', 2 + (SELECT size FROM sz WHERE feature = 'customer')
       UNION ALL SELECT 'day', 2 + (SELECT sum(size) FROM sz WHERE feature IN ('customer', 'priority')))
SELECT k, CAST(0 AS BIGINT) AS position, {sql_q6('coalesce(price, (SELECT median(price) FROM o))')} AS value FROM o
UNION ALL SELECT k, 1, CAST(late AS DOUBLE) FROM o
UNION ALL SELECT lng.k, CAST(places.start + lv.index AS BIGINT), 1.0 FROM lng JOIN lv USING (feature, level) JOIN places USING (feature)"""


def m01_sparse_logistic(spark, sf):
    """M1 on the sparse matrix: logistic regression at C = 1 over all levels.  At the optimum
    C * sum (p - y) x + beta is 0 for every column; reported are the rows, the columns,
    and how many columns that holds for."""
    w = _WIDE(spark, sf)
    fitted = w.model.scaled(w.rows)
    data = fitted.transform(w.rows).withColumn("label", F.col("y").cast("double")).persist()
    n = data.count()
    # every task sends a matrix of the narrow columns in every iteration: one task per core
    model = logistic(1.0, float(n), fitted.widest(), tol=1e-10).fit(data.coalesce(spark.sparkContext.defaultParallelism))
    error = (model.transform(data).select("k", (vector_to_array("probability")[1] - F.col("label")).alias("e")))
    sums = (fitted.to_long(w.rows).join(error, "k").groupBy("position").agg(F.sum(F.col("value") * F.col("e")).alias("g")))
    beta = W.coefficient_rows(spark, model)
    data.unpersist()
    settled = F.count(F.when(F.abs(F.coalesce("g", F.lit(0.0)) + F.col("beta")) < 0.05, 1))
    return beta.join(sums, "position", "left").agg(
        F.lit(n).alias("n_rows"), F.count(F.lit(1)).alias("n_columns"), settled.alias("n_settled"))


M01_SPARSE_SQL = f"""WITH {ORDERS_SQL}
SELECT (SELECT count(*) FROM o) AS n_rows, 2 + count(*) AS n_columns, 2 + count(*) AS n_settled FROM lv"""

QUERIES = {
    "e03_level_index": (e03_level_index, E03_INDEX_SQL),
    "e05_sparse_matrix": (e05_sparse_matrix, E05_SPARSE_SQL),
    "m01_sparse_logistic": (m01_sparse_logistic, M01_SPARSE_SQL),
}
