"""Analysis inputs derived from the driver's tables.

* ``cust_features`` -- the household-table analogue, one row per customer,
  built with joins and roll-ups (D2-D4 shaped), and seeded with sentinel
  codes, refusals, nulls and a near-constant column so that every cleaning
  rule has something to do.
* ``scored`` -- (id, model, y, p) long table from ``events``: several score
  columns with known tie structure for the evaluation operators.
* ``assigned`` -- (id, persona, cluster) for the targeting operators.
* ``labelings`` -- (id, run, label) clusterings of ``embeddings`` for ARI.
* ``embedding_vectors`` -- ``embeddings`` as ``array<double>`` / Vector.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmap.sources.tables import read_table

RET_SHARE_CUT = 0.375
LINES_PER_TASK = 500_000


def balance_band(x):
    """Right-closed bands of a ratio-like value."""
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(x <= 1.0, "<=1.0").when(x <= 1.3, "1.0-1.3")
            .when(x <= 2.0, "1.3-2.0").when(x <= 4.0, "2.0-4.0")
            .otherwise(">4.0"))


def rollup_tasks(lineitem: DataFrame) -> int | None:
    """Tasks of about ``LINES_PER_TASK`` lines each; None where one task would do."""
    lines = lineitem.count()
    if lines <= LINES_PER_TASK:
        return None
    return max(lineitem.sparkSession.sparkContext.defaultParallelism, math.ceil(lines / LINES_PER_TASK))


def order_rollup(orders: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per-customer order roll-up (orders alone), dealt by customer over ``tasks``."""
    orders = orders.select("o_custkey", "o_totalprice", "o_orderpriority")
    if tasks:
        orders = orders.repartition(tasks, "o_custkey")
    return orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.max("o_totalprice").alias("max_price"),
        F.max(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"))


def line_rollup(orders: DataFrame, lineitem: DataFrame, tasks: int | None = None) -> DataFrame:
    """Per-customer line roll-up: orders inner-joined to lines, so an order
    without lines adds no line.  Where there are more lines than one task should sort
    and group, the join and the groups are dealt over ``tasks``, about ``LINES_PER_TASK``
    lines each, so that tasks grow in number and not in size.  Dealt by customer, the
    (customer, part) pairs and the customers meet without another shuffle; a group is
    hashed, so a customer with many lines takes time and not memory."""
    o = orders.select("o_orderkey", "o_custkey")
    li = lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag")
    tasks = tasks or rollup_tasks(lineitem)
    if tasks:
        o, li = o.repartition(tasks, "o_orderkey"), li.repartition(tasks, "l_orderkey")
    j = o.join(li, o["o_orderkey"] == li["l_orderkey"], "inner")
    if tasks:
        j = j.repartition(tasks, "o_custkey")
    return j.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_distinct("l_partkey").alias("n_parts"),
        F.avg("l_discount").alias("avg_disc"),
        F.avg("l_quantity").alias("avg_qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_ret"))


def cust_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, keyed by ``k``; see FIXTURES.md for the rules."""
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation and region are tiny dimension tables (25 and 5 rows)
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    orders = read_table(spark, sf_dir, "orders")
    lineitem = read_table(spark, sf_dir, "lineitem")
    geo = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        "n_nationkey", "n_name", "r_name")
    base = cust.join(F.broadcast(geo), cust["c_nationkey"] == geo["n_nationkey"], "left")
    k = F.col("c_custkey")
    tasks = rollup_tasks(lineitem)
    if tasks:       # the joins find all three sides dealt alike
        base = base.repartition(tasks, "c_custkey")
    df = (base.join(order_rollup(orders, tasks), base["c_custkey"] == F.col("k"), "left").drop("k")
              .join(line_rollup(orders, lineitem, tasks), k == F.col("k"), "left").drop("k"))
    ret_share = F.col("n_ret") / F.col("n_lines")
    price = F.col("max_price") / F.lit(1000.0)
    acct = F.col("c_acctbal")
    return df.select(
        k.alias("k"),
        F.coalesce((ret_share > RET_SHARE_CUT).cast("int"), F.lit(0)).alias("y"),
        ret_share.alias("ret_share"),
        F.when(k % 11 == 0, F.lit(-997.0)).when(k % 13 == 0, F.lit(-996.0))
         .otherwise(acct).alias("acctbal_s"),
        F.when(k % 17 == 0, F.lit("R")).otherwise(F.col("c_mktsegment")).alias("segment_r"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        balance_band(acct / F.lit(1000.0)).alias("balance_band"),
        F.coalesce(F.col("n_orders"), F.lit(0)).cast("long").alias("n_orders"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col("n_parts"), F.lit(0)).cast("long").alias("n_parts"),
        F.coalesce(F.col("any_urgent"), F.lit(False)).alias("any_urgent"),
        F.when(k % 19 == 0, F.lit(None).cast("double"))
         .when(k % 23 == 0, -price).otherwise(price).alias("dist_like"),
        F.col("avg_disc"), F.col("avg_qty"),
        F.when(k % 500 == 0, 1).otherwise(0).alias("near_const"),
        (F.lit(1.0) + (k % 3)).cast("double").alias("w"),
        (acct / F.lit(1000.0)).alias("profile_only"),
    )


# fixed score definitions for the evaluation fixture
SCORE_MODELS = ("smooth", "ties", "signal")


def scored(spark: SparkSession, sf_dir: str, with_constant: bool = False) -> DataFrame:
    """(id, model, y, p): one scan of ``events``, models exploded per row."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    eid = F.col("event_id")
    y = (F.col("event_type") == "purchase").cast("int")
    models = [
        ("smooth", F.col("value") / (F.col("value") + F.lit(50.0))),
        ("ties", ((eid * 37) % 100).cast("double") / F.lit(100.0)),
        ("signal", F.lit(0.25) * y.cast("double")
         + ((eid * 7919) % 1000).cast("double") / F.lit(1333.0)),
    ]
    if with_constant:
        models.append(("constant", F.lit(0.5)))
    arr = F.array(*[F.struct(F.lit(m).alias("model"), p.cast("double").alias("p"))
                    for m, p in models])
    return ev.select(eid.alias("id"), y.alias("y"), F.explode(arr).alias("s")).select(
        "id", "s.model", "y", "s.p")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, persona, cluster) assignment fixture: personas 0-6, some rows without one,
    so reports that list five personas meet unlisted and null ones; clusters 0-2."""
    ev = read_table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id")
    persona = F.when(eid % 97 != 0, ((eid * 31) % 7).cast("int"))
    return ev.select(eid.alias("id"), persona.alias("persona"), (eid % 3).cast("int").alias("cluster"))


def labelings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, run, label): four clusterings of the embeddings, one scan."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    lab = F.col("label")
    runs = F.array(
        F.struct(F.lit(0).alias("run"), lab.alias("label")),
        F.struct(F.lit(1).alias("run"), ((lab + 3) % 10).alias("label")),
        F.struct(F.lit(2).alias("run"), F.floor(lab / 2).cast("int").alias("label")),
        F.struct(F.lit(3).alias("run"), (F.col("vec_id") % 10).cast("int").alias("label")))
    return e.select(F.col("vec_id").alias("id"), F.explode(runs).alias("r")).select(
        "id", "r.run", "r.label")


def embedding_vectors(spark: SparkSession, sf_dir: str, as_vector: bool = True) -> DataFrame:
    """(id, label, features) with the 64-d embedding as doubles."""
    e = read_table(spark, sf_dir, "embeddings")
    arr = F.transform("embedding", lambda x: x.cast("double"))
    out = e.select(F.col("vec_id").alias("id"), "label", arr.alias("emb"))
    if as_vector:
        out = out.select("id", "label", array_to_vector("emb").alias("features"))
    return out
