"""The whole chain: fitted scores of everybody x fitted personas -> profiles, names and
targeting tables (M10 x K14 -> G1, G5, G6, G10-G13).

The inputs are fitted models, so there is no DuckDB twin; tests check that every id
appears once and that shares add up.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmap.operators import models as M
from riskmap.operators import personas as G
from riskmap.operators import targeting as T
from riskmap.plans.common import q6
from riskmap.plans.prediction import matrix, prepared
from riskmap.plans.segmentation import PERSONA_CAP, k14_assign_personas
from riskmap.plans.synthesis import CUTS
from riskmap.spec import CUSTOMER_PROFILE

# Naming rules for the customer table, same structure as the household rules.
CUSTOMER_NAME_RULES = (
    ((("any", (("z", "n_orders", ">", 0.3),)), "Frequent"),
     (("any", (("z", "n_orders", "<", -0.3),)), "Occasional")),
    ((("any", (("z", "avg_qty", ">", 0.2),)), "bulk buyers"),
     (("any", (("z", "avg_qty", "<", -0.2),)), "small-basket buyers")),
    ((("any", (("m", "any_urgent", ">", 0.9),)), "in a hurry"),),
)


def _table(spark, sf):
    """Every customer once, with the fitted score, the persona and the truth."""
    p = prepared(spark, sf)
    train = M.with_label(p.train)
    model = M.fit_pipeline(p.fm, M.lr_family(), {"C": 1.0}, train, weight_sum=float(p.n_train))
    everybody = p.train.drop("fold").unionByName(p.test)
    scores = model.transform(everybody).select("k", "y", M.positive_score("prob").alias("p"))
    return M.materialize(T.targeting_table(scores, k14_assign_personas(spark, sf).select("k", "persona"), "k"))


def _profile(spark, sf):
    customers = matrix(spark, sf).cleaned.select("k", *[
        F.col(c).cast("double").alias(c) for c in CUSTOMER_PROFILE])
    return customers.join(k14_assign_personas(spark, sf).select("k", "persona"), "k")


def y01_targeting_table(spark, sf):
    return q6(_table(spark, sf).select("k", "p", "persona", "y"))


def y02_persona_names(spark, sf):
    """G1, G2, G5, G6 of the fitted personas."""
    df = M.materialize(_profile(spark, sf))
    z, means = G.z_profile(df, "persona", CUSTOMER_PROFILE), G.cluster_means(df, "persona", CUSTOMER_PROFILE)
    names = G.name_clusters(z, means, "persona", rules=CUSTOMER_NAME_RULES)
    return q6(names.join(G.cluster_sizes(df, "persona"), "persona").join(means, "persona"))


def y03_persona_mix_at_cuts(spark, sf):
    return q6(T.persona_mix_at_cuts(_table(spark, sf), CUTS, PERSONA_CAP))


def y04_precision_recall_vs_fraction(spark, sf):
    return q6(T.precision_recall_vs_fraction(_table(spark, sf)))


def y05_persona_targeting_summary(spark, sf):
    return q6(T.persona_targeting_summary(_table(spark, sf), PERSONA_CAP))


QUERIES = {
    "y01_targeting_table": (y01_targeting_table, None),
    "y02_persona_names": (y02_persona_names, None),
    "y03_persona_mix_at_cuts": (y03_persona_mix_at_cuts, None),
    "y04_precision_recall_vs_fraction": (y04_precision_recall_vs_fraction, None),
    "y05_persona_targeting_summary": (y05_persona_targeting_summary, None),
}
