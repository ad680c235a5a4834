"""Registered synthesis queries (G1-G13) on ``assigned`` x ``events`` / ``scored``."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskmap.operators import personas as G
from riskmap.operators import targeting as T
from riskmap.plans.common import dbl, q6, sql_q6
from riskmap.plans.evaluation import SCORED_SQL, _quantile_sql
from riskmap.sources import fixtures as fx
from riskmap.sources.tables import read_table

FEATS = ["value", "hour", "is_click"]
N_PERSONAS = 5
CUTS = (0.05, 0.10, 0.20, 0.30, 0.50, 1.00)
TARGET_MODEL = "signal"
PERSONA_NAMES = {0: "Steady browsers", 1: "Evening buyers", 2: "Heavy clickers",
                 3: "Low-value visitors"}

# Naming rules for the event fixture, same structure as the household rules.
EVENT_NAME_RULES = (
    ((("any", (("z", "value", ">", 0.02),)), "High-value"),
     (("any", (("z", "value", "<", -0.02),)), "Low-value")),
    ((("any", (("z", "hour", ">", 0.02),)), "late"),
     (("any", (("z", "hour", "<", -0.02),)), "early")),
    ((("any", (("m", "is_click", ">", 0.21),)), "clickers"),),
)

# ---------------------------------------------------------------------------

ASSIGNED_SQL = """
asg AS (SELECT event_id AS id,
               CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST((event_id * 31) % 7 AS INTEGER) END AS persona,
               CAST(event_id % 3 AS INTEGER) AS cluster FROM events),
pf AS (
  SELECT a.id, a.persona, a.cluster, e.value, CAST(hour(e.ts) AS INTEGER) AS hour,
         CAST(e.event_type = 'click' AS INTEGER) AS is_click
  FROM asg a JOIN events e ON e.event_id = a.id WHERE a.persona IS NOT NULL
)"""

TGT_SQL = f"""{SCORED_SQL}, {ASSIGNED_SQL},
tgt AS (SELECT s.id, s.model, s.y, s.p, a.persona, a.cluster
        FROM scored s JOIN asg a ON a.id = s.id WHERE s.model = '{TARGET_MODEL}')"""


def _profile_frame(spark, sf):
    ev = read_table(spark, sf, "events").select(
        F.col("event_id").alias("id"), "value", F.hour("ts").cast("int").alias("hour"),
        (F.col("event_type") == "click").cast("int").alias("is_click"))
    return fx.assigned(spark, sf).join(ev, on="id", how="inner")


def _targeting(spark, sf):
    s = fx.scored(spark, sf).where(F.col("model") == TARGET_MODEL)
    return T.targeting_table(s, fx.assigned(spark, sf), "id")


def g01_cluster_means(spark, sf):
    return q6(G.cluster_means(_profile_frame(spark, sf), "persona", FEATS))


G01_SQL = f"""WITH {ASSIGNED_SQL}
SELECT persona, {', '.join(f"{sql_q6(f'avg({c})')} AS {c}" for c in FEATS)} FROM pf GROUP BY persona"""


def g02_cluster_sizes(spark, sf):
    return q6(G.cluster_sizes(_profile_frame(spark, sf), "persona"))


G02_SQL = f"""WITH {ASSIGNED_SQL}
SELECT persona, CAST(count(*) AS BIGINT) AS n, {sql_q6('count(*) / sum(count(*)) OVER ()')} AS share
FROM pf GROUP BY persona"""


def g03_crosstab(spark, sf):
    return q6(G.crosstab_long(_profile_frame(spark, sf), "persona", "cluster", [0, 1]))


G03_SQL = f"""WITH {ASSIGNED_SQL},
c AS (SELECT persona, cluster, count(*) AS n FROM pf GROUP BY persona, cluster),
t AS (SELECT persona, sum(n) AS tot FROM c GROUP BY persona),
grid AS (SELECT t.persona, t.tot, l.level FROM t, (VALUES (0), (1)) l(level))
SELECT g.persona, CAST(g.level AS VARCHAR) AS level, {sql_q6('coalesce(c.n, 0) / g.tot')} AS share
FROM grid g LEFT JOIN c ON c.persona = g.persona AND c.cluster = g.level"""


def g04_cluster_table(spark, sf):
    return q6(G.cluster_table(_profile_frame(spark, sf), "persona", FEATS, "cluster", [0, 1], "cluster="))


G04_SQL = f"""WITH {ASSIGNED_SQL}
SELECT persona, {', '.join(f"{sql_q6(f'avg({c})')} AS {c}" for c in FEATS)},
       CAST(count(*) AS BIGINT) AS n, {sql_q6('count(*) / sum(count(*)) OVER ()')} AS share,
       {sql_q6('count(*) FILTER (WHERE cluster = 0) / count(*)')} AS "cluster=0",
       {sql_q6('count(*) FILTER (WHERE cluster = 1) / count(*)')} AS "cluster=1"
FROM pf GROUP BY persona"""


def g05_z_profile(spark, sf):
    z = G.z_profile(_profile_frame(spark, sf), "persona", FEATS)
    return q6(z.unpivot(["persona"], FEATS, "feature", "z"))


def _z_sql():
    ov = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATS)
    parts = " UNION ALL ".join(
        f"SELECT g.persona, '{c}' AS feature, "
        f"{sql_q6(f'(g.{c} - o.m_{c}) / CASE WHEN o.s_{c} = 0 OR o.s_{c} IS NULL THEN 1.0 ELSE o.s_{c} END')} AS z "
        f"FROM g, o" for c in FEATS)
    return f"""WITH {ASSIGNED_SQL},
g AS (SELECT persona, {', '.join(f'avg({c}) AS {c}' for c in FEATS)} FROM pf GROUP BY persona),
o AS (SELECT {ov} FROM pf)
{parts}"""


G05_SQL = _z_sql()


def g06_cluster_names(spark, sf):
    df = _profile_frame(spark, sf)
    z = G.z_profile(df, "persona", FEATS)
    m = G.cluster_means(df, "persona", FEATS)
    names = G.name_clusters(z, m, "persona", rules=EVENT_NAME_RULES)
    return q6(names.join(G.cluster_sizes(df, "persona"), on="persona"))


def _names_sql():
    def cond(t):
        table, col, op, v = t
        x = f"z.{col}" if table == "z" else f"g.{col}"
        return f"{x} {op} {dbl(v)}"
    slots = []
    for slot in EVENT_NAME_RULES:
        whens = " ".join(
            f"WHEN {(' OR ' if mode == 'any' else ' AND ').join(cond(t) for t in terms)} THEN '{frag}'"
            for (mode, terms), frag in slot)
        slots.append(f"CASE {whens} END")
    joined = f"concat_ws(' ', {', '.join(slots)})"
    named = f"CASE WHEN {joined} = '' THEN 'mixed profile' ELSE {joined} END"
    ov = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATS)
    zc = ", ".join(f"(g.{c} - o.m_{c}) / CASE WHEN o.s_{c} = 0 OR o.s_{c} IS NULL THEN 1.0 ELSE o.s_{c} END AS {c}"
                   for c in FEATS)
    return f"""WITH {ASSIGNED_SQL},
g AS (SELECT persona, {', '.join(f'avg({c}) AS {c}' for c in FEATS)}, count(*) AS n FROM pf GROUP BY persona),
o AS (SELECT {ov} FROM pf),
z AS (SELECT g.persona, {zc} FROM g, o),
nm AS (SELECT g.persona, {named} AS nm, g.n FROM g JOIN z ON z.persona = g.persona)
SELECT persona, upper(substr(nm, 1, 1)) || lower(substr(nm, 2)) AS narrative_name,
       CAST(n AS BIGINT) AS n, {sql_q6('n / sum(n) OVER ()')} AS share FROM nm"""


G06_SQL = _names_sql()


def g07_persona_table(spark, sf):
    df = _profile_frame(spark, sf)
    return q6(G.persona_table(df, "persona", {"click_share": "is_click", "mean_value": "value"},
                              "cluster", [0, 1], "geo-cluster "))


G07_SQL = f"""WITH {ASSIGNED_SQL}
SELECT persona, CAST(count(*) AS BIGINT) AS n, {sql_q6('count(*) / sum(count(*)) OVER ()')} AS share,
       {sql_q6('avg(is_click)')} AS click_share, {sql_q6('avg(value)')} AS mean_value,
       {sql_q6('count(*) FILTER (WHERE cluster = 0) / count(*)')} AS "geo-cluster 0",
       {sql_q6('count(*) FILTER (WHERE cluster = 1) / count(*)')} AS "geo-cluster 1"
FROM pf GROUP BY persona"""


def g08_value_shares(spark, sf):
    return q6(T.value_shares(fx.assigned(spark, sf), "persona"))


G08_SQL = f"""WITH {ASSIGNED_SQL}
SELECT persona, CAST(count(*) AS BIGINT) AS n, {sql_q6('count(*) / sum(count(*)) OVER ()')} AS share
FROM asg WHERE persona IS NOT NULL GROUP BY persona"""


def g09_persona_names(spark, sf):
    sizes = T.value_shares(fx.assigned(spark, sf), "persona")
    return q6(T.attach_names(sizes, "persona", PERSONA_NAMES))


G09_SQL = f"""WITH {ASSIGNED_SQL},
lut(persona, name) AS (VALUES {', '.join(f"({k}, '{v}')" for k, v in PERSONA_NAMES.items())}),
s AS (SELECT persona, count(*) AS n FROM asg WHERE persona IS NOT NULL GROUP BY persona)
SELECT s.persona, CAST(s.n AS BIGINT) AS n, {sql_q6('s.n / sum(s.n) OVER ()')} AS share,
       coalesce(lut.name, '?') AS name
FROM s LEFT JOIN lut ON lut.persona = s.persona"""


def g10_targeting_table(spark, sf):
    return q6(_targeting(spark, sf).select("id", "p", "persona", "y"))


G10_SQL = f"""WITH {TGT_SQL}
SELECT id, {sql_q6('p')} AS p, persona, y FROM tgt"""


def g11_persona_mix_at_cuts(spark, sf):
    return q6(T.persona_mix_at_cuts(_targeting(spark, sf), CUTS, N_PERSONAS))


def _mix_sql():
    vals = ", ".join(f"({dbl(c)}, {dbl(1 - c)})" for c in CUTS)
    shares = ", ".join(
        f"{sql_q6(f'CASE WHEN count(*) = 0 THEN 0.0 ELSE count(*) FILTER (WHERE t.persona = {i}) / count(*) END')} AS P{i}"
        for i in range(N_PERSONAS))
    return f"""WITH {TGT_SQL}, {_quantile_sql(vals, 'tgt')},
cut AS (SELECT key AS cut, CASE WHEN key >= 1.0 THEN CAST('-inf' AS DOUBLE) ELSE value END AS thr FROM quant),
pos AS (SELECT sum(y) AS pos FROM tgt)
SELECT c.cut AS top_share, CAST(count(t.id) AS BIGINT) AS flagged_n,
       {sql_q6('CASE WHEN count(t.id) = 0 THEN 0.0 ELSE sum(t.y) / count(t.id) END')} AS precision,
       {sql_q6('coalesce(sum(t.y), 0) / greatest(max(pos.pos), 1)')} AS recall, {shares}
FROM cut c JOIN tgt t ON t.p >= c.thr JOIN pos ON TRUE GROUP BY c.cut"""


G11_SQL = _mix_sql()


def g12_precision_recall_vs_fraction(spark, sf):
    return q6(T.precision_recall_vs_fraction(_targeting(spark, sf)))


def _prf_sql():
    fr = T.fraction_grid()
    vals = ", ".join(f"({dbl(f)}, {dbl(1 - f)})" for f in fr)
    return f"""WITH {TGT_SQL}, {_quantile_sql(vals, 'tgt')},
pos AS (SELECT sum(y) AS pos FROM tgt)
SELECT q.key AS fraction, {sql_q6('q.value')} AS threshold, CAST(count(t.id) AS BIGINT) AS flagged_n,
       {sql_q6('coalesce(sum(t.y), 0) / greatest(count(t.id), 1)')} AS precision,
       {sql_q6('coalesce(sum(t.y), 0) / greatest(max(pos.pos), 1)')} AS recall
FROM quant q JOIN tgt t ON t.p >= q.value JOIN pos ON TRUE GROUP BY q.key, q.value"""


G12_SQL = _prf_sql()


def g13_persona_targeting_summary(spark, sf):
    return q6(T.persona_targeting_summary(_targeting(spark, sf), N_PERSONAS, 0.90, PERSONA_NAMES,
                                          positives_name="food_insecure_share", top_name="top10pct_share"))


def _summary_sql():
    return f"""WITH {TGT_SQL}, {_quantile_sql(f"(0, {dbl(0.9)})", 'tgt')},
lut(pid, name) AS (VALUES {', '.join(f"({k}, '{v}')" for k, v in PERSONA_NAMES.items())}),
top AS (SELECT t.* FROM tgt t JOIN quant q ON t.p >= q.value),
tot AS (SELECT count(*) AS n, sum(y) AS pos, (SELECT count(*) FROM top) AS top_n FROM tgt),
per AS (
  SELECT p.pid, count(t.id) AS n, coalesce(sum(t.y), 0) AS pos, avg(t.p) AS mp,
         (SELECT count(*) FROM top WHERE top.persona = p.pid) AS top_n
  FROM range(0, {N_PERSONAS}) p(pid) LEFT JOIN tgt t ON t.persona = p.pid GROUP BY p.pid
)
SELECT 'P' || CAST(per.pid AS VARCHAR) AS persona,
       {sql_q6('per.n / tot.n')} AS population_share,
       {sql_q6('per.pos / greatest(tot.pos, 1)')} AS food_insecure_share,
       {sql_q6('per.mp')} AS mean_pred_proba,
       {sql_q6('per.top_n / greatest(tot.top_n, 1)')} AS top10pct_share,
       coalesce(lut.name, '?') AS name
FROM per JOIN tot ON TRUE LEFT JOIN lut ON lut.pid = per.pid"""


G13_SQL = _summary_sql()


QUERIES = {
    "g01_cluster_means": (g01_cluster_means, G01_SQL),
    "g02_cluster_sizes": (g02_cluster_sizes, G02_SQL),
    "g03_crosstab": (g03_crosstab, G03_SQL),
    "g04_cluster_table": (g04_cluster_table, G04_SQL),
    "g05_z_profile": (g05_z_profile, G05_SQL),
    "g06_cluster_names": (g06_cluster_names, G06_SQL),
    "g07_persona_table": (g07_persona_table, G07_SQL),
    "g08_value_shares": (g08_value_shares, G08_SQL),
    "g09_persona_names": (g09_persona_names, G09_SQL),
    "g10_targeting_table": (g10_targeting_table, G10_SQL),
    "g11_persona_mix_at_cuts": (g11_persona_mix_at_cuts, G11_SQL),
    "g12_precision_recall_vs_fraction": (g12_precision_recall_vs_fraction, G12_SQL),
    "g13_persona_targeting_summary": (g13_persona_targeting_summary, G13_SQL),
}
