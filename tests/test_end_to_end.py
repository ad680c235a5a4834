"""The fitted chain on the smallest tables."""

import pytest

from riskmap.plans import end_to_end as Y
from riskmap.sources import fixtures as fx


def test_fitted_chain_covers_everybody(spark, sf_small, monkeypatch):
    from riskmap.operators import segment as K
    real = K.kmeans_best_of
    monkeypatch.setattr(K, "kmeans_best_of", lambda df, k, n_init, *a, **kw: real(df, k, 2, *a, **kw))
    ids = {r[0] for r in fx.cust_features(spark, sf_small).select("k").collect()}
    rows = Y.y01_targeting_table(spark, sf_small).collect()
    assert {r.k for r in rows} == ids and len(rows) == len(ids)
    assert all(0 <= r.p <= 1 and 0 <= r.persona < 5 for r in rows)
    mix = {r.top_share: r for r in Y.y03_persona_mix_at_cuts(spark, sf_small).collect()}
    assert mix[1.0].flagged_n == len(ids) and mix[1.0].recall == 1.0
    for r in mix.values():
        assert sum(r[f"P{i}"] for i in range(5)) == pytest.approx(1.0, abs=1e-5)
    summary = Y.y05_persona_targeting_summary(spark, sf_small).collect()
    assert len(summary) == 5
    for share in ("population_share", "positives_share", "top_share"):
        assert sum(r[share] for r in summary) == pytest.approx(1.0, abs=1e-5)
    names = Y.y02_persona_names(spark, sf_small).collect()
    assert sum(r.n for r in names) == len(ids) and all(r.narrative_name for r in names)
