"""Collects the registered queries of every plans module."""

from __future__ import annotations

import importlib

MODULES = (
    "riskmap.plans.evaluation",
    "riskmap.plans.prepare",
    "riskmap.plans.synthesis",
    "riskmap.plans.prediction",
    "riskmap.plans.segmentation",
    "riskmap.plans.rollup",
    "riskmap.plans.wide",
    "riskmap.plans.checks",
    "riskmap.plans.end_to_end",
)


def _all():
    out = {}
    for m in MODULES:
        mod = importlib.import_module(m)
        for name, (fn, sql) in mod.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = (fn, sql)
    return out


def spark_queries():
    return {k: fn for k, (fn, _) in _all().items()}


def oracle_queries():
    return {k: sql for k, (_, sql) in _all().items() if sql is not None}
