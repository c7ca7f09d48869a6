"""Collects the registered queries and their oracle SQL from the plan modules."""

from __future__ import annotations

import importlib

MODULES = (
    "tessera.plans.q_corpus",
    "tessera.plans.q_text",
    "tessera.plans.q_order",
    "tessera.plans.q_tokens",
    "tessera.plans.q_analytics",
    "tessera.plans.q_diag",
    "tessera.plans.q_synth",
    "tessera.plans.q_io",
)


def _load():
    qs, sql = {}, {}
    for m in MODULES:
        mod = importlib.import_module(m)
        qs.update(mod.QUERIES)
        sql.update(mod.ORACLE)
    return qs, sql


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
