"""Query bindings on the test snapshot: each is ``(spark, sf_dir) -> DataFrame`` with matching oracle SQL."""

from __future__ import annotations

import importlib

FAMILIES = ["profiling", "relations", "graphs", "texts", "usage_access", "estate", "links", "objects", "counters"]


def _load():
    queries, oracle = {}, {}
    for fam in FAMILIES:
        mod = importlib.import_module(f"lakescope.plans.{fam}")
        queries.update(mod.QUERIES)
        oracle.update(mod.ORACLE)
    return queries, oracle


def all_queries():
    return _load()[0]


def all_oracle_sql():
    return _load()[1]
