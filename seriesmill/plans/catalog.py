"""All registered queries."""

from __future__ import annotations

import importlib

from seriesmill.plans import registry

MODULES = ("store_queries", "feature_queries", "metric_queries", "policy_queries", "split_queries", "model_queries", "check_queries", "fold_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"seriesmill.plans.{name}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
