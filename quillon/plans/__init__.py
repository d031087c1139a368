"""Named queries. Importing a module of queries registers them."""

from __future__ import annotations

import importlib

MODULES = ("annotation_queries", "inference_queries", "profile_queries", "text_queries", "relational_queries", "analytics_queries", "model_queries", "report_queries")


def _load():
    from quillon.plans import register

    for m in MODULES:
        importlib.import_module(f"quillon.plans.{m}")
    return register


def reference_queries() -> dict:
    return dict(_load().QUERIES)


def reference_oracles() -> dict[str, str]:
    return dict(_load().ORACLES)
