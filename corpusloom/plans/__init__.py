"""Registered queries by area."""

from __future__ import annotations

from importlib import import_module

from corpusloom.plans.registry import ORACLES, QUERIES, Query

AREAS = ["sources", "text", "prompting", "joins", "aggregates", "ranking", "sampling", "sequences", "duplicates", "streams", "pipeline"]


def all_queries() -> dict[str, Query]:
    for area in AREAS:
        import_module(f"corpusloom.plans.{area}")
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    all_queries()
    return dict(ORACLES)
