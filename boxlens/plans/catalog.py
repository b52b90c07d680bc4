"""All detection queries and their SQL."""

from __future__ import annotations

from boxlens.plans import cache_plans, detection_plans, evaluation_plans, grammar_plans, registry, scene_plans, stream_plans, training_plans  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
