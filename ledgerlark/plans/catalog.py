"""All registered queries of the engine."""

from __future__ import annotations

from . import boards, flows, kpis, stores, streams  # noqa: F401  registration
from .star import REGISTRY


def queries() -> dict:
    return {k: q.build for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in REGISTRY.items() if q.sql}
