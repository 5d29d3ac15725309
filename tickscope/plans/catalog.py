"""All registered queries (importing the query modules fills the registry)."""

from __future__ import annotations

from . import q_alerts, q_core, q_portfolio, q_stream  # noqa: F401
from .registry import REGISTRY, QuerySpec


def all_queries() -> dict[str, QuerySpec]:
    return dict(REGISTRY)
