"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from tidemark.queries import (  # noqa: F401
    q_analytics,
    q_combine,
    q_factors,
    q_indicators,
    q_market,
    q_performance,
    q_portfolio,
    q_processing,
    q_reports,
    q_state,
    q_universe,
)
from tidemark.queries.base import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
