"""All registered queries and their SQL."""

from __future__ import annotations

from fabrichealth.plans import state_queries, stream_queries, verdict_queries, window_queries  # noqa: F401
from fabrichealth.plans.base import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
