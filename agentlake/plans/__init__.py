"""Registered queries over the provided tables, each with its SQL twin."""

from __future__ import annotations


def all_queries():
    """``(queries, oracles)`` of every family."""
    from agentlake.plans import (  # noqa: F401
        session_queries,
        rule_queries,
        text_queries,
        fleet_queries,
        token_queries,
        vector_queries,
        source_queries,
        stream_queries,
    )
    from agentlake.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
