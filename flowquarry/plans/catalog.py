"""All queries, and the SQL of those that SQL can express."""

from __future__ import annotations

from flowquarry.plans import (  # noqa: F401  (each module registers its queries)
    addresses,
    cleaning,
    components,
    evaluation,
    federated,
    preparation,
    profiling,
    sampling,
    sources,
    streaming,
    training,
    windows,
)
from flowquarry.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
