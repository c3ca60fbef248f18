"""All registered queries of the routing engine."""

from prefixlake.plans import queries_extra, queries_more, queries_rib, queries_stats  # noqa: F401  they register
from prefixlake.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
