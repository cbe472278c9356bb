"""All registered queries of the study chain."""

from stillwater.plans import flagships, relational, scalar_queries, support  # noqa: F401, I001
from stillwater.plans import contracts  # noqa: F401  (after those whose parts it uses)
from stillwater.plans import audits, streams  # noqa: F401
from stillwater.plans.fixtures import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
