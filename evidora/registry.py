"""All queries of the library's own operators, by name."""

from evidora.plans import answers, evaluation, relational, retrieval, streams  # noqa: F401  each module registers its queries
from evidora.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
