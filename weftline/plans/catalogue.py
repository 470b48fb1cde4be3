"""All registered queries of the library (the subpackage for training data has its own)."""

from weftline.plans import aggregates, codec, decisions, described, estate, governance, graph, joins, places, records, statements  # noqa: F401
from weftline.plans.registry import QUERIES

__all__ = ["QUERIES"]
