"""All registered queries."""

from commercelake.plans import commerce, reports, research, streams, texts  # noqa: F401
from commercelake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
