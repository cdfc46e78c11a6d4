"""All registered queries of the library."""

from quarryline.plans import checks, cleaning, measures, plugins, search, sessions, support, transcripts  # noqa: F401
from quarryline.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
