"""All registered queries: importing the modules registers them."""

from . import analytics, collections, extras, filters, incremental, texts, workflows  # noqa: F401
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
