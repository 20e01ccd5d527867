"""Registry of the analytics queries and their SQL."""

from __future__ import annotations

from ledgersift.plans.oracles import ORACLES
from ledgersift.plans.queries import QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
