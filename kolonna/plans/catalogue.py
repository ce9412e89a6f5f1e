"""The catalogue of queries: one entry an operator, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from kolonna.plans import relational, storage, upkeep
from kolonna.plans.registry import Query

flagship = relational.flagship
QUERIES: dict[str, Query] = relational.QUERIES | storage.QUERIES | upkeep.QUERIES
ORACLES: dict[str, str] = relational.ORACLES | storage.ORACLES | upkeep.ORACLES
