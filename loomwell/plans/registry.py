"""All registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from loomwell.plans import audits, corpus, generation, retrieval, statistics, verification
from loomwell.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audits", "corpus", "generation", "retrieval", "statistics", "verification"]
