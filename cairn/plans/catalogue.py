"""All queries of the engine and the SQL to hold them against."""

from __future__ import annotations

from cairn.plans import chain, economy, forks, ledger, live, more, proofs, records, storage, streams, sync  # noqa: F401  these register their queries
from cairn.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
