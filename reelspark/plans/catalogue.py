"""All queries of the library's own operators and their SQL, by name."""

from __future__ import annotations

from reelspark.plans import ads, functions, history, recommendation, streams, upkeep

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _plan in (functions, history, recommendation, ads, upkeep, streams):
    QUERIES |= _plan.QUERIES
    ORACLES |= _plan.ORACLES
