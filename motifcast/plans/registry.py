"""Queries of the library's own operators, and the same in SQL."""

from __future__ import annotations

from motifcast.plans import estimates, exact, preparation, reports, workloads

FLAGSHIP = "p4_exact_count"
_MODULES = (exact, estimates, reports, preparation, workloads)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: f for m in _MODULES for name, f in m.ORACLE_SQL.items()}
