"""All queries of the core, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from trackweave.plans import aggregates, joins, problems, scalars, streams, structures

_PARTS = [problems, scalars, joins, aggregates, structures, streams]

FLAGSHIP = "v1_all_hosts"
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
