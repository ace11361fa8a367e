"""All queries of the core and their SQL."""

from __future__ import annotations

from factloom.plans import connectors, data_ops, facts, flows, measures, queue, relational, scalars, shapes

_PARTS = (data_ops, relational, measures, scalars, flows, shapes, facts, queue, connectors)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
