"""All queries on text and their SQL."""

from __future__ import annotations

from factloom.llm import plans

QUERIES = dict(plans.QUERIES)
ORACLES: dict[str, str] = dict(plans.ORACLES)
