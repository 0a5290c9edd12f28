"""The registered queries and the SQL that gives the same rows."""

from .plans import checks, connectors, merges, scans, streams

_PLANS = (checks, merges, scans, streams, connectors)
QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
SQL: dict = {name: text for plan in _PLANS for name, text in plan.SQL.items()}
