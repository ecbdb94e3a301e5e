"""All queries of the engine by name, with their DuckDB twins."""

from ..streaming import hourly, joined
from . import audit, causal, choosing, dashboard, decisions, details, intake, learning, lexical, postings, reports, stored, upkeep, weights

_PLANS = (dashboard, learning, audit, decisions, postings, reports, upkeep, causal, choosing, intake, details, weights, stored, lexical, hourly, joined)
QUERIES = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
ORACLE_SQL = {name: sql for plan in _PLANS for name, sql in plan.ORACLE_SQL.items()}
