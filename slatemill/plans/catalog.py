"""Importing the query modules fills the registry."""
from slatemill.plans import q_decisions, q_history, q_joins, q_market, q_metrics, q_models, q_sources, q_spine, q_studies, q_tables  # noqa: F401
from slatemill.plans.registry import ORACLE, QUERIES  # noqa: F401
