"""Imports every module that registers queries."""

from barlens.plans import (  # noqa: F401
    condition_research, indicator_columns, registry_queries, signal_research, statistics_queries,
    strategy_evaluation, streaming_queries, trade_outcomes,
)
from barlens.plans.catalog import ORACLES, QUERIES  # noqa: F401
