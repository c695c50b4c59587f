"""A choice of registered queries beside their SQL on the smallest tables; ``oracle.py`` runs all."""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = ["after_bullish_bar", "conditions_hourly", "signals_volatility", "barrier_outcomes", "trade_metrics", "walk_forward_summary",
         "sign_flip_test", "upsert", "leakage_scan_documents", "value_at_risk"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_its_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 150


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, connect(SF).sql(entry.oracle_sql()[name]).df()) is None


def test_no_window_runs_in_a_single_partition(spark):
    """No plan moves all rows into one task or multiplies two tables."""
    for name in ("conditions_hourly", "signals_momentum", "barrier_outcomes", "moving_averages", "equity_curve", "campaign_rollup"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan and "CartesianProduct" not in plan, name


def test_every_entry_spec_is_swept(spark):
    """The state machines too have forward statistics, a best variant and a verdict."""
    from barlens.operators import signals
    sql, queries = entry.oracle_sql(), entry.queries()
    got = {n: queries[n](spark, SF).toPandas() for n in ("signal_stats_flips", "sweep_best_variant_flips", "entry_knowledge_flips")}
    for name, rows in got.items():
        assert compare(rows, connect(SF).sql(sql[name]).df()) is None, name
    flips = {s.spec_id for s in signals.catalogue() if "st_dir" in s.long or "psar" in s.long}
    found = set(got["signal_stats_flips"]["spec_id"])
    assert found <= flips and {"SUPERTREND_7_20", "PSAR_2_2"} <= found
    ids = ",".join(sql[n] for n in ("signal_stats", "signal_stats_flips"))
    assert all(s.spec_id in ids for s in signals.catalogue())
