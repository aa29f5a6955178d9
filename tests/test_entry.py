"""Driver contract: entry smoke, registry shape, and a sample of oracle comparisons."""

import os
import sys

import pytest

from conftest import SF001, SF01

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["label", "value"]


def test_every_oracle_key_is_a_query():
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["q_month_revenue", "q_pie_others", "q_rfm", "q_abc", "q_backtest", "q_money_clean"])
def test_oracle_matches(spark, name):
    from oracle_compare import compare

    res = compare(spark, SF01, [name], verbose=False)
    assert res[name][0] == "match", res[name]


def test_smoke_all_queries_on_sf0001(spark):
    """Every registered query runs on the smallest tables."""
    import __spark_entry__ as E

    skip = {"q_forecast", "q_forecast_log", "q_signals", "q_model_stats", "q_kmeans"}  # heavy, covered elsewhere
    for name, fn in E.queries().items():
        if name in skip:
            continue
        fn(spark, SF001).limit(5).collect()
