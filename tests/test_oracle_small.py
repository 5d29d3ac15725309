"""Registered queries against their DuckDB oracle on the smallest fixture."""

import pytest

from conftest import SF_SMALL
from oracle_check import compare

KEYS = ["bars_hourly", "bars_daily", "features", "scaler", "baseline_scores", "detect",
        "portfolio_summary", "heatmap", "score_corr", "alerts_saved", "live_scores", "stream_bars",
        "detect_status", "live_summary", "deep_kpis", "stream_state_scores", "bars_brands",
        "stream_live", "stream_live_latest", "detect_gate", "detect_gate_rows", "map_gram", "map_kkt", "alerts_live", "alerts_auto",
        "alerts_auto_stale", "alerts_auto_forced", "alert_digest", "alert_digest_saved", "ticker_labels", "score_pivot_wide",
        "portfolio_summary_range", "rolling_rate_range", "normalised_price_range", "kpis_range", "heatmap_range", "live_anomalous"]
#: Keys whose check says nothing if it compares nothing with nothing.
NOT_EMPTY = ["alerts_live", "alerts_auto_stale", "alerts_auto_forced", "live_anomalous", "stream_live", "heatmap_range"]


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, key):
    rep = compare(spark, SF_SMALL, [key])[key]
    assert "error" not in rep, rep
    assert rep["value_match"], rep
    assert key not in NOT_EMPTY or rep["rows"] > 0


def test_every_query_has_a_builder_and_sql():
    import __spark_entry__ as E
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 68


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
