"""Plan shape: one exchange for all feature windows, pushed filters, no Python outside
the bounded model helpers."""

import pytest

from conftest import SF_SMALL


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def entry(spark):
    import __spark_entry__ as E
    return E.queries()


def test_features_single_exchange(spark, entry):
    from tickscope.operators.features import build_features
    from tickscope.plans.fixtures import daily_bars
    p = plan_text(build_features(daily_bars(spark, SF_SMALL)))
    # one shuffle serves all twelve feature windows (plus none for the stats job)
    assert p.count("Exchange hashpartitioning") == 1
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_range_filter_reaches_scan(spark, entry):
    p = plan_text(entry["bars_range"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(Date), GreaterThanOrEqual(Date" in p


def test_selection_prunes_partitions(spark, entry):
    p = plan_text(entry["portfolio_filter"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(ticker" in p or "PartitionFilters: [ticker" in p


def test_scoring_neither_multiplies_nor_regroups_rows(spark, entry):
    entry["detect"](spark, SF_SMALL)          # trains and stores the models once
    from tickscope.operators import iforest
    from tickscope.operators.detect import scored_features
    from tickscope.plans.fixtures import hourly_bars, hourly_models
    scaled, models, _ = scored_features(hourly_bars(spark, SF_SMALL), models=hourly_models(spark, SF_SMALL), with_baseline=False)
    p = plan_text(iforest.score(scaled, models.forest, keep=[]))
    assert "FlatMapCoGroupsInArrow" in p and "CartesianProduct" not in p
    assert "hashpartitioning(ticker" in p and ", Date" not in "".join(x.split(")")[0] for x in p.split("hashpartitioning(")[1:])


def test_live_scoring_reads_only_the_tickers_asked_for(spark, entry):
    """Stored models of many tickers are cut to the batch's before they meet it; no hint broadcasts them."""
    from tickscope.operators import live as L
    from tickscope.plans.fixtures import daily_bars, daily_models
    models = daily_models(spark, SF_SMALL)
    one = daily_bars(spark, SF_SMALL).filter("ticker = 'A'")
    out = L.live_scores(one, models.scaler, models.forest, None, lookback_days=4000, min_bars=0)
    assert "LeftSemi" in plan_text(out) and "ResolvedHint" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.ticker for r in out.collect()] == ["A"]


def test_top_k_is_partial_before_shuffle(spark, entry):
    p = plan_text(entry["recent_bars"](spark, SF_SMALL))
    assert "WindowGroupLimit" in p and "Partial" in p
