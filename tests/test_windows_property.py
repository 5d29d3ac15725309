"""Property test: chunked windows with the halo fix-up equal the plain per-series plan."""

import datetime as dt

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import make_bars
from tickscope.operators.features import build_features
from tickscope.operators.windows import SeriesStats
from tickscope.schemas import FEATURE_COLS_ALL


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(lengths=st.lists(st.integers(min_value=1, max_value=180), min_size=1, max_size=3),
       gaps=st.lists(st.integers(min_value=1, max_value=9), min_size=1, max_size=12),
       chunk_days=st.integers(min_value=1, max_value=120), seed=st.integers(0, 10_000))
def test_chunked_equals_plain(spark, lengths, gaps, chunk_days, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for s, n in enumerate(lengths):
        t = dt.datetime(2020, 1, 1)
        close = 100.0
        for i in range(n):
            t += dt.timedelta(days=gaps[i % len(gaps)])          # irregular gaps
            close *= float(np.exp(rng.normal(0, 0.02)))
            rows.append((f"S{s}", t.isoformat(sep=" "), close, close * 1.01, close * 0.99, close,
                         float(rng.integers(1, 1000))))
    bars = make_bars(spark, rows)
    total = sum(lengths)
    plain = build_features(bars, SeriesStats(len(lengths), max(lengths), 0, total)).toPandas()
    # cells of a day, chunks of chunk_days counted bars
    chunked = build_features(bars, SeriesStats(len(lengths), max(lengths), 86_400_000_000, total, chunk_days)).toPandas()
    a = plain.sort_values(["ticker", "Date"]).reset_index(drop=True)
    b = chunked.sort_values(["ticker", "Date"]).reset_index(drop=True)
    assert len(a) == len(b)
    for c in FEATURE_COLS_ALL:
        np.testing.assert_allclose(a[c].to_numpy(), b[c].to_numpy(), rtol=1e-9, atol=1e-12)
