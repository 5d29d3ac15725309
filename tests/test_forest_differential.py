"""Differential test: Spark forest + scores vs the DuckDB level-by-level SQL on random bars."""

import os
import tempfile

import duckdb
import numpy as np
import pytest

from conftest import make_bars, series
from tickscope.operators import iforest
from tickscope.operators.features import build_features
from tickscope.operators.scaler import apply_scaler, fit_scaler
from tickscope.plans import oracle as O


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forest_matches_sql(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(2):
        n = int(rng.integers(60, 400))
        closes = list(100 * np.exp(np.cumsum(rng.standard_t(3, n) * 0.01)))
        vols = [float(v) for v in rng.integers(1, 5000, n)]
        rows += series(f"T{s}", closes, vols)
    bars = make_bars(spark, rows)
    path = os.path.join(tempfile.mkdtemp(prefix="tickscope-diff-"), "bars")
    bars.write.parquet(path)
    bars = spark.read.parquet(path)
    n_trees = 40
    feat = build_features(bars)
    scaled = apply_scaler(feat, fit_scaler(feat), n_series=2)
    forest = iforest.fit_forest(scaled, n_trees=n_trees, n_series=2)
    got = (iforest.score(scaled, forest, keep=[]).toPandas()
           .sort_values(["ticker", "Date"]).reset_index(drop=True))
    splits = int(forest.agg({"n_splits": "sum"}).first()[0])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW raw AS SELECT * FROM read_parquet('{path}/*.parquet')")
    ctes = ["bars AS (SELECT * FROM raw)", *O.features("bars", "features"), *O.scaler("features"),
            *O.scaled("features"), *O.forest("scaled", "fo", n_trees), *O.score("scaled", "fo", "scores", n_trees)]
    want = con.execute(O.with_(ctes, 'SELECT ticker, "Date", if_score FROM scores ORDER BY ticker, "Date"')).df()
    want_splits = con.execute(O.with_(ctes, "SELECT count(*) FROM fo_splits")).fetchone()[0]
    assert splits == want_splits
    assert len(got) == len(want)
    np.testing.assert_allclose(got.if_score.to_numpy(), want.if_score.to_numpy(), rtol=0, atol=1e-12)
