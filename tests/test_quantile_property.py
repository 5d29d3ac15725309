"""Property test: the histogram quantile equals numpy's linear quantile exactly."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickscope.operators.quantile import quantile_by_key

values = st.lists(st.floats(min_value=-0.999, max_value=-0.001, allow_nan=False), min_size=1, max_size=300)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=values, b=values, dup=st.integers(min_value=0, max_value=20),
       q=st.sampled_from([0.0, 0.02, 0.5, 0.98, 1.0]))
def test_grid_quantile_matches_numpy(spark, a, b, dup, q):
    a = a + a[:dup]                                 # ties
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b]
    df = spark.createDataFrame(rows, "ticker string, s double")
    got = {r[0]: r[1] for r in quantile_by_key(df, "s", q).collect()}
    for key, vals in (("a", a), ("b", b)):
        want = float(np.quantile(np.asarray(vals, dtype=float), q, method="linear"))
        assert abs(got[key] - want) <= 1e-15 * max(1.0, abs(want)), (key, got[key], want)
