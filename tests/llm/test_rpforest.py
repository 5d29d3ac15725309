import numpy as np
import pytest
from pyspark.sql import types as T

from tickscope.llm import rpforest

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("leaf", T.StringType()), T.StructField("rep", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def naive(rows, threshold=0.9):
    v = {i: np.array(x, float) for i, x in rows}
    unit = np.stack([x / np.linalg.norm(x) for x in v.values()])
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    ids, label = np.array(list(v)), np.array(list(v))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], 1 << 60).min(1))
        if (new == label).all():
            return dict(zip(ids.tolist(), zip(linked.sum(1).tolist(), label.tolist())))
        label = new


def result(out):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}


def cloud(n, seed, d=64):
    """Random vectors, pairs and chains at cosines around the threshold, and one dense clump."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((n, d))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.86, 0.99, (n, 1))
    clump = base[0] + 0.03 * rng.standard_normal((n // 4, d))
    return np.concatenate([base, c * base + np.sqrt(1 - c * c) * other, clump]).astype(np.float32)


@pytest.mark.parametrize("options", [{"leaf_rows": 100}, {"leaf_rows": 60, "block_rows": 40, "sample_rows": 1000}])
def test_links_and_components(spark, docs, options):
    rows = list(enumerate(cloud(1200, 2).tolist()))
    got, want = result(rpforest.embedding_duplicates(frame(spark, rows), **options)), naive([(i, np.float32(v)) for i, v in rows])
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in got)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in got]) > 0.99


def test_links_of_the_table_equal_brute_force(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = naive([(r["vec_id"], r["embedding"]) for r in table.collect()])
    assert result(rpforest.embedding_duplicates(table, leaf_rows=100)) == want


def test_odd_rows(spark, docs):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.01]), (10, [3e38, 0.0]),
            (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [0.0, 1.0]), (7, [1.0, 0.0])]
    out = rpforest.embedding_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r["vec_id"]: r for r in out}
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in (1, 2, 3, 4, 5, 6, 11, 12))
    assert [by[i]["n_links"] for i in (8, 9, 10)] == [4, 4, 4] and {by[i]["component_id"] for i in (7, 8, 9, 10)} == {7}
    assert by[None]["n_links"] == 0 and by[None]["component_id"] is None
    assert rpforest.embedding_duplicates(frame(spark, [])).count() == 0
    assert rpforest.embedding_duplicates(frame(spark, [(1, None)])).count() == 1
