"""Isolation forest, fitted and scored as Spark jobs.

Randomness is a hash of (seed, ticker, tree, node or row key), so a fit is a
pure function of the data and the seed (and the SQL oracle reproduces it).

Fit
  * per series: n rows, psi = min(max_samples, n), depth limit ceil(log2(psi));
  * sample: each tree takes the psi rows with the smallest (row, tree) key. A row is offered to a tree
    only if its key is below (psi + SLACK sqrt(psi))/n: about that many candidates per tree reach the shuffle
    instead of n, and a partial top-psi (window group limit) runs before it. The sample is the same
    as without that filter if a tree gets psi candidates; the trees that fall short are counted and redone without it;
  * growth: groups of TREES_PER_TASK trees of one ticker (at most 25*psi rows, a
    bounded group whatever the series length) are grown by a small numpy helper
    in ``applyInPandas``: a node splits when it holds more than one row, is above
    the depth limit and some feature varies by more than 1e-7; feature =
    hash-chosen among the varying ones, threshold = uniform in [min, max); rows
    with value <= threshold go left (child 2i+1), the rest right (2i+2).
Model
  one row per (ticker, tree): ``f``/``v`` arrays (split feature/threshold for the
  2^D-1 inner slots of a full depth-D tree, D = max(8, ceil(log2(psi))); leaves above depth D send rows down
  their leftmost branch) and ``hb`` (path length for the 2^D bottom slots).
Score
  a ticker's rows are dealt into blocks of about BLOCK_ROWS by a hash of their time and meet the ticker's trees
  there (a cogroup: the trees travel once a block, rows are neither multiplied nor regrouped). A numpy walk
  takes a block's rows down all trees at once; score = -2^(-E[h] / c(psi)) (lower = more unusual).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.exprs import TWO_POW_32, avg_path_length_py, row_key, unit_hash
from ..schemas import KEY, MAX_SAMPLES, MODEL_FEATURES, N_TREES, SEED, TIME
from .joins import join_small

MAX_DEPTH = 8                      # ceil(log2(256)): trees have at least so many levels of slots
MOST_DEPTH = 16                    # of a tree over max_samples rows; more would make models of many MB a ticker
INNER_SLOTS = 2 ** MAX_DEPTH - 1   # 255
LEAF_SLOTS = 2 ** MAX_DEPTH        # 256
MIX_PRIME = 2147483647           # 2^31 - 1
# A feature whose range in a node is at most this is treated as constant.
FEATURE_THRESHOLD = 1e-7
# Standard deviations by which the expected number of a tree's candidates passes psi.
SLACK = 6.0
# Rows of a ticker that are scored together.
BLOCK_ROWS = 50_000


def _depth_limit(psi):
    """ceil(log2(max(psi, 2))) with integer comparisons only."""
    expr = F.lit(MOST_DEPTH)
    for d in range(MOST_DEPTH - 1, 0, -1):
        expr = F.when(psi <= 2 ** d, F.lit(d)).otherwise(expr)
    return expr


def slots(psi: int) -> tuple[int, int]:
    """Levels of a tree over psi rows, and its bottom slots; it has one inner slot less."""
    depth = max(MAX_DEPTH, (psi - 1).bit_length())
    return depth, 2 ** depth


def series_sizes(scaled: DataFrame, max_samples: int = MAX_SAMPLES) -> DataFrame:
    if max_samples > 2 ** MOST_DEPTH:
        raise ValueError(f"max_samples of at most {2 ** MOST_DEPTH}")
    n = F.count(F.lit(1))
    return (scaled.groupBy(KEY).agg(n.alias("n"))
            .withColumn("psi", F.least(F.col("n"), F.lit(max_samples)))
            .withColumn("depth_limit", _depth_limit(F.col("psi"))))


def _hash_below(limit: int, *parts) -> Column:
    """A hashed integer in [0, limit)."""
    return (unit_hash(*parts) * F.lit(TWO_POW_32)).cast("long") % F.lit(limit)


def tree_coefficients(n_trees: int, seed: int) -> Column:
    """Per ticker: (multiplier, addend) of every tree, each hashed from (seed, ticker, tree)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(
        (_hash_below(MIX_PRIME - 1, seed, F.lit("mul"), F.col(KEY), t) + 1).alias("a"),
        _hash_below(MIX_PRIME, seed, F.lit("add"), F.col(KEY), t).alias("b")))


def tree_key(h1: Column, h2: Column, a: Column, b: Column) -> Column:
    """Uniform [0, 1) key of (row, tree) from two hashes of the row and the tree's own coefficients: exact integer
    arithmetic modulo the prime 2^31-1, written identically in the oracle."""
    x = (h1 * a + b) % F.lit(MIX_PRIME)
    return (((x * x) % F.lit(MIX_PRIME) * F.lit(48271) + h2) % F.lit(MIX_PRIME)).cast("double") / F.lit(float(MIX_PRIME))


def _keyed(scaled: DataFrame, trees: DataFrame, seed: int, n_series: int | None, n_trees: int = N_TREES) -> DataFrame:
    """(ticker, rk, x, psi, depth_limit, n, t, u): rows x their trees; ``trees`` holds a list of (t, a, b) a ticker."""
    d = join_small(scaled.select(KEY, TIME, "x"), trees, KEY, n_series, items=n_trees).withColumn("rk", row_key(F.col(TIME)))
    d = d.withColumn("_h1", _hash_below(MIX_PRIME, seed, F.lit("row"), F.col(KEY), F.col("rk")))
    d = d.withColumn("_h2", _hash_below(MIX_PRIME, seed, F.lit("tie"), F.col(KEY), F.col("rk")))
    d = d.select(KEY, "rk", "x", "psi", "depth_limit", "n", "_h1", "_h2", F.explode("trees").alias("_t"))
    return d.withColumn("u", tree_key(F.col("_h1"), F.col("_h2"), F.col("_t.a"), F.col("_t.b"))).withColumn("t", F.col("_t.t"))


def _smallest(keyed: DataFrame) -> DataFrame:
    w = Window.partitionBy(KEY, "t").orderBy("u", "rk")
    return (keyed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.col("psi"))
            .select(KEY, "t", "x", "psi", "depth_limit"))


def all_trees(sizes: DataFrame, n_trees: int, seed: int) -> DataFrame:
    """sizes with ``trees``: every tree's number and coefficients."""
    numbered = F.transform(tree_coefficients(n_trees, seed), lambda c, t: F.struct(t.alias("t"), c["a"].alias("a"), c["b"].alias("b")))
    return sizes.withColumn("trees", numbered)


def sample_rows(scaled: DataFrame, trees: DataFrame, seed: int = SEED, n_series: int | None = None, n_trees: int = N_TREES) -> DataFrame:
    """(ticker, t, x, psi, depth_limit): up to psi sampled rows per tree, from the rows whose key is small."""
    n, psi = F.col("n").cast("double"), F.col("psi").cast("double")
    q = (psi + F.lit(SLACK) * F.sqrt(psi)) / n
    return _smallest(_keyed(scaled, trees, seed, n_series, n_trees).filter(F.col("u") < q))


TREE_SCHEMA = ("ticker string, t int, psi long, f array<int>, v array<double>, "
               "hb array<double>, n_splits int, n_leaves int, n_rows long")


def _node_uniform(seed: int, tag: str, ticker: str, t: int, node: int) -> float:
    digest = hashlib.md5(f"{seed}|{tag}|{ticker}|{t}|{node}".encode()).hexdigest()
    return int(digest[:8], 16) / TWO_POW_32


def _grow_tree(x: np.ndarray, ticker: str, t: int, depth_limit: int, seed: int, psi: int = MAX_SAMPLES):
    """Arrays f, v (inner slots) and hb (bottom slots) of one tree over <= psi rows."""
    levels, bottom = slots(psi)
    f = np.zeros(bottom - 1, dtype=np.int32)
    v = np.full(bottom - 1, np.inf)
    hb = np.zeros(bottom)
    n_splits = n_leaves = 0
    stack = [(0, 0, np.arange(x.shape[0]))]
    while stack:
        node, depth, idx = stack.pop()
        sub = x[idx]
        split = False
        if len(idx) > 1 and depth < depth_limit:
            lo, hi = sub.min(axis=0), sub.max(axis=0)
            varying = np.flatnonzero(hi > lo + FEATURE_THRESHOLD)
            if varying.size:
                uf = _node_uniform(seed, "feat", ticker, t, node)
                j = int(varying[int(np.floor(uf * varying.size))])
                uv = _node_uniform(seed, "thr", ticker, t, node)
                thr = lo[j] + uv * (hi[j] - lo[j])
                f[node], v[node] = j, thr
                left = sub[:, j] <= thr
                stack.append((2 * node + 1, depth + 1, idx[left]))
                stack.append((2 * node + 2, depth + 1, idx[~left]))
                split = True
                n_splits += 1
        if not split:
            slot = (node + 1) * 2 ** (levels - depth) - bottom
            hb[slot] = depth + avg_path_length_py(len(idx))
            n_leaves += 1
    return f, v, hb, n_splits, n_leaves


def _grow_group(seed: int, n_features: int):
    xcols = [f"_x{j}" for j in range(n_features)]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        x_all = pdf[xcols].to_numpy(dtype=np.float64)
        t_all = pdf["t"].to_numpy()
        cuts = np.flatnonzero(np.diff(t_all)) + 1
        starts = np.concatenate([[0], cuts])
        ends = np.concatenate([cuts, [len(t_all)]])
        ticker = pdf[KEY].iloc[0]
        depth_limit = int(pdf["depth_limit"].iloc[0])
        psi = int(pdf["psi"].iloc[0])
        cols = {KEY: [], "t": [], "psi": [], "f": [], "v": [], "hb": [], "n_splits": [], "n_leaves": [], "n_rows": []}
        for a, b in zip(starts, ends):
            t = int(t_all[a])
            f, v, hb, ns, nl = _grow_tree(x_all[a:b], ticker, t, depth_limit, seed, psi)
            for k, val in ((KEY, ticker), ("t", t), ("psi", psi), ("f", f), ("v", v), ("hb", hb),
                           ("n_splits", ns), ("n_leaves", nl), ("n_rows", b - a)):
                cols[k].append(val)
        return pd.DataFrame(cols)
    return build


TREES_PER_TASK = 25


def grow(sample: DataFrame, seed: int = SEED, n_series: int | None = None,
         n_trees: int = N_TREES) -> DataFrame:
    """One model row per (ticker, tree). A group is a block of at most TREES_PER_TASK
    trees of one ticker, i.e. at most TREES_PER_TASK * psi rows.

    The sample is small in bytes but costly in CPU, so it is hash-partitioned by
    block into an explicit number of partitions (AQE would otherwise merge it into
    one task); the grouping then needs no further exchange."""
    block = F.floor(F.col("t") / F.lit(TREES_PER_TASK))
    n_features = len(MODEL_FEATURES)
    # scalar columns travel through Arrow as plain float buffers (no list conversion)
    d = sample.select(KEY, "t", "psi", "depth_limit", block.alias("_blk"),
                      *[F.get(F.col("x"), j).alias(f"_x{j}") for j in range(n_features)])
    if n_series is not None:
        groups = n_series * -(-n_trees // TREES_PER_TASK)
        d = d.repartition(max(1, min(groups, _task_slots(sample) * 4)), KEY, "_blk")
    return d.groupBy(KEY, "_blk").applyInPandas(_grow_group(seed, n_features), TREE_SCHEMA)


def _task_slots(df: DataFrame) -> int:
    """Concurrent task slots of the cluster (total executor cores)."""
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def fit_forest(scaled: DataFrame, n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES,
               seed: int = SEED, n_series: int | None = None, cut=None) -> DataFrame:
    """The forest, materialised by ``cut`` (default: a checkpoint) so that short samples can be found and redone."""
    cut = cut or (lambda df: df.checkpoint(eager=True))
    trees = all_trees(series_sizes(scaled, max_samples), n_trees, seed)
    forest = cut(grow(sample_rows(scaled, trees, seed, n_series, n_trees), seed, n_series, n_trees))
    full = forest.filter(F.col("n_rows") >= F.col("psi")).groupBy(KEY).agg(F.collect_set("t").alias("_done"))
    short = trees.join(full, KEY, "left").withColumn("trees", F.filter("trees", lambda t: ~F.coalesce(
        F.array_contains("_done", t["t"]), F.lit(False)))).filter(F.size("trees") > 0).drop("_done")
    if short.isEmpty():
        return forest
    short = short.checkpoint(eager=True)
    redone = grow(_smallest(_keyed(scaled, short, seed, n_series, n_trees)), seed, n_series, n_trees)
    kept = forest.filter(F.col("n_rows") >= F.col("psi"))
    return cut(kept.unionByName(redone))


def forest_nodes(forest: DataFrame) -> DataFrame:
    """Inner split nodes (ticker, t, node, feature, threshold) of a fitted forest."""
    d = forest.select(KEY, "t", F.posexplode(F.arrays_zip("f", "v")).alias("node", "s"))
    return (d.filter(F.col("s.v") < F.lit(float("inf")))
            .select(KEY, "t", "node", F.col("s.f").alias("feature"), F.col("s.v").alias("threshold")))


def walk(x: np.ndarray, f: np.ndarray, v: np.ndarray, hb: np.ndarray) -> np.ndarray:
    """Mean path length of each row of x over all trees (rows of f, v, hb)."""
    trees = np.arange(len(f))[:, None]
    out = np.empty(len(x))
    step = max(1, 1_000_000 // max(1, len(f)))
    for first in range(0, len(x), step):
        rows = x[first:first + step]
        node = np.zeros((len(f), len(rows)), np.int64)
        at = np.arange(len(rows))[None, :]
        for _ in range(hb.shape[1].bit_length() - 1):
            node = 2 * node + 1 + (rows[at, f[trees, node]] > v[trees, node])
        out[first:first + step] = hb[trees, node - f.shape[1]].mean(0)
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def score(scaled: DataFrame, forest: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(ticker, Date, ``keep``, mean_path, if_score) of every scaled row whose ticker has a forest, row by row."""
    keep = keep if keep is not None else [c for c in scaled.columns if c not in (KEY, TIME, "x")]
    blocks = F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int")
    sizes = scaled.groupBy(KEY).agg(blocks.alias("_blocks"))
    rows = scaled.select(KEY, TIME, *keep, "x").join(sizes, KEY)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(TIME), F.col("_blocks")).cast("int")).drop("_blocks")
    trees = forest.select(KEY, "t", "psi", "f", "v", "hb").join(sizes, KEY)
    trees = trees.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    fields = [scaled.schema[c] for c in (KEY, TIME, *keep)]
    schema = T.StructType([*fields, T.StructField("mean_path", T.DoubleType()), T.StructField("if_score", T.DoubleType())])
    empty = to_arrow_schema(schema).empty_table()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return empty
        right = right.sort_by("t")
        path = walk(_matrix(left["x"]), _matrix(right["f"]), _matrix(right["v"]), _matrix(right["hb"]))
        c = avg_path_length_py(right["psi"][0].as_py())
        # psi = 1 gives c = 0: the score is undefined (null), not an error
        value = pa.array(-np.exp2(-path / c)) if c else pa.nulls(len(path), pa.float64())
        return left.select([KEY, TIME, *keep]).append_column("mean_path", pa.array(path)).append_column("if_score", value)
    return rows.groupBy(KEY, "_block").cogroup(trees.groupBy(KEY, "_block")).applyInArrow(work, schema)
