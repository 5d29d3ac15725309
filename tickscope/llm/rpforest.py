"""Embedding near-deduplication with a forest of random-projection trees.

Vectors are compared by cosine in double precision; pairs of cosine >= ``threshold`` are linked.

Index: ``trees`` trees of recursive random splits. A node projects on a random direction and splits at
the median; vectors within a margin of the split go to both sides (spill overlap). The margin is
SPILL standard deviations of what two vectors at the threshold differ by on a random direction, so a linked
pair is parted by a split only if the split lies between them and they are far apart on it. Splitting ends at about ``leaf_rows``
vectors, or where a side would keep nearly all of a node, as in a dense clump. The trees are fitted on at most about
``sample_rows`` vectors (by hash of the id); every vector is then put in its leaves by one map pass with
the trees broadcast (their size is bounded by the sample).

Comparison: all pairs inside each leaf, as matrix products; leaves of more than ``block_rows`` vectors are cut
into blocks, one task a pair of blocks. A pair that shares several leaves is counted only in the first
of them, which both know from their leaf lists, so the number of links of a vector is a sum and no pair is
ever given out. For components each leaf gives out a spanning forest of its links.

Equal vectors are one class from the start (their smallest id stands for all; they are linked to each
other) and are compared once. Vectors of different lengths are never linked. Null or zero vectors and those
with null or non-finite components link with nothing. Rows with a null id are returned without links.
Rows of equal id and different vectors are one node with the links of all. An empty table gives an empty
result; columns other than the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, list_array
from .components import components

SPILL = 0.5
#: A split that leaves more than this part of a node on one side ends in a leaf.
FULL = 0.85


@dataclass
class Node:
    direction: np.ndarray | None = None
    low: float = 0.0
    high: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None
    leaf: int = -1


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, safe against overflow."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def padded(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix with zeros after short ones, and their lengths."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy()
    out = np.zeros((len(sizes), max(width, int(sizes.max()) if len(sizes) else 0)))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out, sizes


def grow(sample: np.ndarray, rows: int, threshold: float, trees: int, leaf_rows: int, seed: int = 5) -> list[Node]:
    """Trees for ``rows`` vectors, fitted on a sample of them."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    margin = SPILL * math.sqrt(max(0.0, 2 - 2 * threshold)) / math.sqrt(max(1, d))
    scale, leaves = rows / max(1, len(sample)), 0

    def split(members: np.ndarray) -> Node:
        nonlocal leaves
        if len(members) * scale > leaf_rows and len(members) >= 32:
            direction = rng.standard_normal(d)
            direction /= np.linalg.norm(direction)
            at = sample[members] @ direction
            middle = float(np.median(at))
            left, right = members[at < middle + margin], members[at >= middle - margin]
            if max(len(left), len(right)) <= FULL * len(members):
                return Node(direction, middle - margin, middle + margin, split(left), split(right))
        leaves += 1
        return Node(leaf=leaves - 1)
    return [split(np.arange(len(sample))) for _ in range(trees)]


def leaves_of(forest: list[Node], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vector, leaf) pairs, by vector, leaves rising."""
    at, leaf = [], []
    for root in forest:
        stack = [(root, np.arange(len(vectors)))]
        while stack:
            node, members = stack.pop()
            if not len(members):
                continue
            if node.direction is None:
                at.append(members)
                leaf.append(np.full(len(members), node.leaf))
                continue
            # vectors of another length than the sample's are cut or filled with zeros
            d = min(len(node.direction), vectors.shape[1])
            x = vectors[members, :d] @ node.direction[:d]
            stack += [(node.left, members[x < node.high]), (node.right, members[x >= node.low])]
    at, leaf = np.concatenate(at), np.concatenate(leaf)
    order = np.lexsort((leaf, at))
    return at[order], leaf[order]


def compare(leaf: int, vectors: np.ndarray, sizes: np.ndarray, weights: np.ndarray, memberships: pa.ListArray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For a leaf (or two blocks of it): each vector's links counted here, and its label in a spanning forest."""
    n = len(vectors)
    linked = np.zeros((n, n), bool)
    for first in range(0, n, 512):
        linked[first:first + 512] = vectors[first:first + 512] @ vectors.T >= threshold
    linked &= (sizes[:, None] == sizes[None, :]) & ~np.eye(n, dtype=bool)
    if (side >= 0).any():
        linked &= side[:, None] != side[None, :]
    linked |= linked.T  # the product may round differently above and below the diagonal
    links, label = np.zeros(n, np.int64), np.arange(n)
    busy = np.flatnonzero(linked.any(1))
    if not len(busy):
        return links, label
    adjacent = linked[np.ix_(busy, busy)]
    # pairs that met in an earlier leaf are counted there
    flat, lengths = memberships.flatten().to_numpy(), memberships.value_lengths().to_numpy()
    owner = np.repeat(np.arange(n), lengths)
    place = np.full(n, -1)
    place[busy] = np.arange(len(busy))
    use = (flat < leaf) & (place[owner] >= 0)
    earlier, column = np.unique(flat[use], return_inverse=True)
    member = np.zeros((len(busy), len(earlier)), np.float32)
    member[place[owner[use]], column] = 1
    new = adjacent & ~(member @ member.T > 0)
    links[busy] = new.astype(np.float64) @ weights[busy].astype(np.float64)
    mine = np.arange(len(busy))
    while True:
        best = np.minimum(mine, np.where(adjacent, mine[None, :], n).min(1))
        best = best[best]
        if (best == mine).all():
            break
        mine = best
    label[busy] = busy[mine]
    return links, label


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, trees: int = 8,
                         leaf_rows: int = 400, block_rows: int = 1500, sample_rows: int = 20_000) -> DataFrame:
    """One row a vector: id, n_links (other vectors linked to it), component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    # floats travel as floats; lengths and products are taken in double precision
    form = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(col(id_col).alias("id"), col(vector_col).cast(form).alias("v"))
    rows = rows.withColumn("fit", F.coalesce(F.col("id").isNotNull() & finite, F.lit(False)))
    rows = rows.withColumn("k1", F.when(F.col("fit"), F.xxhash64("v"))).withColumn("k2", F.when(F.col("fit"), F.xxhash64("v", F.lit(1)))).checkpoint()
    classes = rows.filter("fit").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")).checkpoint()
    total = classes.count()
    share = F.pmod(F.xxhash64("k1", F.lit(23)), F.lit(1 << 30)) < F.lit(int(min(1.0, sample_rows / max(1, total)) * (1 << 30)))
    sample = [r["v"] for r in classes.filter(share).select("v").collect()]  # about sample_rows at most
    width = max(map(len, sample), default=1)
    fitted = unit(np.array([x + [0.0] * (width - len(x)) for x in sample])) if sample else np.zeros((0, width))
    forest = spark.sparkContext.broadcast(grow(fitted, total, threshold, trees, leaf_rows))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at, leaf = leaves_of(forest.value, unit(padded(batch.column(2), width)[0]))
                counts = np.bincount(at, minlength=len(batch))
                yield pa.RecordBatch.from_arrays([*batch.columns, list_array(leaf.astype(np.int32), counts)], names=["rep", "n", "v", "leaves"])
    placed = classes.select("rep", "n", "v").mapInArrow(assign, f"rep {kind}, n bigint, v {form}, leaves array<int>").checkpoint()
    sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count()
    cut = sizes.select("leaf", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks"))
    # as many rows as leaves, and their number is bounded by the sample
    dealt = placed.withColumn("leaf", F.explode("leaves")).join(F.broadcast(cut), "leaf").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = dealt.withColumn("side", F.when(F.col("low") == F.col("high"), -1).otherwise((F.col("block") == F.col("high")).cast("int"))).drop("block", "other", "blocks")

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v, sizes = padded(table["v"].chunk(0), 0)
        links, label = compare(key[0].as_py(), unit(v), sizes, table["n"].to_numpy(), table["leaves"].chunk(0), table["side"].to_numpy(), threshold)
        return pa.table({"rep": table["rep"], "links": pa.array(links), "root": table["rep"].take(pa.array(label))}).filter(pa.array((links > 0) | (label != np.arange(len(label)))))
    met = dealt.groupBy("leaf", "low", "high").applyInArrow(work, f"rep {kind}, links bigint, root {kind}").checkpoint()
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    component = components(met, "rep", "root").select(F.col("node").alias("rep"), "component")
    out = rows.select("id", "k1", "k2").join(classes.select("k1", "k2", "rep", "n"), ["k1", "k2"], "left").join(links, "rep", "left").join(component, "rep", "left")
    found = F.coalesce("component", "rep", "id")
    return out.select(F.col("id").alias(id_col), (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"),
                      found.alias("component_id"), F.coalesce(found == F.col("id"), F.lit(True)).alias("kept"))
