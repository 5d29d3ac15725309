"""Connected components of a link table, by hooking to the smallest neighbour and pointer jumping.

Every node starts as its own label. A round gives each node the smallest label among its own and its
neighbours', then replaces labels by their labels' label, so labels travel along paths at doubling
speed. Only minima are aggregated (with map-side combine), so a node with very many links costs no
more than its rows; the joins of a round stand alone between checkpoints, so the optimizer can split
a label that very many nodes share. Rounds end when no label changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link (nulls and self-links give none)."""
    one = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null and x <> y")
    # links point both ways, each once
    both = stored(one.union(one.select("y", "x")).distinct())
    labels = stored(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("m"))
        hooked = labels.join(seen.select(F.col("x").alias("node"), "m"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label")).checkpoint()
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        # a table, not a checkpoint: a checkpoint keeps the size estimated for its plan, which joins square round by round
        jumped = stored(hooked.join(up, "label").select("node", "old", F.col("up").alias("label")))
        changed = jumped.filter("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
