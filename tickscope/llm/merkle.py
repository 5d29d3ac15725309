"""Merkle manifest of a table: every row a leaf, one tree a group, one tree over the groups' roots.

H is the lower-case hex sha256 of its inputs' concatenation, digests as hex text. A leaf is H of the row's fields,
each `-` if null, else its UTF-8 byte count, `:` and its value. In a group, leaves ascend by the order column; every
``arity`` consecutive nodes (the last run may be shorter, even one) become their H while more than one is left. What is
left is the group's subroot; subroots, ordered by group (null first, bytewise), give the root in the same way.

Building. Rows get their place in the group from one range partitioning of (group, order column, leaf) with counts of the
parts, so a group of any size is spread over many tasks. Nodes are then taken in runs of arity^RISE (729): a run is one
bounded row in which RISE levels are built by array functions. The levels are stored as node rows (tree, level, pos), each
linked to its ancestor RISE levels up (or to the tree's top, whose link leads to its place in the tree over the groups),
with the siblings met on the way. A table of n rows takes log(n) / RISE rounds, each smaller by arity^RISE.

Climbing. One recursive query starts at each leaf with the hash that the row has now (its claim) and joins the node rows by their
links: a step folds the hash with the siblings, level by level, and appends the siblings to the proof. The folded hash at the
end is the claim's root; the row is verified if it equals the stored root.

Nulls: a null field is `-`; a null order column sorts first; rows without group are a group of their own, the first. Empty
texts are `0:`. Rows alike in group and order column are ordered by their leaf; rows alike in that too are leaves side by side,
and each gets the proof of its own place. A long text costs its hash and isn't moved. A group of one row: its leaf is the subroot.
An empty table gives an empty result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stored

#: Levels a node row climbs at once.
RISE = 6
#: Key of the tree over the groups' roots; the groups' trees are 0, 1, ...
ROOT_TREE = -1


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(fields: Sequence[Column]) -> Column:
    """H of the fields, each with its length; `-` for null."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def _hex(binary: Column) -> Column:
    return F.lower(F.hex(binary))


def _height(n: Column, arity: int) -> Column:
    """Levels above the leaves of a tree of n leaves: the least L with arity^L >= n."""
    powers = F.array(*[F.lit(arity ** k) for k in range(64) if arity ** k < 1 << 62])
    return F.size(F.filter(powers, lambda p: p < n))


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with ``part`` and ``inside``: place within the part, from 0; (group, part, before: rows of the group in earlier parts)).

    ``rows`` must be a stored table: its rows get a running number for ties, which must come out alike in a repeated task.
    """
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = stored(dealt.repartitionByRange(group, *order, "tie").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = Window.partitionBy(group, "part").orderBy(*order, "tie")
    return dealt.withColumn("inside", F.row_number().over(inside) - 1).drop("tie"), offsets


def _levels(nodes: DataFrame, level: int, arity: int) -> DataFrame:
    """Runs of arity^RISE nodes of one level with the levels built above them: (tree, height, run, members, levels, steps)."""
    width = arity ** RISE
    runs = nodes.groupBy("tree", "height", F.expr(f"pos div {width}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "row"))).alias("members"))
    runs = runs.withColumn("steps", F.least(F.lit(RISE), F.col("height") - level)).withColumn("l0", F.col("members.hash"))
    for k in range(RISE):
        below = F.col(f"l{k}")
        above = F.transform(F.sequence(F.lit(0), F.ceil(F.size(below) / arity).cast("int") - 1), lambda i: F.sha2(F.array_join(F.slice(below, i * arity + 1, arity), ""), 256))  # noqa: B023
        runs = runs.withColumn(f"l{k + 1}", F.when(F.col("steps") > k, above).otherwise(below))
    return runs.select("tree", "height", "run", "steps", "members", F.array(*[f"l{k}" for k in range(RISE)]).alias("levels"), F.col(f"l{RISE}")[0].alias("top"))


def _linked(runs: DataFrame, level: int, arity: int) -> DataFrame:
    """Node rows of the runs' first level: (tree, level, pos, hash, row, lift, up_tree, up_level, up_pos)."""
    rows = runs.select("tree", "height", "run", "steps", "levels", F.posexplode("members").alias("at", "member"))

    def siblings(k: Column) -> Column:
        of = F.element_at("levels", k + 1)
        place = F.floor(F.col("at") / F.pow(F.lit(arity), k)).cast("int")
        start = (F.floor(place / arity) * arity).cast("int")
        side = lambda first, n: F.unhex(F.array_join(F.slice(of, first + 1, n), ""))
        return F.struct(side(start, place - start).alias("before"), side(place + 1, start + arity - place - 1).alias("after"))
    lift = F.when(F.col("steps") > 0, F.transform(F.sequence(F.lit(0), F.col("steps") - 1), siblings)).otherwise(F.expr("cast(array() as array<struct<before: binary, after: binary>>)"))
    ends = F.col("height") == level + F.col("steps")
    # a tree's top is known in the tree over the groups by its number; above the root there is nothing
    over = lambda inner, outer: F.when(ends & (F.col("tree") == ROOT_TREE), None).when(ends, outer).otherwise(inner)
    return rows.select("tree", F.lit(level).alias("level"), F.col("member.pos").alias("pos"), F.col("member.hash").alias("hash"), F.col("member.row").alias("row"), lift.alias("lift"),
                       over(F.col("tree"), F.lit(ROOT_TREE).cast("long")).alias("up_tree"), over(level + F.col("steps"), F.lit(0)).cast("int").alias("up_level"),
                       over(F.col("run"), F.col("tree")).alias("up_pos"))


def _grown(leaves: DataFrame, height: int, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """Stored node rows of each round, and (tree, hash) of the tops, from leaves (tree, height, pos, hash, row); ``height``: the greatest."""
    nodes, tops, at, level = [], [], leaves, 0
    while True:
        runs = stored(_levels(at, level, arity))
        nodes.append(stored(_linked(runs, level, arity)))
        tops.append(runs.filter(F.col("height") == level + F.col("steps")).select("tree", F.col("top").alias("hash")))
        if level + RISE >= height:
            break
        at = runs.filter(F.col("height") > level + F.col("steps")).select("tree", "height", F.col("run").alias("pos"), F.col("top").alias("hash"), F.lit(None).cast(leaves.schema["row"].dataType).alias("row"))
        level += RISE
    done = tops[0]
    for more in tops[1:]:
        done = done.union(more)
    return nodes, done


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", order_col: str = "doc_id",
             claims: Mapping[str, Column] | None = None, arity: int = 3) -> tuple[DataFrame, DataFrame, str | None]:
    """Builds the trees: (leaf rows, node rows above them, root).

    A leaf row has ``row`` (order column's value, leaf, claim: the hash of the row with the fields in ``claims`` replaced) and ``subroot``.
    """
    now = [(claims or {}).get(f, col(f)) for f in fields]
    hashed = stored(docs.select(col(group_col).cast("string").alias("grp"), col(order_col).alias("ord"), leaf_hash([col(f) for f in fields]).alias("hash"), F.unhex(leaf_hash(now)).alias("claim")))
    rows, offsets = placed(hashed, "grp", ["ord", "hash"])
    groups = stored(offsets.groupBy("grp").agg(F.sum("n").alias("size")))
    # the trees' numbers: the groups' places in their own order
    ordered, before = placed(groups.withColumn("all", F.lit(0)), "all", ["grp"])
    trees = stored(ordered.join(before.select("part", "before"), "part").select("grp", (F.col("before") + F.col("inside")).cast("long").alias("tree"), _height(F.col("size"), arity).alias("height")))
    offsets = offsets.alias("o").join(trees.alias("t"), F.col("o.grp").eqNullSafe(F.col("t.grp"))).select("o.grp", "o.part", "o.before", "t.tree", "t.height")
    joined = rows.alias("r").join(offsets.alias("o"), (F.col("r.part") == F.col("o.part")) & F.col("r.grp").eqNullSafe(F.col("o.grp")))
    leaves = joined.select("o.tree", "o.height", (F.col("o.before") + F.col("r.inside")).alias("pos"), "r.hash", F.struct("r.ord", "r.claim").alias("row"))
    highest, count = trees.agg(F.max("height"), F.count("*")).first()
    grown, tops = _grown(leaves, highest or 0, arity)
    tops = stored(tops)
    over = tops.select(F.lit(ROOT_TREE).cast("long").alias("tree"), _height(F.lit(count), arity).alias("height"), F.col("tree").alias("pos"), "hash", F.lit(None).cast(leaves.schema["row"].dataType).alias("row"))
    root_height = next(k for k in range(64) if arity ** k >= max(1, count))
    above, root = _grown(over, root_height, arity)
    links = grown[1:] + above
    nodes = links[0]
    for more in links[1:]:
        nodes = nodes.unionByName(more)
    top = root.first()
    return grown[0].join(tops.select("tree", F.col("hash").alias("subroot")), "tree"), nodes, top["hash"] if top else None


#: Climbs from the claims of all leaf rows to the root: each step folds the siblings of one node row and appends them to the proof.
CLIMB = """
WITH RECURSIVE climb (ord, leaf, subroot, tree, level, pos, folded, proof) AS (
  SELECT row.ord, hash, subroot, up_tree, up_level, up_pos, {fold}(row.claim, lift), {join}(lift) FROM {leaves}
  UNION ALL
  SELECT c.ord, c.leaf, c.subroot, n.up_tree, n.up_level, n.up_pos, {fold}(c.folded, n.lift), concat(c.proof, {join}(n.lift))
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.level = n.level AND c.pos = n.pos
)
SELECT ord, leaf, subroot, folded, proof FROM climb WHERE tree IS NULL
"""


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a leaf: ord, leaf, subroot, folded (binary), proof (the siblings' digests, binary, lowest first)."""
    spark = leaves.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # the default would end the climb of a large table
    names = {"leaves": "tickscope_merkle_leaves", "nodes": "tickscope_merkle_nodes"}
    leaves.createOrReplaceTempView(names["leaves"])
    nodes.createOrReplaceTempView(names["nodes"])
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tickscope_merkle_fold(claim BINARY, lift ARRAY<STRUCT<before: BINARY, after: BINARY>>) RETURNS BINARY "
              "RETURN aggregate(lift, claim, (h, s) -> unhex(sha2(lower(concat(hex(s.before), hex(h), hex(s.after))), 256)))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION tickscope_merkle_join(lift ARRAY<STRUCT<before: BINARY, after: BINARY>>) RETURNS BINARY "
              "RETURN aggregate(lift, cast('' AS BINARY), (p, s) -> concat(p, s.before, s.after))")
    try:
        return spark.sql(CLIMB.format(fold="tickscope_merkle_fold", join="tickscope_merkle_join", **names))
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def verified(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "source", order_col: str = "doc_id",
             claims: Mapping[str, Column] | None = None, arity: int = 3) -> DataFrame:
    """One row a row of ``docs``: order column, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaves, nodes, root = manifest(docs, fields, group_col, order_col, claims, arity)
    found = climb(leaves, nodes)
    folded = _hex(F.col("folded"))
    return found.select(F.col("ord").alias(order_col), "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(_hex(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.lit(root)).alias("verified"))
