"""MinHash near-deduplication by ProbMinHash: weighted shingles, probability Jaccard, banding, verification.

A document is the multiset of its five-word shingles (a text of one to four words: one shingle of all
its words). Similarity is the probability Jaccard similarity of the shingle counts,

    J(a, b) = sum over common i of 1 / sum_j max(a_j / a_i, b_j / b_i),

which is the plain Jaccard similarity when no shingle repeats. Documents of J >= ``threshold`` are linked;
a class is a component of the link graph.

Signature: each shingle sends out a Poisson process of points in time whose rate is its count; each
point falls on a random register, and a register keeps the shingle whose point came first. Two
documents agree in a register with probability J. Points of a shingle come in order, so a shingle stops as
soon as its next point is later than the last register's time (early termination).

Steps:
1. one pass over the texts: signature, content hash. Equal contents are one node of the link graph from the start, whatever
   ids hold them; the smallest id speaks for it.
2. banding: contents that agree in a whole band of registers fall into a bucket. Contents connected by buckets are a family: no link
   leads out of it. Each content is tied once, to the least head (smallest content) of all its buckets; what these ties
   join is one node for the buckets that still hold several, so a family of N contents costs about N ties, not one a band.
3. families of more than ``block_docs`` first join what is easy to join: in each round, one a band, every component so far picks one pair
   with a component that shares a bucket with it, and the pair is verified exactly. Rounds go on while an eighth of the pairs
   link and more than ``block_docs`` are tried, so the components fall geometrically. What is left are the buckets whose members are still apart.
4. verification in blocks: the texts of small families and of such left buckets are shuffled by block. A task compares
   signatures, takes pairs that agree in enough registers in the order of
   that number, and verifies a pair exactly, skipping pairs already connected; it gives out a spanning
   forest of verified links, never all pairs. A component of more than ``block_docs`` has blocks of its own, which never meet each other;
   smaller components share blocks (pools). Pools meet each other and the blocks of large components; large components meet each other. So a family of N near
   copies costs about N texts a round and N - 1 links; only texts that share bands without being near copies still meet block by block.
5. components of the verified links.

Missed links: with 25 bands of 5 registers a pair of J = 0.8 shares no band with probability 5e-5; the
register filter (SLACK below the expected agreement) passes all but 1e-8 of such pairs.

Null and empty texts have no shingles: each such document is a class of its own. Repeated ids: rows are told apart by id and
text, so each row belongs to the class of its own text, and a class keeps the row of its smallest id (of an id's texts in one class, that
of the smallest content hash). Null ids take no part and are kept, each its own class with null id. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import col, fresh, list_array, row_key, stored
from .components import components

SHINGLE = 5
REGISTERS, BANDS, ROWS = 128, 25, 5
#: Pairs that agree in fewer than (threshold - SLACK) of the registers are not verified: 5.6 standard deviations at 0.8.
SLACK = 0.2
#: Pairs tried between two looks at what is connected by now.
CHUNK = 4096
#: A round that links less than one in so many of its pairs is the last one.
STOP = 8
#: Texts of about so many bytes make a group of small families.
GROUP_BYTES = 4 << 20


def weighted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: (first row, end row, distinct shingles, their counts, row of each, content hash of each row)."""
    for first, end, data, bounds in W.slices(column):
        starts, ends, ranges = W.words(data, bounds)
        hashes = W.word_hashes(data, starts, ends)
        grams, of = W.shingles(hashes, ranges, SHINGLE)
        order = np.lexsort((grams, of))
        g, r = grams[order], of[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(g)))
        content = np.zeros(end - first, W.U64)
        full = np.flatnonzero(np.diff(ranges) > 0)
        if len(full):
            place = W.mix(np.arange(len(hashes)).astype(W.U64) - np.repeat(ranges[:-1], np.diff(ranges)).astype(W.U64), 3)
            content[full] = W.mix(np.add.reduceat(W.mix(hashes ^ place, 5), ranges[:-1][full]))
        yield first, end, g[at], counts, r[at], content


def prob_minhash(shingles: np.ndarray, counts: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Signatures (rows x REGISTERS): the shingle whose point came first on each register; 0 for rows without shingles."""
    times = np.full(rows * REGISTERS, np.inf)
    first = np.zeros(rows * REGISTERS, W.U64)
    alive = np.arange(len(shingles))
    clock = np.zeros(len(shingles))
    done, burst = 0, 1
    while len(alive):
        steps = np.arange(done, done + burst).astype(W.U64) * W.U64(0x9E3779B97F4A7C15) + W.U64(1)
        h = W.mix(shingles[alive][:, None] ^ W.mix(steps, 11)[None, :], 13)
        waits = -np.log(((h >> W.U64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / counts[alive][:, None]
        when = clock[alive][:, None] + np.cumsum(waits, 1)
        clock[alive] = when[:, -1]
        register = row[alive][:, None] * REGISTERS + (h & W.U64(REGISTERS - 1)).astype(np.int64)
        late = times.reshape(rows, REGISTERS).max(1)[row[alive]]
        use = when < late[:, None]
        at, t = register[use], when[use]
        np.minimum.at(times, at, t)
        won = times[at] == t
        first[at[won]] = np.broadcast_to(shingles[alive][:, None], when.shape)[use][won]
        last = times.reshape(rows, REGISTERS).max(1)
        alive = alive[clock[alive] < last[row[alive]]]
        done += burst
        burst = min(64, burst * 2)
    return first.reshape(rows, REGISTERS)


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash a band (rows x BANDS)."""
    out = np.zeros((len(signature), BANDS), W.U64)
    for j in range(ROWS):
        out = W.mix(out ^ signature[:, j:BANDS * ROWS:ROWS], 20 + j)
    return W.mix(out, 40) + np.arange(BANDS, dtype=W.U64)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, bytes, content, bands): one row a row of ``docs``; content and bands are null without shingles or id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, shingles, counts, row, content in weighted(batch.column(3)):
                found = bands(prob_minhash(shingles, counts, row, end - first)).view(np.int64)
                has = np.bincount(row, minlength=end - first) > 0
                lists = list_array(found[has].reshape(-1), np.full(int(has.sum()), BANDS))
                # rows without shingles take the null after the last list
                place = np.where(has, np.cumsum(has) - 1, -1)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(first, end - first) for k in range(3)], pa.array(content.view(np.int64), mask=~has),
                                                  lists.take(pa.array(place, mask=~has))], names=["id", "row", "bytes", "content", "bands"])
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.when(col(id_col).isNotNull(), col(text_col))
    rows = docs.select(col(id_col).alias("id"), row_key(col(id_col), col(text_col)).alias("row"), F.octet_length(col(text_col)).cast("long").alias("bytes"), text.alias("text"))
    return rows.mapInArrow(run, f"id {kind}, row bigint, bytes bigint, content bigint, bands array<bigint>")


def probability_jaccard(a: np.ndarray, a_n: np.ndarray, b: np.ndarray, b_n: np.ndarray) -> float:
    """Exact J of two sorted distinct shingle arrays with their counts."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = b[at] == a
    common = int(both.sum())
    if not common:
        return 0.0
    if a_n.max() == 1 and b_n.max() == 1:
        return common / (len(a) + len(b) - common)
    x, y = a_n[both].astype(np.float64), b_n[at[both]].astype(np.float64)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # for i: the shingles of a higher or equal ratio count as a_j / a_i, the others as b_j / b_i; those of one document alone always
    above = np.cumsum(x[::-1])[::-1] + (a_n.sum() - x.sum())
    below = np.append(0, np.cumsum(y)[:-1]) + (b_n.sum() - y.sum())
    return float((1 / (above / x + below / y)).sum())


class Forest:
    """Union by smallest index."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def links_within(sets: list[tuple[np.ndarray, np.ndarray]], signature: np.ndarray, side: np.ndarray | None, comp: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Verified links that, with what is connected by ``comp``, span one family, or the links between its two sides (0 and 1)."""
    n = len(sets)
    need = (threshold - SLACK) * REGISTERS
    xs, ys, agree = [], [], []
    short = (W.mix(signature, 60) >> W.U64(48)).astype(np.uint16)
    step = max(1, (4 << 20) // max(1, n * 8))
    for first in range(0, n, step):
        same = np.zeros((min(step, n - first), n), np.uint8)
        for r in range(REGISTERS):
            same += short[first:first + step, r][:, None] == short[:, r][None, :]
        x, y = np.nonzero(same >= need)
        keep = (x + first < y) & (comp[x + first] != comp[y]) & (True if side is None else side[x + first] != side[y])
        xs.append(x[keep] + first)
        ys.append(y[keep])
        agree.append(same[x[keep], y[keep]])
    x, y, agree = np.concatenate(xs), np.concatenate(ys), np.concatenate(agree)
    order = np.argsort(-agree.astype(np.int64), kind="stable")
    x, y = x[order], y[order]
    forest, out, seen = Forest(n), [], {}
    for i, c in enumerate(comp.tolist()):
        forest.join(seen.setdefault(c, i), i)
    while len(x):
        for i, j in zip(x[:CHUNK].tolist(), y[:CHUNK].tolist()):
            if forest.root(i) != forest.root(j) and probability_jaccard(*sets[i], *sets[j]) >= threshold - 1e-12:
                forest.join(i, j)
                out.append((i, j))
        x, y = x[CHUNK:], y[CHUNK:]
        label = np.array([forest.root(i) for i in range(n)])
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return out


def verify(table: pa.Table, threshold: float) -> tuple[list[int], list[int]]:
    """Rows of linked pairs in a group of whole families, or of two blocks that meet (column side: 0 or 1; -1: one block)."""
    table = table.combine_chunks()
    family, side, comp = (table[c].to_numpy() for c in ("family", "side", "comp"))
    sets: list[tuple[np.ndarray, np.ndarray]] = []
    signature = []
    column = table["text"].chunk(0) if table["text"].num_chunks else pa.array([], pa.string())
    for first, end, shingles, counts, row, _ in weighted(column):
        at = np.searchsorted(row, np.arange(end - first + 1))
        sets += [(shingles[a:b], counts[a:b]) for a, b in zip(at, at[1:])]
        signature.append(prob_minhash(shingles, counts, row, end - first))
    signature = np.concatenate(signature)
    order = np.argsort(family, kind="stable")
    edges = np.flatnonzero(np.append(True, family[order][1:] != family[order][:-1]))
    left, right = [], []
    for members in np.split(order, edges[1:]):
        two = side[members] if (side[members] >= 0).any() else None
        for i, j in links_within([sets[m] for m in members], signature[members], two, comp[members], threshold):
            left.append(int(members[i]))
            right.append(int(members[j]))
    return left, right


def confirmed(table: pa.Table, threshold: float) -> pa.Table:
    """(comp, other, linked) of a group of pairs: rows (comp, other, x, y, text of y), and each x once as (null, null, x, null, text of x)."""
    table = table.combine_chunks()
    sets = []
    for first, end, shingles, counts, row, _ in weighted(table["text"].chunk(0)):
        at = np.searchsorted(row, np.arange(end - first + 1))
        sets += [(shingles[i:j], counts[i:j]) for i, j in zip(at, at[1:])]
    xs, ys = table["x"].to_pylist(), table["y"].to_pylist()
    heads = {x: k for k, (x, y) in enumerate(zip(xs, ys)) if y is None}
    at = [k for k, y in enumerate(ys) if y is not None]
    linked = [probability_jaccard(*sets[heads[xs[k]]], *sets[k]) >= threshold - 1e-12 for k in at]
    pairs = table.select(["comp", "other"]).take(pa.array(at, pa.int64()))
    return pairs.append_column("linked", pa.array(linked, pa.bool_()))


def _told(pairs: DataFrame, texts: DataFrame, total: int, block_docs: int) -> DataFrame:
    """The texts (node, text) of node pairs in groups of about ``block_docs``: each y with its x, each x once a group.

    The pairs of one x are dealt over as many groups as all pairs need, so an x that most pairs share fills no group.
    """
    parts = -(-total // block_docs)
    groups = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts)
    dealt = pairs.withColumn("grp", F.pmod(F.xxhash64("x", F.pmod(F.xxhash64("y"), F.lit(parts))), F.lit(groups)))
    none = F.lit(None).cast("long")
    heads = dealt.select("x", "grp").distinct().select(none.alias("comp"), none.alias("other"), "x", none.alias("y"), "grp", F.col("x").alias("node"))
    return dealt.withColumn("node", F.col("y")).unionByName(heads).join(texts, "node").select("comp", "other", "x", "y", "text", "grp")


def _confirmed(told: DataFrame, threshold: float) -> DataFrame:
    """(comp, other, linked) of the pairs in ``told``."""
    return told.groupBy("grp").applyInArrow(lambda table: confirmed(table, threshold), "comp bigint, other bigint, linked boolean")


def _apart(inside: DataFrame) -> DataFrame:
    """(band, key, head: struct of the least comp and one of its nodes, drawn by hash) of the buckets that hold several components."""
    drawn = F.min(F.struct(F.col("comp"), F.xxhash64("node", "band").alias("draw"), F.col("node")))
    return inside.groupBy("band", "key").agg(drawn.alias("head"), F.max("comp").alias("hi")).filter("head.comp < hi").drop("hi")


def _roots(parents: DataFrame) -> DataFrame:
    """(comp, root) of a forest (comp, parent), by pointer jumping; a parent is less than its child."""
    at = parents.select("comp", F.col("parent").alias("root")).checkpoint()
    while True:
        up = at.select(F.col("comp").alias("root"), F.col("root").alias("further"))
        jumped = at.join(up, "root", "left").select("comp", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint()
        at = jumped.select("comp", "root")
        if jumped.filter("moved").isEmpty():
            return at


def families(speaking: DataFrame) -> DataFrame:
    """(node, family) of the nodes of (node, bands) that share a bucket; a family is known by its smallest node (step 2)."""
    rows = speaking.select("node", F.posexplode("bands").alias("band", "key"))
    heads = rows.groupBy("band", "key").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last").select("band", "key", "head")
    tied = stored(rows.join(heads, ["band", "key"]).groupBy("node").agg(F.min("head").alias("head")))
    roots = _roots(tied.filter("head < node").select(F.col("node").alias("comp"), F.col("head").alias("parent")))
    labels = stored(tied.join(roots.withColumnRenamed("comp", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("comp")))
    inside = speaking.join(labels, "node").select("comp", F.posexplode("bands").alias("band", "key"))
    apart = inside.groupBy("band", "key").agg(F.min("comp").alias("least"), F.max("comp").alias("last")).filter("least < last").select("band", "key", "least").checkpoint()
    if apart.isEmpty():
        return labels.withColumnRenamed("comp", "family")
    joined = components(inside.join(apart, ["band", "key"]).select("comp", "least"), "comp", "least")
    return stored(labels.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("component", "comp").alias("family")))


def rounds(wide: DataFrame, texts: DataFrame, threshold: float, block_docs: int) -> DataFrame:
    """(node, comp) of the nodes in ``wide`` (node, bands), joined by what single verified pairs join (step 3)."""
    labels = wide.select("node", F.col("node").alias("comp"))
    for band in range(BANDS):
        inside = wide.select("node", F.lit(band).alias("band"), F.element_at("bands", band + 1).alias("key")).join(labels, "node")
        pairs = inside.join(_apart(inside), ["band", "key"]).filter("comp <> head.comp").select("comp", F.col("head.comp").alias("other"), F.col("head.node").alias("x"), F.col("node").alias("y"))
        # any one of the component's pairs, by the order of a hash; the other component is always the smaller one
        picked = pairs.groupBy("comp").agg(F.min(F.struct(F.xxhash64("x", "y"), "x", "y", "other")).alias("p")).select("comp", "p.other", "p.x", "p.y").checkpoint()
        total = picked.count()
        if total <= block_docs:
            break
        found = _confirmed(_told(picked, texts, total, block_docs), threshold).filter("linked").checkpoint()
        roots = _roots(found.select("comp", F.col("other").alias("parent")))
        # a table, not a checkpoint: see components
        labels = stored(labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
        if STOP * found.count() < total:
            break
    return labels


def meetings(apart: DataFrame, block_docs: int) -> DataFrame:
    """(node, comp, family, side, grp): the blocks of each family's components, once for each block they have to meet."""
    sized = apart.join(apart.groupBy("family", "comp").agg(F.count("*").alias("own")), ["family", "comp"])
    small = apart.groupBy("family", "comp").agg(F.count("*").alias("own")).filter(F.col("own") <= block_docs).groupBy("family").agg(F.ceil(F.sum("own") / block_docs).alias("pools"))
    large = F.col("own") > block_docs
    # a large component's blocks are numbered by hash of the node, small components go into the pools whole
    block = F.when(large, F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / block_docs))).otherwise(F.pmod(F.xxhash64("comp"), F.col("pools")))
    members = sized.join(small, "family", "left").select("node", "comp", "family", F.when(large, F.col("comp")).alias("pure"), block.alias("block")).checkpoint()
    blocks = members.select("family", "pure", "block").distinct().checkpoint()
    pools, pures = blocks.filter("pure is null").select("family", F.col("block").alias("a")), blocks.filter("pure is not null").select("family", F.col("pure").alias("q"), F.col("block").alias("b"))
    none = F.lit(None).cast("long")
    among = pools.join(pools.select("family", F.col("a").alias("b")), "family").filter("a <= b").select("family", none.alias("p"), "a", none.alias("q"), "b")
    beside = pools.join(pures, "family").select("family", none.alias("p"), "a", "q", "b")
    comps = pures.select("family", "q").distinct()
    unlike = comps.select("family", F.col("q").alias("p")).join(comps, "family").filter("p < q")
    between = unlike.join(pures.select("family", F.col("q").alias("p"), F.col("b").alias("a")), ["family", "p"]).join(pures, ["family", "q"]).select("family", "p", "a", "q", "b")
    met = among.unionByName(beside).unionByName(between)
    met = met.withColumn("grp", F.xxhash64("family", "p", "a", "q", "b"))
    alone = F.col("p").eqNullSafe(F.col("q")) & (F.col("a") == F.col("b"))
    sides = met.select("family", F.col("p").alias("pure"), F.col("a").alias("block"), F.when(alone, -1).otherwise(0).alias("side"), "grp").unionByName(
        met.filter(~alone).select("family", F.col("q").alias("pure"), F.col("b").alias("block"), F.lit(1).alias("side"), "grp"))
    m, o = members.alias("m"), sides.alias("o")
    same = (F.col("m.family") == F.col("o.family")) & (F.col("m.block") == F.col("o.block")) & F.col("m.pure").eqNullSafe(F.col("o.pure"))
    return m.join(o, same).select("m.node", "m.comp", "m.family", "o.side", "o.grp")


def _in_blocks(told: DataFrame, threshold: float) -> DataFrame:
    """Verified links (x, y) inside the groups of (node, comp, family, side, grp, text)."""
    def compare(table: pa.Table) -> pa.Table:
        left, right = verify(table, threshold)
        take = lambda c, at: table[c].take(pa.array(at, pa.int64()))
        return pa.table({"x": take("comp", left), "y": take("comp", right)})
    return told.groupBy("grp").applyInArrow(compare, "x bigint, y bigint")


def links(signed: DataFrame, docs: DataFrame, id_col: str, text_col: str, threshold: float, block_docs: int) -> DataFrame:
    """(node, component) of the contents that have a near duplicate; ``signed``: the stored signatures of ``docs``."""
    spark = docs.sparkSession
    full = signed.filter("content is not null")
    # any row of a content can give its text; which id speaks for the class is settled later
    speaking = stored(full.dropDuplicates(["content"]).select(F.col("content").alias("node"), "id", "row", "bytes", "bands"))
    family = families(speaking)
    large = family.groupBy("family").count().filter(F.col("count") > block_docs).select("family").checkpoint()
    raw = docs.select(col(id_col).alias("id"), row_key(col(id_col), col(text_col)).alias("row"), col(text_col).alias("text"))

    # the texts of families are taken out of the table once; a third of all rows may be alike in id and text
    texts = raw.join(family.join(speaking.select("node", "id", "row"), "node").select("node", "id", "row"), ["id", "row"]).select("node", "text")
    if not full.groupBy("id", "row").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        texts = texts.dropDuplicates(["node"])
    texts = stored(texts)
    small = family.join(large, "family", "left_anti")
    total = small.join(speaking.select("node", "bytes"), "node").agg(F.sum("bytes")).first()[0] or 0
    # whole families in groups of a few MB
    count = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // GROUP_BYTES))
    told = texts.join(small.select("node", F.col("node").alias("comp"), "family", F.lit(-1).alias("side"), F.pmod(F.xxhash64("family"), F.lit(count)).alias("grp")), "node")
    if large.isEmpty():
        return components(_in_blocks(told, threshold), "x", "y")
    wide = stored(speaking.join(family.join(large, "family", "left_semi").select("node"), "node", "left_semi").select("node", "bands"))
    labels = rounds(wide, texts, threshold, block_docs)
    inside = wide.join(labels, "node").select("node", "comp", F.posexplode("bands").alias("band", "key"))
    left = inside.join(_apart(inside), ["band", "key"]).select("node", "comp").distinct()
    met = meetings(stored(left.join(family, "node")), block_docs).join(texts, "node")
    linked = components(_in_blocks(told.unionByName(met), threshold).distinct(), "x", "y")
    # what the rounds have joined is one node here
    of = labels.join(linked.select(F.col("node").alias("comp"), F.col("component").alias("to")), "comp", "left")
    return linked.join(labels, "node", "left_anti").union(of.select("node", F.coalesce("to", "comp")))


def _classified(docs: DataFrame, id_col: str, text_col: str, threshold: float, block_docs: int) -> DataFrame:
    """(id, row, rep, component, kept) of every row; rep and component null for rows without shingles or id."""
    signed = stored(signatures(docs, id_col, text_col))
    full = signed.filter("content is not null")
    classes = full.groupBy("content").agg(F.min("id").alias("rep"))
    linked = links(signed, docs, id_col, text_col, threshold, block_docs)
    of = classes.join(linked.withColumnRenamed("node", "content"), "content", "left").select("content", "rep", F.coalesce("component", "content").alias("component")).checkpoint()
    first = of.groupBy("component").agg(F.min(F.struct("rep", "content")).alias("first"))
    of = of.join(first, "component").select("content", "rep", F.col("first.rep").alias("component"), F.col("first.content").alias("keeps"))
    out = signed.select("id", "row", "content").join(of, "content", "left")
    kept = F.coalesce((F.col("content") == F.col("keeps")) & (F.col("id") == F.col("component")), F.lit(True))
    return out.select("id", "row", "rep", "component", kept.alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, block_docs: int = 500) -> DataFrame:
    """One row a document: id, class_id (smallest id of equal content), component_id (smallest id of its near-duplicate class), kept.

    ``kept`` marks one document a component (all rows alike in id and text to it): the one whose id is component_id.
    """
    out = _classified(docs, id_col, text_col, threshold, block_docs)
    return out.select(F.col("id").alias(id_col), F.coalesce("rep", "id").alias("class_id"), F.coalesce("component", "id").alias("component_id"), "kept")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, block_docs: int = 500) -> DataFrame:
    """``docs`` with one row of each near-duplicate class; rows with a null id stay, of rows alike in id and text one stays."""
    out = stored(_classified(docs, id_col, text_col, threshold, block_docs))
    gone, key = out.filter("not kept").select("row").distinct(), fresh(docs, "key")[0]
    marked = docs.withColumn(key, row_key(col(id_col), col(text_col))).join(gone.withColumnRenamed("row", key), key, "left_anti")
    twice = out.filter("id is not null").groupBy("id", "row").agg(F.count("*").alias("n")).filter("n > 1").select("row").distinct()
    if not twice.isEmpty():
        again = marked.join(twice.withColumnRenamed("row", key), key, "left_semi").dropDuplicates([key])
        marked = marked.join(twice.withColumnRenamed("row", key), key, "left_anti").unionByName(again)
    return marked.select(*[col(c) for c in docs.columns])
