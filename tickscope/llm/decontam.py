"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Find the documents that contain a benchmark item: at least ``threshold`` of the item's distinct
five-word shingles occur in the document. An item is short and a document may be long, so their
Jaccard similarity is near zero and plain MinHash can't see the item. The search is therefore
partitioned by size: items fall into classes by their number of shingles (a class reaches up to
GROWTH times its smallest), and for each class a document is cut into windows of about the class's
size that overlap by it, so an item lies whole in one window of nearly its own size and the
similarity of the two is high. A window and an item are a candidate pair when any of
``permutations`` minimum hashes agree (bands of one row: at containment 0.8, class growth 1.5
and 32 permutations a pair is missed with probability under 1e-5); every candidate (document, item) is
then verified on the exact shingle sets of both, whole document included.

Window minima come cheaply: each shingle is hashed once per permutation, minima are taken over
blocks of a third of the smallest item, and windows are minima of whole blocks. A table of marks, addressed by the top
bits of a minimum, passes on the few windows that can match; they are looked up among the items' sorted minima.

The items are a query set. They are read in parts of at most ``part_bytes`` of shingles and
signatures (measured, not guessed), each part broadcast to one map-only pass over the documents; a
larger benchmark means more passes, not a larger broadcast. Documents are never shuffled.

Words are runs of non-blanks with A-Z folded. Items and documents of fewer than five words have no
shingle: such items are never contained, such documents contain nothing. Null texts count as empty.
Items with equal ids or texts are each reported; repeated documents each get their rows. Columns
other than those named are not read. Empty tables give an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import words as W
from .common import WORD, col, map_rows

SHINGLE = 5
GROWTH = 1.5
#: Bytes an item takes in a broadcast part, per shingle and per permutation.
ENTRY_BYTES = 16


@dataclass(frozen=True)
class Keys:
    """The minimum hashes of a class's items under one permutation, sorted, with their items; ``marks`` tells by the
    top bits of a hash whether it can be among them."""
    values: np.ndarray
    items: np.ndarray
    shift: np.uint32
    marks: np.ndarray


@dataclass(frozen=True)
class SizeClass:
    """Windows of ``size`` blocks every ``stride`` blocks, and the keys by permutation."""
    size: int
    stride: int
    keys: tuple[Keys, ...]


@dataclass(frozen=True)
class Part:
    """Some items: their shingles, and for each size class what points to them."""
    permutations: int
    shingles: tuple[np.ndarray, ...]
    block: int
    classes: tuple[SizeClass, ...]


@functools.cache
def _coefficients(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(31)
    return rng.integers(0, 1 << 32, permutations, dtype=np.uint32), rng.integers(0, 1 << 31, permutations, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _permuted(x: np.ndarray, permutation: int, permutations: int) -> np.ndarray:
    """A permutation of 32-bit numbers that are hashes already."""
    flip, times = _coefficients(permutations)
    return (x ^ flip[permutation]) * times[permutation]


def _short(grams: np.ndarray) -> np.ndarray:
    return (grams >> W.U64(32)).astype(np.uint32)


def _keys(values: np.ndarray, items: np.ndarray) -> Keys:
    order = np.argsort(values, kind="stable")
    bits = min(20, max(14, len(values).bit_length() + 5))
    marks = np.zeros(1 << bits, bool)
    marks[values >> np.uint32(32 - bits)] = True
    return Keys(values[order], items[order], np.uint32(32 - bits), marks)


def build_part(texts: list[str | None], permutations: int) -> Part:
    column = pa.array(texts, pa.string())
    data, bounds = W.text_bytes(column)
    starts, ends, ranges = W.words(data, bounds)
    grams, of = W.shingles(W.word_hashes(data, starts, ends, lower=True), ranges, SHINGLE)
    whole = np.diff(ranges)[of] >= SHINGLE
    grams, of = grams[whole], of[whole]
    sets = tuple(np.unique(grams[of == i]) for i in range(len(texts)))
    sizes = np.array([len(s) for s in sets])
    present = sizes[sizes > 0]
    if not len(present):
        return Part(permutations, sets, 1, ())
    block = max(1, int(present.min()) // 3)
    classes, low = [], int(present.min())
    while low <= present.max():
        high = max(low + 1, int(low * GROWTH) + 1)
        members = np.flatnonzero((sizes >= low) & (sizes < high))
        if len(members):
            # a window reaches over the largest item wherever it begins inside a stride
            stride = max(1, low // 3 // block)
            least = [np.array([_permuted(_short(sets[i]), p, permutations).min() for i in members], np.uint32) for p in range(permutations)]
            classes.append(SizeClass(-(-(high - 1) // block) + stride, stride, tuple(_keys(v, members) for v in least)))
        low = high
    return Part(permutations, sets, block, tuple(classes))


def _lookup(keys: Keys, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (index into wanted, item) with equal keys."""
    maybe = np.flatnonzero(keys.marks[wanted >> keys.shift])
    first, last = (np.searchsorted(keys.values, wanted[maybe], side) for side in ("left", "right"))
    n = last - first
    at = np.repeat(maybe, n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return at, keys.items[np.repeat(first, n) + offset]


def candidates(part: Part, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Distinct rows (document, item) whose window and item share a minimum hash; starts: first shingle of each document."""
    counts = np.diff(starts)
    full = np.flatnonzero(counts > 0)
    if not len(full):
        return np.zeros((0, 2), np.int64)
    blocks = -(-counts // part.block)
    doc = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    cut = starts[:-1][doc] + nth * part.block
    # after each document, blocks of all ones: no window touches two; one that begins there reaches the next document
    most = max(c.size for c in part.classes)
    place = np.arange(len(doc)) + doc * most
    owner = np.repeat(np.arange(len(counts) + 1), np.append(blocks, 0) + np.append(0, np.full(len(counts), most)))[:len(doc) + len(counts) * most]
    minima = np.empty(len(owner), np.uint32)
    x, found = _short(grams), []
    for p in range(part.permutations):
        minima.fill(np.iinfo(np.uint32).max)
        minima[place] = np.minimum.reduceat(_permuted(x, p, part.permutations), cut)
        for c in part.classes:
            at, item = _lookup(c.keys[p], W.window_min(minima, c.size)[::c.stride])
            found.append(owner[at * c.stride] * len(part.shingles) + item)
    pairs = np.unique(np.concatenate(found))
    pairs = pairs[pairs < len(counts) * len(part.shingles)]
    return np.stack(np.divmod(pairs, len(part.shingles)), 1)


def search(part: Part, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, item's shingles, of them in the row's text) for all rows of a text column."""
    if not part.classes:
        return
    for first, _, data, bounds in W.slices(column):
        starts, ends, ranges = W.words(data, bounds)
        grams, of = W.shingles(W.word_hashes(data, starts, ends, lower=True), ranges, SHINGLE)
        whole = np.diff(ranges)[of] >= SHINGLE
        grams, of = grams[whole], of[whole]
        begin = np.searchsorted(of, np.arange(len(bounds)))
        last, sets = -1, np.zeros(0, W.U64)
        for d, item in candidates(part, grams, begin):
            if d != last:
                last, sets = d, np.unique(grams[begin[d]:begin[d + 1]])
            own = part.shingles[item]
            at = np.minimum(np.searchsorted(sets, own), len(sets) - 1)
            shared = int((sets[at] == own).sum())
            if shared >= threshold * len(own) - 1e-9:
                yield first + int(d), int(item), len(own), shared


def item_parts(benchmark: DataFrame, item_col: str, item_text_col: str, permutations: int, part_bytes: int) -> Iterator[tuple[list, Part]]:
    """The items in parts of about ``part_bytes``: one part at a time comes to the driver."""
    items = benchmark.select(col(item_col).alias("i"), col(item_text_col).alias("t"))
    weight = F.octet_length(F.coalesce(F.col("t"), F.lit(""))) + ENTRY_BYTES * (F.coalesce(F.regexp_count("t", F.lit(WORD)), F.lit(0)) + permutations)
    parts = -(-(items.agg(F.sum(weight)).first()[0] or 0) // part_bytes)
    for k in range(parts):
        rows = (items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k) if parts > 1 else items).collect()
        yield [r["i"] for r in rows], build_part([r["t"] for r in rows], permutations)


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", threshold: float = 0.8, permutations: int = 32, part_bytes: int = 8 << 20) -> DataFrame:
    """One row a document and contained item: ids, the item's number of shingles, how many the document has, their ratio."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("item", item_kind), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType()), T.StructField("containment", T.DoubleType())])
    read = docs.select(col(id_col), col(text_col))
    out = spark.createDataFrame([], schema)
    item_arrow = to_arrow_type(item_kind)
    for part in item_parts(benchmark, item_col, item_text_col, permutations, part_bytes):
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, items = shared.value
            for batch in batches:
                hits = list(search(items, batch.column(1), threshold))
                at, item, n, both = (np.array(x, np.int64) for x in zip(*hits)) if hits else [np.zeros(0, np.int64)] * 4
                names = pa.array(ids, item_arrow).take(pa.array(item))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), names, pa.array(n), pa.array(both), pa.array(both / np.maximum(n, 1))], names=schema.names)
        out = out.unionAll(read.mapInArrow(run, schema))
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", threshold: float = 0.8,
          permutations: int = 32, part_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without the rows that contain an item: map only, all columns kept."""
    at = docs.columns.index(text_col)
    for _, part in item_parts(benchmark, item_text_col, item_text_col, permutations, part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stay = np.ones(len(batch), bool)
                stay[[row for row, *_ in search(shared.value, batch.column(at), threshold)]] = False
                yield batch.filter(pa.array(stay))
        docs = map_rows(docs, run)
    return docs
