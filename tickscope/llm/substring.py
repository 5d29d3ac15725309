"""Substring dedup with prefix-partitioned suffix trees.

A window is ``length`` consecutive words of a document. A window is removed from a document, and with
it each word it covers, if the same word sequence also starts in a document of smaller id. Those sequences are
the string-depth ``length`` cut of the corpus suffix tree: all suffixes below one node of that depth share
their first ``length`` words, and the smallest id below the node decides.

The tree is never built whole:
1. Prefixes. In each window one run of PREFIX words (the one of the smallest hash, leftmost on a tie) is its
   anchor; equal windows have equal anchors at equal places, so a node's suffixes share an anchor. Anchors
   (about one in ten words) are counted over the corpus; those of one document only can't begin a repeat.
2. Groups. The suffixes of repeated anchors are dealt by anchor into groups of about ``group_bytes``.
   What moves is, for each anchor, the stretch of text that holds its windows. An anchor with more than ``hot``
   occurrences, too many for one group, is given the longest prefix instead: its suffixes are dealt by
   their whole first ``length`` words, where the node is the group and a minimum with map-side combine is enough.
3. Subtrees. A group's suffixes are refined by prefix doubling (names of depth 1, 2, 4, ... up to
   ``length``: the nodes of the truncated suffix tree, level by level), equal stretches being
   treated once. The nodes of depth ``length`` hold the smallest id of their suffixes.
4. The covered words come back to the documents, which are read again, whole.

Words are runs of non-blanks, unchanged, compared by 64-bit hashes. Ids are integers. A null text counts as
empty; a row with null id neither removes nor loses words. Rows of equal id never remove each other's words; rows alike in
id and text get the same result each. Texts of fewer than ``length`` words are kept. Empty tables give empty
results; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import col, list_array, row_key, stored

PREFIX = 20
#: Bits of an anchor's number that hold its place; the rest order anchors by hash.
PLACE = 26


def window_anchors(hashes: np.ndarray, ranges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window (rows not crossed): its first word and its anchor's; and the hashes of all runs of PREFIX words."""
    prefix = min(PREFIX, length)
    grams = W.gram_hashes(hashes, prefix)
    if len(hashes) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
    place = np.arange(len(grams)).astype(W.U64)
    best = W.window_min(((grams >> W.U64(PLACE)) << W.U64(PLACE)) | place, length - prefix + 1)
    last = np.repeat(ranges[1:], np.diff(ranges))[:len(best)]  # end of the row of each window's first word
    first = np.flatnonzero(np.arange(len(best)) + length <= last)
    return first, (best[first] & W.U64((1 << PLACE) - 1)).astype(np.int64), grams


def _hashed(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for first, end, data, bounds in W.slices(column):
        starts, ends, ranges = W.words(data, bounds)
        yield first, end, data, starts, ends, ranges, W.word_hashes(data, starts, ends)


def anchors(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor hash, places) of a batch: each row's distinct anchors and at how many places they are chosen."""
    rows, hashes, places = [], [], []
    for first, _, _, _, _, ranges, h in _hashed(column):
        _, anchor, grams = window_anchors(h, ranges, length)
        anchor = np.unique(anchor)
        row, gram = np.searchsorted(ranges, anchor, "right") - 1, grams[anchor] if len(anchor) else grams[:0]
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        rows.append(first + row[new])
        hashes.append(gram[new])
        places.append(np.diff(np.append(np.flatnonzero(new), len(new))))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, W.U64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(places)


def stretches(column: pa.Array, repeated: pa.ListArray, is_hot: pa.ListArray, length: int) -> Iterator[tuple]:
    """Of each row's windows with a repeated anchor, a slice of rows at a time: (rows, anchors, first windows, window counts, texts) of
    its stretches, and, of hot anchors, (rows, window hashes, covered word ranges): one row a document and distinct window."""
    wanted, flags = repeated.flatten().to_numpy().view(W.U64), is_hot.flatten().to_numpy(zero_copy_only=False)
    lengths = np.append(0, np.cumsum(repeated.value_lengths().to_numpy()))
    for first, end, data, starts, ends, ranges, h in _hashed(column):
        window, anchor, grams = window_anchors(h, ranges, length)
        if not len(window):
            continue
        row = np.searchsorted(ranges, window, "right") - 1
        own, hot = wanted[lengths[first]:lengths[end]], flags[lengths[first]:lengths[end]]
        # a row's anchors as one number: mixed with the row, so that one search does
        owner = np.repeat(np.arange(end - first), np.diff(lengths[first:end + 1])).astype(W.U64)
        keys = W.mix(own ^ W.mix(owner, 70), 71)
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        gram = grams[anchor]
        key = W.mix(gram ^ W.mix(row.astype(W.U64), 70), 71)
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        found = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        heavy = found & hot[at] if len(keys) else found
        if heavy.any():
            yield None, _whole_windows(first + row[heavy], W.gram_hashes(h, length)[window[heavy]], window[heavy] - ranges[:-1][row[heavy]], length)
        light = np.flatnonzero(found & ~heavy)
        if len(light):
            # a run of consecutive windows with one anchor is one stretch
            new = np.append(True, (np.diff(window[light]) != 1) | (np.diff(anchor[light]) != 0))
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(light)))
            a, b = window[light[head]], window[light[head]] + count - 1 + length
            raw = data.tobytes()
            texts = [raw[x:y] for x, y in zip(starts[a].tolist(), ends[b - 1].tolist())]
            r = row[light[head]]
            yield (first + r, gram[light[head]], a - ranges[:-1][r], count, texts), None


def _whole_windows(row: np.ndarray, whole: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Rows and hashes of the distinct windows of each row, and the word ranges (from, to, ...) that each one's places cover, joined."""
    order = np.lexsort((first, whole, row))
    row, whole, first = row[order], whole[order], first[order]
    new = np.append(True, (row[1:] != row[:-1]) | (whole[1:] != whole[:-1]))
    cut = new | np.append(True, np.diff(first) > length)
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(first)) - 1
    covered = np.stack([first[begin], first[end] + length], 1).reshape(-1).astype(np.int32)
    at = np.flatnonzero(new)
    return row[at], whole[at], list_array(covered, 2 * np.diff(np.append(np.searchsorted(begin, at), len(begin))))


def _double(names: np.ndarray, step: int) -> np.ndarray:
    """Names of the suffixes at a depth greater by ``step``, from names at the present depth."""
    pair = np.full(len(names), -1, np.int64)
    if len(names) > step:
        pair[:-step] = names[:-step] * (int(names.max()) + 1) + names[step:]
    return np.unique(pair, return_inverse=True)[1]


def subtree(texts: pa.Array, counts: np.ndarray, ids: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(stretch, smallest id below the depth-``length`` node of each of its windows) for the distinct stretches' suffixes; ids: smallest of each stretch."""
    data, bounds = W.text_bytes(texts)
    starts, ends, ranges = W.words(data, bounds)
    names = np.unique(W.word_hashes(data, starts, ends), return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < length:
        step = min(depth, length - depth)
        names = _double(names, step)
        depth += step
    stretch = np.repeat(np.arange(len(counts)), counts)
    suffix = ranges[:-1][stretch] + np.arange(len(stretch)) - np.repeat(np.cumsum(counts) - counts, counts)
    node = names[suffix]
    least = np.full(int(names.max()) + 1 if len(names) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, node, ids[stretch])
    below, at = least[node], np.append(0, np.cumsum(counts))
    for s in range(len(counts)):
        yield s, below[at[s]:at[s + 1]]


def cover(firsts: np.ndarray, length: int) -> list[int]:
    """Word ranges (from, to, from, to, ...) that windows with these first words (rising) cover, joined."""
    if not len(firsts):
        return []
    cut = np.flatnonzero(np.diff(firsts) > length)
    return np.stack([firsts[np.append(0, cut + 1)], firsts[np.append(cut, len(firsts) - 1)] + length], 1).reshape(-1).tolist()


def repeats_in_group(table: pa.Table, length: int) -> pa.Table:
    """Word ranges to remove (key, ranges) from a group's stretches (key, id, first, count, text)."""
    table = table.combine_chunks()
    texts, ids, counts, firsts = table["text"].chunk(0), table["id"].to_numpy(), table["count"].to_numpy(), table["first"].to_numpy()
    data, bounds = W.text_bytes(texts)
    starts, ends, ranges = W.words(data, bounds)
    h = W.word_hashes(data, starts, ends)
    place = W.mix(np.arange(len(h)).astype(W.U64) - np.repeat(ranges[:-1], np.diff(ranges)).astype(W.U64), 80)
    content = np.add.reduceat(W.mix(h ^ place, 81), ranges[:-1])
    _, speaker, same = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(speaker), np.iinfo(np.int64).max)
    np.minimum.at(least, same, ids)
    members = np.argsort(same, kind="stable")
    begin = np.append(0, np.cumsum(np.bincount(same, minlength=len(speaker))))
    keys, out = [], []
    for s, below in subtree(texts.take(pa.array(speaker)), counts[speaker], least, length):
        low = below.min()
        for m in members[begin[s]:begin[s + 1]]:
            if low < ids[m]:
                keys.append(m)
                out.append(cover(firsts[m] + np.flatnonzero(below < ids[m]), length))
    return pa.table({"key": table["key"].take(pa.array(keys, pa.int64())), "ranges": pa.array(out, pa.list_(pa.int32()))})


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, hot: int = 5000, group_bytes: int = 3 << 20) -> DataFrame:
    """One row a document: id, n_words, n_removed, kept (the kept words joined by one space)."""
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"), row_key(col(id_col), col(text_col)).alias("key"))
    usable = F.col("id").isNotNull() & F.col("text").isNotNull()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, anchor, places = anchors(batch.column(1), length)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(anchor.view(np.int64)), pa.array(places)], names=["id", "key", "anchor", "places"])
    seen = stored(rows.filter(usable).mapInArrow(find, "id bigint, key bigint, anchor bigint, places bigint"))
    many = seen.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("places").alias("n")).filter("low < high")
    many = stored(many.select("anchor", "n"))
    groups = max(1, (many.filter(F.col("n") <= hot).agg(F.sum("n")).first()[0] or 0) * 10 * length // group_bytes)
    hits = seen.select("key", "anchor").join(many, "anchor").groupBy("key").agg(F.collect_list(F.struct("anchor", (F.col("n") > hot).alias("hot"))).alias("hits"))
    told = rows.join(hits, "key").select("id", "text", "key", F.col("hits.anchor").alias("anchors"), F.col("hits.hot").alias("hot"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for light, heavy in stretches(batch.column(1), batch.column(3), batch.column(4), length):
                if light:
                    row, anchor, first, count, texts = light
                    n, at = len(row), pa.array(row)
                    columns = [pa.array((anchor % W.U64(groups)).astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(texts, pa.binary()),
                               pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int32()))]
                else:
                    row, whole, ranges = heavy
                    n, at = len(row), pa.array(row)
                    columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(whole.view(np.int64)), ranges]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *columns], names=["id", "key", "grp", "first", "count", "text", "whole", "ranges"])
    sent = stored(told.mapInArrow(send, "id bigint, key bigint, grp bigint, first int, count int, text binary, whole bigint, ranges array<int>"))
    grouped = sent.filter("grp is not null").select("id", "key", "grp", "first", "count", "text")
    inside = grouped.groupBy("grp").applyInArrow(lambda table: repeats_in_group(table, length), "key bigint, ranges array<int>")
    heavy = sent.filter("whole is not null").select("id", "key", "whole", "ranges")
    nodes = heavy.groupBy("whole").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("whole", "low")
    across = heavy.join(nodes, "whole").filter("low < id").select("key", "ranges")
    removed = inside.unionAll(across).groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    last = rows.join(removed, "key", "left").select("id", "text", "ranges")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, ranges in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                found = (text.as_py() or b"").split()
                total.append(len(found))
                if not ranges.is_valid:
                    gone.append(0)
                    kept.append(b" ".join(found).decode())
                    continue

                pairs = ranges.values.to_numpy().reshape(-1, 2)
                step = np.zeros(len(found) + 1, np.int64)
                np.add.at(step, pairs[:, 0], 1)
                np.add.at(step, pairs[:, 1], -1)
                stay = np.cumsum(step[:-1]) == 0
                gone.append(len(found) - int(stay.sum()))
                kept.append(b" ".join(compress(found, stay)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])
    kind = docs.schema[id_col].dataType
    return last.mapInArrow(clean, "id bigint, n_words bigint, n_removed bigint, kept string").select(F.col("id").cast(kind).alias(id_col), "n_words", "n_removed", "kept")
