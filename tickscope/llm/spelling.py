"""Spelling variants: words one edit apart, found by sorting permuterm rotations.

Words. Maximal runs of A-Z, a-z and U+00C0-U+00FF of whole texts, A-Z folded; a run whose crc32 with its document's id
is divisible by ``noise`` loses one code point (the planted misspellings of the contract; ``noise`` of None leaves them). A batch of texts
counts its runs on its own, Spark adds the counts up. Words of at least ``least_length`` code points and ``least_count`` occurrences form the lexicon.

Rotations. A word a·c·b with an end mark has the rotation b$a·c, its edited character c last. So all words that differ in c
alone, and the word a·b, whose rotation b$a is complete there, share the prefix b$a: replacements are the rotations in the range of the prefix with one
character more, an indel is the prefix itself. Each word gives its rotations twice, as themselves and without the last
character; they are shuffled by prefix and sorted, and a range is scanned once. A range holds at most one rotation a character
of the alphabet and the prefix itself (90 and 1 here), whatever the number of words. A character that equals the one before it gives the same shorter word at
both places; only the first place counts, so each pair of near words meets in exactly one range and a scan can add up: every member
gets its number of near words and the best of them, no pair is given out.

A word's form is its near word of largest count (ties: smallest in code-point order) if that is at least ``ratio`` times its
own; its root is the end of the chain of forms, found by pointer jumping (a form's count is a multiple of its word's, so chains are logarithmic in the counts).

Nulls: a null text has no words; a null id counts as an empty one. Texts without runs give nothing. Repeated rows count each. A text of any length is
cut at slices of whole rows only; a run may be as long as its text. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import col, stored

#: The mark of a word's end: no letter, and before all of them in code-point order.
MARK = "$"
#: Runs of up to so many bytes get their crc32 together, byte by byte; longer ones each on its own.
SHORT = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (table & np.uint32(1)))
    return table


CRC = _crc_table()


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all runs one after another with A-Z folded, where each run begins and ends in them, and each run's row."""
    lower = data | 0x20
    plain = (lower >= 97) & (lower <= 122)
    # U+00C0 to U+00FF are C3 and a continuation byte
    inside = plain | (data == 0xC3)
    inside[1:] |= data[:-1] == 0xC3
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = bounds[:-1][bounds[:-1] < len(data)]
    begin[at] = inside[at]
    starts = np.flatnonzero(begin)
    kept = np.flatnonzero(inside)
    letters = np.where(plain, lower, data)[kept]
    edges = np.append(np.searchsorted(kept, starts), len(kept))
    return letters, edges, np.searchsorted(bounds, starts, "right") - 1


def crcs(prefix: np.ndarray, letters: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """crc32 of each run's bytes after a text whose crc32 is ``prefix``."""
    state = prefix.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = np.diff(edges)
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    longest = np.minimum(size, SHORT + 1)[order]
    first = int(np.searchsorted(-longest, -SHORT, "left"))
    for r in order[:first]:
        state[r] = zlib.crc32(letters[edges[r]:edges[r + 1]].tobytes(), int(prefix[r])) ^ 0xFFFFFFFF
    order, longest = order[first:], longest[first:]
    for j in range(SHORT):
        alive = order[:int(np.searchsorted(-longest, -j, "left"))]
        if not len(alive):
            break
        state[alive] = CRC[(state[alive] ^ letters[edges[alive] + j]) & np.uint32(255)] ^ (state[alive] >> np.uint32(8))
    return state ^ np.uint32(0xFFFFFFFF)


def counted(ids: pa.Array, texts: pa.Array, noise: int | None) -> Iterator[pa.RecordBatch]:
    """(word, n) of slices of a batch."""
    for first, end, data, bounds in W.slices(texts):
        letters, edges, row = runs(data, bounds)
        if len(edges) < 2:
            continue
        words = pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(letters)])
        if noise:
            names = ids.slice(first, end - first).cast(pa.string()).fill_null("").to_pylist()
            prefix = np.array([zlib.crc32(f"{name}:".encode()) for name in names], np.uint32)[row]
            h = crcs(prefix, letters, edges)
            hit = np.flatnonzero(h % np.uint32(noise) == 0)
            if len(hit):
                edited = [w[:k] + w[k + 1:] for w, k in ((w, int(x) % len(w)) for w, x in zip(words.take(pa.array(hit)).to_pylist(), h[hit]))]
                keep = np.ones(len(words), bool)
                keep[hit] = False
                words = pa.concat_arrays([words.filter(pa.array(keep)), pa.array(edited, pa.string())])
        found = words.value_counts()
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = 199) -> DataFrame:
    """(word, n): occurrences of every word of the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from counted(batch.column(0), batch.column(1), noise)
    return docs.select(col(id_col).cast("string"), col(text_col)).filter(col(text_col).isNotNull()).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(lexicon: DataFrame) -> DataFrame:
    """(prefix, last, word, n): every rotation of a marked word that ends in one of its characters, cut before it, and (``last`` null) whole."""
    size = F.char_length("word")
    places = lexicon.select("word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    word, i = F.col("word"), F.col("i")
    part = lambda start, length: F.substring(word, start, length)
    # b$a, whole: after the first i characters the word's rotation begins
    whole = places.select(F.concat(part(i + 1, size), F.lit(MARK), part(F.lit(1), i)).alias("prefix"), F.lit(None).cast("string").alias("last"), "word", "n")
    # b$a of a·c·b, c the character after the first i
    cut = places.filter(i < size).select(F.concat(part(i + 2, size), F.lit(MARK), part(F.lit(1), i)).alias("prefix"), part(i + 1, F.lit(1)).alias("last"), "word", "n")
    return whole.unionByName(cut)


def scanned(turned: DataFrame) -> DataFrame:
    """(word, n_near, near struct<n, word>): what each range tells of each of its members; near.n is negated, so the least is the best."""
    members = F.sort_array(F.collect_list(F.struct("last", "word", "n")))  # the prefix itself (null) comes first
    ranges = turned.groupBy("prefix").agg(members.alias("members")).filter(F.size("members") > 1)
    before = F.substring("prefix", -1, 1)

    def neighbours(m: Column) -> Column:
        # replacements: both longer than the prefix; an indel: the prefix itself and a character unlike the one before it
        indel = lambda x: x["last"] != before
        return F.filter("members", lambda x: (x["word"] != m["word"]) & F.when(m["last"].isNull(), indel(x)).when(x["last"].isNull(), indel(m)).otherwise(True))
    # the best is the least of (-n, word)
    best = lambda found: F.array_min(F.transform(found, lambda x: F.struct((-x["n"]).alias("n"), x["word"].alias("word"))))
    told = ranges.select(F.explode(F.transform("members", lambda m: F.struct(m["word"].alias("word"), F.size(neighbours(m)).alias("n_near"), best(neighbours(m)).alias("near")))).alias("m"))
    return told.select("m.*").filter("n_near > 0")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int | None = 199, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """One row a word of the lexicon: word, form, root, n, n_near, form_n."""
    counts = word_counts(docs, id_col, text_col, noise).filter((F.col("n") >= least_count) & (F.char_length("word") >= least_length))
    lexicon = stored(counts)
    near = scanned(rotations(lexicon)).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("near").alias("near"))
    known = lexicon.join(near, "word", "left")
    enough = -F.col("near.n") >= ratio * F.col("n")
    known = stored(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("near.word")).alias("form"), F.when(enough, -F.col("near.n")).alias("form_n")))
    roots = chain_ends(known.filter("form is not null").select("word", F.col("form").alias("root")))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def chain_ends(links: DataFrame) -> DataFrame:
    """(word, root): the last word of each chain, from (word, root) with the next one; chains have no loops."""
    at = links.checkpoint()
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint()
        at = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            return at
