"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model of order ``order`` (3) with Dirichlet smoothing at each order. With c() the training counts,
N tokens and V distinct tokens, and h' the history h without its first token:

    p(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | h) = (c(h w) + K p(w | h')) / (c(h) + K)

where h is the last order - 1 tokens; before a text's first token stands the edge, so early histories are shorter.

As an automaton: the root and one state a history seen in training. A seen n-gram h w is an arc out of
h with the weight p(w | h). Any other word takes h's failure arc, of weight K / (c(h) + K), to the state h', whose
failure arc leads on, down to the root with the arc of w, of weight p(w); words never seen in training share the root's last
arc. Reading w leads to the state of the longest seen history that the text now ends in. One traversal from left to right carries the
state and adds up log10 weights; failure arcs are followed for all tokens of a block at once, one order a step.

The automaton of a whole corpus fits no single memory, so it's never gathered: each block of
documents gets the part that its own texts can reach. Documents are dealt into blocks of about ``block_bytes`` by hash.
A block asks for its distinct n-grams of each order, with the counts of its training documents, by hash
range; for each range, the counts are added up over all blocks and sent back in the order asked.
The block then builds its part of the automaton and traverses its texts. Requests and replies grow in
proportion to the input and hold each n-gram once a block, however frequent it is; there is a range for each ``range_bytes`` of text.

Tokens are runs of non-blanks with A-Z folded, then one end token a document (so a document without words has one token).
Words are known by 64-bit hashes, longer n-grams by 56 bits of one (of n distinct ones, about n² / 2^57 pairs are taken for one). A text larger than a block is in a block of its own size.

Nulls: a null text counts as empty; a row whose ``learn`` is null or false is scored, not learned
from. Repeated rows each count and each get a score. Without any training row N = V = 0 and
every token has the root's last arc, 0.5 / 0.5. Rows are dealt by id and text, so null ids are spread. An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import col, row_key, total_bytes

#: The end token, and the state before a text's first word.
END, EDGE = W.U64(0x5851F42D4C957F2D), W.U64(0x14057B7EF767814F)
#: Bits of a hash that an n-gram of several tokens is known by.
GRAM_BITS = 56


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as differences of as few bytes each as the largest needs."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=W.U64(0))
    width = max(1, -(-int(steps[1:].max() if len(keys) > 1 else 0).bit_length() // 8))
    body = np.ascontiguousarray(steps[1:]).view(np.uint8).reshape(-1, 8)[:, :width]
    # byte by byte, so that the shuffle's compression finds equal bytes side by side
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(body.T).tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, W.U64)
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(width, -1).T
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[1:, :width] = body
    out = steps.reshape(-1).view(W.U64)
    out[0] = np.frombuffer(blob, W.U64, 1, 1)[0]
    return np.cumsum(out, dtype=W.U64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Two bits a count: 0, 1, 2, or 3 for those that follow, in as few bytes each as the largest needs."""
    if not len(counts):
        return b""
    codes = np.zeros(-(-len(counts) // 4) * 4, np.uint8)
    codes[:len(counts)] = np.minimum(counts, 3)
    four = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    large = np.ascontiguousarray(counts[counts >= 3].astype(W.U64))
    width = max(1, -(-int(large.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(large.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(counts).to_bytes(4, "little") + bytes([width]) + np.bitwise_or.reduce(four, axis=1).tobytes() + planes.tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, W.U64)
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    four = np.frombuffer(blob, np.uint8, -(-n // 4), 5)
    out = ((four[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3).reshape(-1)[:n].astype(W.U64)
    planes = np.frombuffer(blob, np.uint8, offset=5 + len(four)).reshape(width, -1).T
    large = np.zeros((len(planes), 8), np.uint8)
    large[:, :width] = planes
    out[out == 3] = large.reshape(-1).view(W.U64)
    return out


def tokens(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end token of each text included, and each text's range of them."""
    parts, sizes = [], []
    for _, _, data, bounds in W.slices(column):
        starts, ends, ranges = W.words(data, bounds)
        hashes = W.word_hashes(data, starts, ends, lower=True)
        parts.append(np.insert(hashes, ranges[1:], END))
        sizes.append(np.diff(ranges) + 1)
    return np.concatenate([*parts, np.zeros(0, W.U64)]), np.append(0, np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))).astype(np.int64)


def before(values: np.ndarray, ranges: np.ndarray, first: int | bool) -> np.ndarray:
    """The value of the token before each token; ``first`` at a text's start."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[ranges[:-1]] = first
    return out


def grams(words: np.ndarray, ranges: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``order``: the key of the n-gram that ends at each token, and whether there is one (the edge counts as a token before the first)."""
    out = [(words, np.ones(len(words), bool))]
    for k in range(2, order + 1):
        keys, has = out[-1]
        out.append((W.mix(before(keys, ranges, EDGE) * W.U64(0xD1342543DE82EF95) + words, 50 + k) >> W.U64(64 - GRAM_BITS), before(has, ranges, k == 2)))
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and where each key is among them."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(new) - 1
    return ordered[new], where


def by_range(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of the key space begins in sorted keys, and their end."""
    edges = np.array([(k << bits) // ranges for k in range(1, ranges)], W.U64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def requests(table: pa.Table, ranges: int, order: int) -> pa.Table:
    """What a block asks of each range: its n-grams of each order (g1, g2 ...), with the counts of its training documents (n1, n2 ...)."""
    words, of = tokens(table["text"])
    learn = np.repeat(table["learn"].to_numpy(), np.diff(of))
    blobs = {}
    for k, (keys, has) in enumerate(grams(words, of, order), 1):
        unique, where = distinct(keys[has])
        counts = np.bincount(where[learn[has]], minlength=len(unique))
        at = by_range(unique, 64 if k == 1 else GRAM_BITS, ranges)
        blobs[f"g{k}"] = pa.array([pack(unique[a:b]) for a, b in zip(at, at[1:])], pa.binary())
        blobs[f"n{k}"] = pa.array([pack_counts(counts[a:b]) for a, b in zip(at, at[1:])], pa.binary())
    return pa.table({"range": pa.array(range(ranges), pa.int32()), **blobs})


def totals(key_blobs: list[bytes], count_blobs: list[bytes]) -> tuple[list[bytes], int, int]:
    """Each request's counts added up over all requests of a range; the sum and number of those above 0."""
    keys = [unpack(b) for b in key_blobs]
    unique, where = distinct(np.concatenate(keys))
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, where, np.concatenate([unpack_counts(b) for b in count_blobs]).astype(np.int64))
    bounds = np.cumsum([0, *map(len, keys)])
    return [pack_counts(total[where[a:b]]) for a, b in zip(bounds, bounds[1:])], int(total.sum()), int((total > 0).sum())


def traverse(words: np.ndarray, of: np.ndarray, counts: list[np.ndarray], n: int, v: int, starts: int, k: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Builds the part of the automaton that a block reaches, and runs its texts through it.

    words, of: the block's tokens and each text's range of them; counts: for each order, the training
    counts of its distinct n-grams in sorted order. Returns each text's known tokens, base score and score.
    """
    seen = []
    for (keys, has), count in zip(grams(words, of, len(counts)), counts):
        at = np.zeros(len(words))
        at[has] = count[distinct(keys[has])[1]]
        seen.append(at)
    # how often training left the state of each history: as often as it came by, every history being followed by a token
    left = [before(at, of, starts if not k_ else 0) for k_, at in enumerate(seen[:-1])]
    arcs = [(seen[0] + 0.5) / (n + 0.5 * (v + 1))]
    for at, visits in zip(seen[1:], left):
        arcs.append((at + k * arcs[-1]) / (visits + k))
    # the traversal: each token is read in the longest seen history, and fails down until an arc takes it
    weight, waits = np.zeros(len(words)), np.ones(len(words), bool)
    for at, visits, arc in zip(seen[:0:-1], left[::-1], arcs[:0:-1]):
        state = waits & (visits > 0)
        reads = state & (at > 0)
        fails = state & ~reads
        weight[reads] += np.log10(arc[reads])
        weight[fails] += np.log10(k / (visits[fails] + k))
        waits &= ~reads
    weight[waits] += np.log10(arcs[0][waits])
    add = lambda x: np.add.reduceat(x, of[:-1]) if len(of) > 1 else np.zeros(0)
    return add((seen[0] > 0).astype(np.int64)).astype(np.int64), add(np.log10(arcs[0])), add(weight)


def _blocks(docs: DataFrame, learn: Column, id_col: str, text_col: str, block_bytes: int, range_bytes: int = 32 << 20) -> tuple[DataFrame, int, int]:
    """(id, text, learn, block) dealt by block; the number of blocks and of ranges."""
    total = total_bytes(docs, text_col)
    blocks = max(1, math.ceil(total / block_bytes))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = F.pmod(row_key(col(id_col), col(text_col)), F.lit(blocks)).cast("int")
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"), deal.alias("block"))
    return rows.repartition(max(partitions, blocks // 4), "block"), blocks, max(partitions, math.ceil(total / range_bytes))


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3, k: float = 8.0, block_bytes: int = 8 << 20, range_bytes: int = 32 << 20) -> DataFrame:
    """One row a document: id, learned, n_tokens, n_known, train_tokens, base_score, score (see the module's text)."""
    if order < 2:
        raise ValueError("order of at least 2")
    rows, blocks, ranges = _blocks(docs, learn, id_col, text_col, block_bytes, range_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    orders = range(1, order + 1)

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        out = requests(table, ranges, order)
        starts = pa.array([int(table["learn"].to_numpy().sum()) if r == 0 else 0 for r in range(ranges)], pa.int64())
        return out.append_column("starts", starts).add_column(0, "block", pa.array([key[0].as_py()] * len(out), pa.int32()))
    asked = rows.groupBy("block").applyInArrow(ask, "block int, range int, " + ", ".join(f"g{j} binary, n{j} binary" for j in orders) + ", starts bigint")

    def reply(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        long = lambda x: pa.array([x] * len(table), pa.int64())
        out, known = {}, []
        for j in orders:
            counts, n, v = totals(table[f"g{j}"].to_pylist(), table[f"n{j}"].to_pylist())
            out[f"n{j}"] = pa.array(counts, pa.binary())
            known.append((n, v))
        return pa.table({"block": table["block"], "range": table["range"], **out, "n": long(known[0][0]), "v": long(known[0][1]), "starts": long(sum(table["starts"].to_pylist()))})
    # as many partitions as ranges: a task holds one range
    replies = asked.repartition(ranges, "range").groupBy("range").applyInArrow(reply, "block int, range int, " + ", ".join(f"n{j} binary" for j in orders) + ", n bigint, v bigint, starts bigint")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table, got: pa.Table) -> pa.Table:
        got = got.sort_by("range")
        words, of = tokens(table["text"])
        counts = [np.concatenate([unpack_counts(b) for b in got[f"n{j}"].to_pylist()]).astype(np.float64) for j in orders]
        n, v, starts = (sum(got[c].to_pylist()) for c in ("n", "v", "starts"))
        known, base, full = traverse(words, of, counts, n, v, starts, k)
        return pa.table({id_col: table["id"], "learned": table["learn"], "n_tokens": pa.array(np.diff(of)), "n_known": pa.array(known),
                         "train_tokens": pa.array(np.full(len(known), n)), "base_score": pa.array(base), "score": pa.array(full)})
    together = rows.groupBy("block").cogroup(replies.groupBy("block"))
    return together.applyInArrow(run, f"`{id_col}` {kind}, learned boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
