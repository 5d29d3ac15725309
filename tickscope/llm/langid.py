"""Language identification by prediction by partial matching (PPM) on bytes.

For each language a context tree of bytes is learned: contexts of ``order``, ..., 1, 0 bytes
with the counts of the byte that follows. A context gives a seen byte c / (n + q) and the
escape q / (n + q) (n: occurrences, q: distinct followers); the escape's share goes to the
bytes not seen there in proportion to the next shorter context, down to the uniform
distribution. So every context holds a full distribution, and the frozen trees give the exact
code length of any text. The language with the shortest code wins.

Training reads every labelled row, counts in Spark, and gathers only the counts: at most languages x
contexts x bytes, however many rows there are. The trees are laid out as one table of code lengths (context x next byte) a language and broadcast; fit()
raises if that table would pass ``max_model_bytes``. Prediction is map only over whole texts.

Nulls: rows without text or label are not learned from; a null text, or one without a letter, is
predicted as ``und`` with score 0, as is every text if nothing could be learned. Ties go to the
language first by name. Columns other than those named are not read.

The score compares languages only: its gaps grow with the length of a text, whatever the text. Whether a text
is in a learned language at all is decided by recognised(), from a figure that doesn't grow with length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .common import col, fresh, map_rows

UNKNOWN = "und"
#: What stands before a text's first byte.
EDGE = 0x20
#: Letters are A-Z, a-z and all bytes above ASCII; only their code lengths make rates, so unusual punctuation and digits don't.
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
#: Letters whose mean code length is one rate; a text's rate is the median of its blocks', so foreign inserts below half of it don't count.
BLOCK = 8
#: A text may lie so many spreads of its language's block rates above their median; fewer letters than a block widen this by the square root.
SPREADS = 8.0
#: Code lengths are 0 to 100 bits a byte, their histogram's bins BIN wide; a limit needs LEAST_BLOCKS blocks.
BIN, BINS, LEAST_BLOCKS = 0.02, 5000, 30
#: recognised() learns only what so many texts of a language hold.
LEAST_TEXTS = 2


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    return table


LOWER = _lower()


@dataclass(frozen=True)
class Model:
    """Code lengths in bits: ``bits[language, row_of[context], symbol_of[byte]]``, order 2."""
    languages: tuple[str, ...]
    symbol_of: np.ndarray
    row_of: np.ndarray
    bits: np.ndarray


def _contexts(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes, and the two folded bytes before each (EDGE before a text)."""
    b = LOWER[data].astype(np.int32)
    one, two = np.empty_like(b), np.empty_like(b)
    one[1:], two[2:] = b[:-1], b[:-2]
    first = bounds[:-1][np.diff(bounds) > 0]
    one[first] = two[first] = EDGE
    second = bounds[:-1][np.diff(bounds) > 1] + 1
    two[second] = EDGE
    return b, two << 8 | one


def gram_counts(rows: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n, texts): how often and in how many texts a byte follows two bytes, gram = two bytes before << 8 | byte."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).dictionary_encode()
            names, code = labels.dictionary, labels.indices.to_numpy().astype(np.int64)
            for first, end, data, bounds in W.slices(batch.column(0)):
                b, context = _contexts(data, bounds)
                once = np.sort((context << 8 | b).astype(np.int64) << 32 | np.repeat(np.arange(end - first), np.diff(bounds)))
                at = np.flatnonzero(np.append(True, once[1:] != once[:-1])[:len(once)])  # a gram and a text
                cell = (once[at] >> 32) * len(names) + code[first:end][once[at] & 0xFFFFFFFF]
                order = np.argsort(cell, kind="stable")
                cell, times = cell[order], np.diff(np.append(at, len(once)))[order]
                to = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[:len(cell)])  # a gram and a language
                n, texts = np.add.reduceat(times, to) if len(to) else times, np.diff(np.append(to, len(cell)))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(cell[to] % len(names))).cast(pa.string()), pa.array((cell[to] // len(names)).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(texts.astype(np.int64))],
                                                 names=["lang", "gram", "n", "texts"])
    counted = rows.select(col(text_col), col(lang_col).alias("lang")).mapInArrow(run, "lang string, gram int, n bigint, texts bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))


def _escape(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Distributions of contexts (rows of counts), given those of the contexts one byte shorter."""
    n, seen = counts.sum(1, keepdims=True), counts > 0
    q = seen.sum(1, keepdims=True)
    rest = np.where(seen, 0, shorter)
    left = rest.sum(1, keepdims=True)
    full = np.where(left > 0, 1.0, n / np.maximum(n + q, 1))  # a context that has seen every byte never escapes
    total = np.maximum(n + q, 1) * full
    out = np.where(seen, counts / np.where(total > 0, total, 1), rest / np.where(left > 0, left, 1) * (q / np.maximum(n + q, 1)))
    return np.where(n > 0, out, shorter)


def build(counts: dict[str, dict[int, int]], max_model_bytes: int) -> Model:
    """Frozen trees from gram counts by language."""
    languages = tuple(sorted(counts))
    grams = np.array(sorted({g for c in counts.values() for g in c}), np.int64)
    alphabet = np.unique(grams & 255)
    symbol_of = np.zeros(256, np.int32)
    symbol_of[alphabet] = np.arange(1, len(alphabet) + 1)  # 0: all bytes never seen
    a, contexts = len(alphabet) + 1, np.unique(grams >> 8)
    row_of = np.repeat(np.arange(1, 257, dtype=np.int32)[None, :], 256, 0).reshape(-1)  # first: by the last byte
    row_of[contexts] = 257 + np.arange(len(contexts))
    if (size := len(languages) * (257 + len(contexts)) * a * 4) > max_model_bytes:
        raise ValueError(f"the model takes {size} bytes, more than max_model_bytes")
    bits = np.empty((len(languages), 257 + len(contexts), a), np.float32)
    for k, lang in enumerate(languages):
        g = np.fromiter(counts[lang], np.int64)
        n = np.fromiter(counts[lang].values(), np.float64)
        s = symbol_of[g & 255]
        two, one = np.zeros((len(contexts), a)), np.zeros((256, a))
        np.add.at(two, (row_of[g >> 8] - 257, s), n)
        np.add.at(one, (g >> 8 & 255, s), n)
        uniform = np.full((1, a), 1 / 256)
        uniform[0, 0] = (256 - len(alphabet)) / 256 if len(alphabet) < 256 else 1e-9
        p0 = _escape(one.sum(0, keepdims=True), uniform)
        p1 = _escape(one, np.repeat(p0, 256, 0))
        p2 = _escape(two, p1[contexts & 255])
        bits[k] = -np.log2(np.maximum(np.concatenate([p0, p1, p2]), 1e-30))
    return Model(languages, symbol_of, row_of, bits)


def _labelled(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.filter(col(text_col).isNotNull() & col(lang_col).isNotNull())


def fit(docs: DataFrame, learn: Column | None = None, text_col: str = "text", lang_col: str = "lang",
        max_model_bytes: int = 256 << 20, least_texts: int = 1) -> Model:
    """Learns from all labelled rows among those that ``learn`` selects.

    What fewer than ``least_texts`` of a language's learned texts hold is left out of its tree.
    """
    rows = _labelled(docs.filter(learn) if learn is not None else docs, text_col, lang_col)
    counts: dict[str, dict[int, int]] = {}
    for r in gram_counts(rows, text_col, lang_col).filter(F.col("texts") >= least_texts).toLocalIterator():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return build(counts, max_model_bytes) if counts else Model((), np.zeros(256, np.int32), np.zeros(65536, np.int32), np.zeros((0, 1, 1), np.float32))


def _places(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Each byte's place in a language's table."""
    b, context = _contexts(data, bounds)
    return model.row_of[context] * model.bits.shape[2] + model.symbol_of[b]


def code_lengths(model: Model, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits of each text (rows) under each language (columns)."""
    return _text_bits(model, _places(model, data, bounds), bounds)


def _text_bits(model: Model, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bounds) - 1, len(model.languages)))
    full = np.flatnonzero(np.diff(bounds) > 0)
    for k in range(len(model.languages)):
        total = model.bits[k].reshape(-1)[at].astype(np.float64)
        out[full, k] = np.add.reduceat(total, bounds[:-1][full]) if len(full) else 0
    return out


def predict_column(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score (share of the best language in 2 ** -bits) of each text."""
    langs, scores = np.array([UNKNOWN] * len(column), object), np.zeros(len(column))
    if model.languages:
        for first, end, data, bounds in W.slices(column):
            bits = code_lengths(model, data, bounds)
            best = bits.argmin(1)
            gap = np.minimum(bits - bits[np.arange(len(bits)), best][:, None], 1000)
            langs[first:end], scores[first:end] = np.array(model.languages, object)[best], 1 / np.exp2(-gap).sum(1)
    for i, text in enumerate(column):
        text = text.as_py()
        if text is None or not any(map(str.isalpha, text)):
            langs[i], scores[i] = UNKNOWN, 0.0
    return langs.tolist(), scores


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with two more columns, the predicted language and its score in 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict_column(shared.value, batch.column(at))
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])
    return map_rows(docs, run, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType()))


def block_rates(model: Model, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's best language by its letters; the text of each block, and the block's bits a letter byte under that language."""
    at = np.flatnonzero(LETTER[data])
    place, bounds = _places(model, data, bounds)[at], np.searchsorted(at, bounds)
    sizes, best = np.diff(bounds), _text_bits(model, place, bounds).argmin(1)
    bits = model.bits.reshape(len(model.languages), -1)[np.repeat(best, sizes), place].astype(np.float64)
    blocks = np.where(sizes > 0, np.maximum((sizes + BLOCK // 2) // BLOCK, 1), 0)  # the last one goes on to the text's end
    of = np.repeat(np.arange(len(sizes)), blocks)
    starts = bounds[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * BLOCK
    return best, of, np.add.reduceat(bits, starts) / np.diff(np.append(starts, len(at))) if len(of) else np.zeros(0)


def text_rates(of: np.ndarray, rates: np.ndarray, texts: int) -> np.ndarray:
    """The (lower) median rate of each text's blocks, 0 for a text without letters."""
    out, blocks = np.zeros(texts), np.bincount(of, minlength=texts)
    some = blocks > 0
    out[some] = rates[np.lexsort((rates, of))][(np.cumsum(blocks) - blocks + (blocks - 1) // 2)[some]]
    return out


def _middle(values: np.ndarray, counts: np.ndarray) -> float:
    """Median of values that occur ``counts`` times."""
    order = np.argsort(values)
    return float(values[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)])


def rate_limits(rows: DataFrame, model: Model, text_col: str, lang_col: str) -> np.ndarray:
    """(median, spread) of block rates for each language of the model, from labelled rows that it didn't learn from.

    Rows count if the model tells their label; the spread is the median deviation, so wrong rows among them don't
    move it. A language of fewer than LEAST_BLOCKS blocks gets the widest of the others' limits, infinity if there is none.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        at = {lang: k for k, lang in enumerate(model.languages)}
        for batch in batches:
            labels = np.array([at.get(x, -1) for x in batch.column(1).to_pylist()])
            for first, end, data, bounds in W.slices(batch.column(0)):
                best, of, rates = block_rates(model, data, bounds)
                right = (best == labels[first:end])[of]
                cells, n = np.unique(best[of][right] * BINS + np.minimum(rates[right] / BIN, BINS - 1).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(n.astype(np.int64))], names=["cell", "n"])
    cells = rows.select(col(text_col), col(lang_col)).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(model.languages), BINS), np.int64)
    for r in cells.toLocalIterator():  # at most languages x BINS
        counts[r["cell"] // BINS, r["cell"] % BINS] = r["n"]
    rates, out = (np.arange(BINS) + 0.5) * BIN, np.full((len(model.languages), 2), np.inf)
    known = counts.sum(1) >= LEAST_BLOCKS
    for k in np.flatnonzero(known):
        middle = _middle(rates, counts[k])
        out[k] = middle, max(1.4826 * _middle(np.abs(rates - middle), counts[k]), BIN)
    if known.any():
        widest = np.flatnonzero(known)[(out[known] @ [1, SPREADS]).argmax()]
        out[~known] = out[widest]
    return out


def in_language(model: Model, limits: np.ndarray, column: pa.Array) -> np.ndarray:
    """Whether each text has a letter and a rate within its best language's limit."""
    good = np.zeros(len(column), bool)
    if model.languages:
        for first, end, data, bounds in W.slices(column):
            best, of, rates = block_rates(model, data, bounds)
            wider = np.sqrt(BLOCK / np.clip(np.diff(np.append(0, np.cumsum(LETTER[data]))[bounds]), 1, BLOCK))
            good[first:end] = text_rates(of, rates, end - first) <= limits[best, 0] + SPREADS * limits[best, 1] * wider
    return good & np.array([text is not None and any(map(str.isalpha, text)) for text in column.to_pylist()], bool)


def recognised(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text is in a language learned from other texts.

    A hash of the text deals rows into two sides. Each side is judged by trees and limits (rate_limits) of
    its own: learned from all labelled rows of the other side, limits from all labelled rows of this side. So no text, nor a copy of it, is judged by trees that have seen it, and a language that only one text
    holds is not learned. What fewer than LEAST_TEXTS texts of a language hold is not learned either, so one text under a
    wrong label doesn't let others like it in. If one side has no labelled rows, the other's trees judge both, without limits.
    """
    side, (name,) = F.pmod(F.xxhash64(col(text_col), F.lit(23)), F.lit(2)).cast("int"), fresh(docs, "side")
    models = [fit(docs, side != k, text_col, lang_col, least_texts=LEAST_TEXTS) for k in (0, 1)]
    limits = [np.full((len(m.languages), 2), np.inf) for m in models]
    if all(m.languages for m in models):
        for k, model in enumerate(models):
            limits[k] = rate_limits(_labelled(docs.filter(side == k), text_col, lang_col), model, text_col, lang_col)
    else:
        models, limits = [max(models, key=lambda m: len(m.languages))] * 2, [max(limits, key=len)] * 2
    shared = docs.sparkSession.sparkContext.broadcast((models, limits))
    at, (keep,) = docs.columns.index(text_col), fresh(docs, "keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, limits = shared.value
        for batch in batches:
            of, good = np.asarray(batch.column(batch.num_columns - 1)), np.zeros(batch.num_rows, bool)
            for k in (0, 1):
                rows = np.flatnonzero(of == k)
                good[rows] = in_language(models[k], limits[k], batch.column(at).take(pa.array(rows)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good)], names=[f"c{i}" for i in range(batch.num_columns + 1)])
    told = map_rows(docs.withColumn(name, side), run, T.StructField(keep, T.BooleanType()))
    return told.filter(col(keep)).drop(name, keep)
