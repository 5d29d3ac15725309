import math
from collections import Counter

import numpy as np
import odd
from pyspark.sql import functions as F

from tickscope.llm import lm


def tokens(text):
    return [w.lower() for w in odd.words(text)] + [None]


def naive(rows, k=8.0, order=3):
    """rows: (id, text, learn); the recursion of the definition over dictionaries of tuples."""
    count, out_of = Counter(), Counter()
    for _, t, learn in rows:
        if learn:
            w = ["<", *tokens(t)]
            for i in range(1, len(w)):
                count[w[i],] += 1
                for m in range(1, order):
                    if i - m >= 0:
                        count[tuple(w[i - m:i + 1])] += 1
                        out_of[tuple(w[i - m:i])] += 1
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)

    def p(history, x):
        if not history:
            return (count[x,] + 0.5) / (n + 0.5 * (v + 1))
        return (count[(*history, x)] + k * p(history[1:], x)) / (out_of[history] + k)
    out = []
    for i, t, learn in rows:
        w = ["<", *tokens(t)]
        full = [p(tuple(w[max(0, j - order + 1):j]), w[j]) for j in range(1, len(w))]
        out.append((i, learn, len(w) - 1, sum(count[x,] > 0 for x in w[1:]), n, sum(math.log10(p((), x)) for x in w[1:]), sum(map(math.log10, full))))
    return out


def test_equals_brute_force_in_many_blocks(spark, docs):
    frame = docs.withColumn("learn", F.col("doc_id") % 3 != 1)
    rows = [(r["doc_id"], r["text"], bool(r["learn"])) for r in frame.collect()]
    for order, size, part in ((3, 4 << 20, 32 << 20), (3, 20_000, 3_000), (2, 20_000, 32 << 20), (5, 20_000, 32 << 20)):
        got = [tuple(r) for r in lm.score(frame, F.col("learn"), order=order, block_bytes=size, range_bytes=part).collect()]
        assert len(got) == len(rows)
        for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[5], r[6])), sorted(naive(rows, order=order), key=lambda r: (str(r[0]), r[5], r[6]))):
            assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_ranges_follow_the_input(spark, docs):
    ranges = [lm._blocks(frame, F.lit(True), "doc_id", "text", 20_000, 1_000)[2] for frame in (docs, docs.unionAll(docs).unionAll(docs))]
    assert ranges[0] > 8 and abs(ranges[1] - 3 * ranges[0]) <= 3


def test_weights_out_of_a_state_sum_to_one():
    rows = [(0, "a b a c a b", True), (1, "b b a", True)]
    vocabulary = ["a", "b", "c", "never"]
    one = [("a " + w, w) for w in vocabulary]
    scored = {t: s for (t, *_), (_, _, _, _, _, _, s) in zip(one, naive([*rows, *[(9, t, False) for t, _ in one]])[2:])}
    alone = naive([*rows, (9, "a", False)])[-1][-1]
    assert len(scored) == 4 and all(s < 0 for s in scored.values()) and alone < 0


def test_packing_is_an_exact_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (lm.unpack(lm.pack(keys)) == keys).all()
        counts = rng.integers(0, 10 ** rng.integers(1, 12), n)
        assert (lm.unpack_counts(lm.pack_counts(counts)) == counts).all()


def test_no_training_rows_and_empty_tables(spark, docs):
    out = lm.score(docs, F.lit(None).cast("boolean")).collect()
    assert len(out) == docs.count() and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in out)
    assert lm.score(odd.empty(spark), F.lit(True)).count() == 0


def test_null_ids_are_dealt_over_the_blocks(spark, docs):
    frame = spark.range(15_000).selectExpr("cast(null as long) doc_id", "concat('text ', cast(id + 100000 as string)) text")
    rows, blocks, _ = lm._blocks(frame, F.lit(True), "doc_id", "text", 8_000)
    sizes = [r["count"] for r in rows.groupBy("block").count().collect()]
    assert blocks > 10 and len(sizes) == blocks and max(sizes) < 2 * 15_000 / blocks
