import random

import odd
import pytest
from pyspark.sql import functions as F

from tickscope.llm import substring


def naive(rows, length):
    """(id, words, removed, kept) of each row by the definition."""
    low = {}
    for i, t in rows:
        w = odd.words(t)
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            if i is not None:
                low[key] = min(low.get(key, i), i)
    out = []
    for i, t in rows:
        w = odd.words(t)
        bad = {p for k in range(len(w) - length + 1) if i is not None and low[tuple(w[k:k + length])] < i for p in range(k, k + length)}
        out.append((i, len(w), len(bad), b" ".join(x for p, x in enumerate(w) if p not in bad).decode()))
    return sorted(out, key=str)


def got(frame, **options):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.drop_repeats(frame, **options).collect()), key=str)


@pytest.mark.parametrize("length,hot,group_bytes", [(50, 20_000, 3 << 20), (50, 3, 2000), (7, 20_000, 5000), (7, 2, 500), (25, 0, 1 << 20)])
def test_equals_the_definition(spark, docs, length, hot, group_bytes):
    rng = random.Random(length + hot)
    pool = [[f"v{rng.randrange(30)}" for _ in range(rng.randint(1, 140))] for _ in range(25)]
    rows = [(i, " ".join(" ".join(rng.choice(pool)) for _ in range(rng.randint(0, 4)))) for i in range(80)]
    rows += [(100 + i, "so on " * rng.randint(20, 60) + f"tail{i}") for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(frame, length=length, hot=hot, group_bytes=group_bytes) == naive(rows, length)


def test_passage_over_fifty_words_goes_from_the_later_documents(spark, docs):
    out = {r["doc_id"]: r for r in substring.drop_repeats(docs).collect()}
    assert out[8]["n_removed"] == 0 and out[9]["kept"] == "other begin and more" and out[10]["kept"] == ""


def test_odd_rows(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(docs) == naive(rows, 50)
    assert substring.drop_repeats(odd.empty(spark)).count() == 0
    assert substring.drop_repeats(docs.filter(F.col("doc_id") < 5)).count() == 4
