"""Sharding and mixing: laws, odd rows, and no Python in their plans."""

from collections import Counter, defaultdict

import odd
from pyspark.sql import functions as F

from tickscope.llm import QUERIES, mixing, sharding

SF = "/root/testdata/sf0.01"


def plan(frame):
    return frame._jdf.queryExecution().toString()


def test_shards_hold_the_mixture(spark, docs):
    rows = QUERIES["op1_sharding"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert sorted(by) == list(range(24)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in by.values())
    for source, n in Counter(r["source"] for r in rows).items():
        assert all(abs(sum(r["source"] == source for r in s) - n / 24) <= 2 for s in by.values())


def test_shards_of_odd_rows(spark, docs):
    out = sharding.shard(docs, 7, keep=["a.b", "u"])
    rows = out.collect()
    n = docs.count()
    assert len(rows) == n and out.columns == ["doc_id", "source", "a.b", "u", "size", "text_crc32", "law", "shard", "slot"]
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in sorted(sizes) for k in range(sizes[s])]
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(8, 0)}
    assert sharding.shard(odd.empty(spark), 7).count() == 0
    assert "Python" not in plan(out) and "Arrow" not in plan(out)


def test_mix_comes_near_its_targets(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    out, _ = mixing.sample(frame)
    rows = QUERIES["op10_mixing"](spark, SF).join(frame.select("doc_id", "source"), "doc_id").collect()
    taken, most, want = Counter(), Counter(), {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
        want[r["source"]] = (r["target"], r["source_size"])
    assert all(abs(taken[s] - t) <= most[s] / 2 + 1e-6 and t <= 2 * n for s, (t, n) in want.items())
    total = sum(n for _, n in want.values())
    assert abs(sum(t for t, _ in want.values()) - 1.5 * total) < 1e-6 * total
    free = [t / (3, 1, 2)[k % 3] for k, (s, (t, n)) in enumerate(sorted(want.items())) if t < 2 * n - 1e-6]
    assert max(free) - min(free) < 1e-6 * max(free)
    assert "Python" not in plan(out) and "Arrow" not in plan(out)
    again = QUERIES["op10_mixing"](spark, SF)
    assert {(r["doc_id"], r["taken"]) for r in again.collect()} == {(r["doc_id"], r["taken"]) for r in rows}


def test_mix_of_odd_rows(spark, docs):
    out, (size, source_size, target, copies) = mixing.sample(docs)
    assert out.columns[:len(docs.columns)] == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    sums = defaultdict(float)
    for r in rows:
        assert r[copies] in (0, 1, 2) and r[target] <= 2 * r[source_size]
        sums[r["source"]] += r[size] * r[copies]
    largest = {s: max(r[size] for r in rows if r["source"] == s) for s in sums}
    assert all(abs(sums[r["source"]] - r[target]) <= largest[r["source"]] / 2 + 1e-6 for r in rows)
    each = mixing.mixed(docs)
    assert each.columns == docs.columns and each.count() == sum(r[copies] for r in rows)
    assert mixing.mixed(odd.empty(spark)).count() == 0
    only = spark.createDataFrame([(1, "a b c", "s", 5.0), (2, "d e f", "s", None)], "doc_id long, text string, source string, weight double")
    assert mixing.mixed(only, share=0.5, inclusion_col="weight").count() == 1
    assert mixing.mixed(docs.withColumn("text", F.lit(""))).count() == 0


def test_inclusion_is_unequal_certain_at_one_and_sums_to_what_is_wanted(spark):
    # one source of 4,000 documents: 1 to 40 words, and three so long that each is certain
    sizes = [1 + k % 40 for k in range(4000)] + [9000, 8000, 7000]
    frame = spark.createDataFrame([(k, " ".join(["w"] * n), "s") for k, n in enumerate(sizes)], "doc_id long, text string, source string")
    for share, seed in ((0.4, "a"), (0.7, "b"), (1.3, "c")):
        out, (size, _, target, copies) = mixing.sample(frame, share=share, seed=seed, keep=["doc_id"])
        rows = out.collect()
        whole = int(share)
        assert len(rows) == len(sizes) and out.columns[0] == "doc_id" and "text" not in out.columns
        assert all(r[copies] == whole + 1 for r in rows if r[size] >= 7000)
        assert abs(sum(r[size] * r[copies] for r in rows) - rows[0][target]) <= 20
        # inclusions as the definition gives them, by plain repetition
        wanted, certain = rows[0][target] - whole * sum(sizes), set()
        measure = [n >> max(n.bit_length() - 5, 0) << max(n.bit_length() - 5, 0) for n in sizes]
        while True:
            rest = [k for k in range(len(sizes)) if k not in certain]
            scale = (wanted - sum(sizes[k] for k in certain)) / sum(measure[k] * sizes[k] for k in rest)
            more = {k for k in rest if scale * measure[k] >= 1}
            if not more:
                break
            certain |= more
        for low, high in ((1, 10), (11, 20), (21, 30), (31, 40)):
            of = [r for r in rows if low <= r[size] <= high]
            expected = sum(min(1.0, scale * measure[r["doc_id"]]) for r in of)
            assert abs(sum(r[copies] - whole for r in of) - expected) < 5 * (expected * (1 - expected / len(of)) + 1) ** 0.5 + 2
        assert {r["doc_id"] for r in rows if r[copies] == whole + 1} >= certain


def test_given_inclusion_is_kept_and_equal_inclusion_is_plain(spark):
    frame = spark.createDataFrame([(k, "a b c d", "s", 3.0 if k % 2 else 1.0) for k in range(4000)], "doc_id long, text string, source string, weight double")
    out, names = mixing.sample(frame, share=0.25, inclusion_col="weight")
    taken = Counter(r["doc_id"] % 2 for r in out.filter(F.col(names[3]) > 0).collect())
    assert abs(sum(taken.values()) - 1000) <= 1 and 2.5 < taken[1] / taken[0] < 3.6
