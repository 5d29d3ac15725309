import odd
from pyspark.sql import types as T

from tickscope.llm import decontam

ITEMS = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.LongType())])


def shingles(text):
    w = [x.lower() for x in odd.words(text)]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def naive(docs, items, threshold=0.8):
    return sorted((d, i, len(b), len(a & b)) for d, t in docs for i, s in items if (b := shingles(s)) and len((a := shingles(t)) & b) >= threshold * len(b) - 1e-9)


def result(out):
    return sorted((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in out.collect())


def items(spark):
    w = odd.long_text(400, "w").split()
    rows = [("a", odd.PASSAGE), ("A", odd.PASSAGE.upper()), ("b", " ".join(w[100:114])), ("c", " ".join(w[200:320])), ("d", "one two three"), ("e", None), ("f", ""),
            ("g", " ".join([*w[300:330], "changed", *w[331:340]])), ("h", " ".join([*w[10:20], "x", *w[30:40], "y"])), ("i", "not in any document at all here"), ("b", " ".join(w[100:114]))]
    return spark.createDataFrame([(*r, 0) for r in rows], ITEMS)


def test_equals_brute_force(spark, docs):
    docs = docs.filter("doc_id is not null")
    table, bench = [(r["doc_id"], r["text"]) for r in docs.collect()], items(spark)
    want = naive(table, [(r["item_id"], r["text"]) for r in bench.collect()])
    assert {i for _, i, _, _ in want} >= {"a", "A", "b", "c", "g"}
    assert result(decontam.contained(docs, bench)) == want
    assert result(decontam.contained(docs, bench, part_bytes=3000)) == want
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    bad = {d for d, *_ in want}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in table if d not in bad)


def test_empty_tables(spark, docs):
    assert decontam.contained(odd.empty(spark), items(spark)).count() == 0
    assert decontam.contained(docs, spark.createDataFrame([], ITEMS)).count() == 0
    assert decontam.clean(docs, spark.createDataFrame([], ITEMS)).count() == docs.count()
    assert decontam.clean(odd.empty(spark), items(spark)).count() == 0
