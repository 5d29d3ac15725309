import itertools
import random
from collections import Counter
from fractions import Fraction

import odd
import pytest

from tickscope.llm import neardup


def shingles(text):
    w = odd.words(text)
    return Counter([tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def similarity(a, b):
    return sum((1 / sum(max(Fraction(a[j], a[i]), Fraction(b[j], b[i])) for j in a.keys() | b.keys()) for i in a.keys() & b.keys()), Fraction(0))


def fast(a, b):
    """Equal to similarity() where no shingle repeats."""
    if max(a.values()) == max(b.values()) == 1:
        common = len(a.keys() & b.keys())
        return Fraction(common, len(a) + len(b) - common)
    if 2 * len(a.keys() & b.keys()) < max(len(a), len(b)):
        return Fraction(0) if not a.keys() & b.keys() else min(Fraction(1, 2), similarity(a, b))
    return similarity(a, b)


def classes(rows, threshold=Fraction(4, 5)):
    """Smallest id of each id's class, from (id, text)."""
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    sets = [(i, s) for i, t in rows if (s := shingles(t))]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if root(i) != root(j) and a.keys() & b.keys() and (a == b or fast(a, b) >= threshold):
            up[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in up}


def result(frame):
    return {r["doc_id"]: r["component_id"] for r in frame.collect()}


def near_copies(n, seed):
    """A family whose members lie around the threshold, and chains of small edits."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(90)]
    rows, chain = [], list(base)
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(400)}"
        rows.append((1000 + i, " ".join(text)))
        chain[rng.randrange(len(chain))] = f"y{i}"
        rows.append((5000 + i, " ".join(chain)))
    return rows


@pytest.mark.parametrize("block_docs", [500, 13])
def test_classes_equal_brute_force_around_the_threshold(spark, docs, block_docs):
    rows = near_copies(40, 3) + [(9000 + i, " ".join(["ab cd"] * (3 + i % 4) + [f"z{j}" for j in range(i % 5)])) for i in range(30)]
    got = result(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_docs=block_docs))
    assert got == classes(rows)


def test_classes_equal_brute_force_on_the_table(spark, docs):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    want = classes(rows)
    assert result(neardup.near_duplicates(frame)) == want and len(set(want.values())) < len(rows)


def test_exact_similarity():
    rng = random.Random(5)
    import numpy as np
    for _ in range(300):
        a, b = (Counter(rng.choices(range(12), k=rng.randint(1, 25))) for _ in range(2))
        arrays = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
        assert abs(neardup.probability_jaccard(*arrays[0], *arrays[1]) - float(similarity(a, b))) < 1e-9


def test_registers_estimate_the_similarity():
    import numpy as np
    import pyarrow as pa
    rng, errors = random.Random(7), []
    for _ in range(40):
        one = [f"w{rng.randrange(60)}" for _ in range(200)]
        two = list(one)
        for _ in range(rng.randrange(12)):
            two[rng.randrange(200)] = "new"
        texts = [" ".join(one), " ".join(two)]
        _, _, s, n, row, _ = next(neardup.weighted(pa.array(texts)))
        sig = neardup.prob_minhash(s, n, row, 2)
        errors.append((sig[0] == sig[1]).mean() - float(similarity(*map(shingles, texts))))
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.2


def test_odd_rows(spark, docs):
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[1]["kept"] and by[2]["kept"] and by[2]["component_id"] == 2
    assert by[5]["component_id"] == by[5]["class_id"] == 4 and not by[5]["kept"]
    assert by[7]["component_id"] == 6
    assert all(r["component_id"] is None and r["kept"] for r in out if r["doc_id"] is None)
    left = neardup.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.select("doc_id").collect()]
    assert ids.count(11) == 1 and ids.count(12) == 2 and ids.count(None) == 2 and 5 not in ids and 7 not in ids
    assert neardup.near_duplicates(odd.empty(spark)).count() == 0 and neardup.one_of_each(odd.empty(spark)).count() == 0


def test_an_ids_texts_are_apart(spark, docs):
    """An id of two texts loses only the one that another row has."""
    one, two = ("alpha beta gamma delta epsilon zeta " * 3).strip(), "quite another text of some seven words"
    rows = [(3, one), (12, one), (12, two), (20, two), (20, two)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, neardup.one_of_each(frame).collect())) == [(3, one), (12, two)]
    got = sorted((r["doc_id"], r["class_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame).collect())
    assert got == [(3, 3, 3, True), (12, 3, 3, False), (12, 12, 12, True), (20, 12, 12, False), (20, 12, 12, False)]
    near = spark.createDataFrame([(1, one + " end"), (1, one), (2, one)], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.near_duplicates(near).select("doc_id", "component_id").collect()) == [(1, 1), (1, 1), (2, 1)]
    assert neardup.one_of_each(near).count() == 1


@pytest.mark.parametrize("n", [1000, 4000])
def test_a_familys_links_and_texts_grow_with_its_size_only(spark, docs, monkeypatch, n):
    """One family of n near copies: few links are left to the blocks, and at most n log2(blocks) texts move."""
    import math
    rng = random.Random(n)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(text) + f" end{i}"))
    links, texts = [], []

    def count_links(found, x, y, join=neardup.components):
        links.append(found.filter(f"{x} <> {y}").distinct().count())
        return join(found, x, y)

    def counting(work):
        def run(told, *rest):
            texts.append(told.count())
            return work(told, *rest)
        return run
    monkeypatch.setattr(neardup, "components", count_links)
    for name in ("_confirmed", "_in_blocks"):
        monkeypatch.setattr(neardup, name, counting(getattr(neardup, name)))
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block_docs=100)
    assert {r["component_id"] for r in out.collect()} == {0}
    assert links[-1] <= n / 4 and sum(texts) <= n * (math.log2(n / 100) + 1)


def test_a_content_is_tied_once_not_once_a_band(spark, docs, monkeypatch):
    """Families equal a union-find over all buckets; no component run gets more links than there are texts."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows, chain = [], [f"c{i}" for i in range(90)]
    for i in range(900):
        text = list(base)
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(text) + f" end{i}"))
    for i in range(200):
        chain[rng.randrange(len(chain))] = f"y{i}"
        rows.append((5000 + i, " ".join(chain)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).checkpoint()
    links = []

    def counted(found, x, y, join=neardup.components):
        links.append(found.filter(f"{x} <> {y}").distinct().count())
        return join(found, x, y)
    monkeypatch.setattr(neardup, "components", counted)
    neardup.near_duplicates(frame).count()
    assert links and max(links) <= len(rows)

    speaking = neardup.signatures(frame, "doc_id", "text").dropDuplicates(["content"]).selectExpr("content as node", "bands").checkpoint()
    up, head = {}, {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    nodes = sorted((r["node"], r["bands"]) for r in speaking.collect())
    for node, keys in nodes:
        up[node] = node
        for at in enumerate(keys):
            a, b = root(head.setdefault(at, node)), root(node)
            up[max(a, b)] = min(a, b)
    size = Counter(root(n) for n in up)
    got = {r["node"]: r["family"] for r in neardup.families(speaking).collect()}
    assert got == {n: root(n) for n in up if size[root(n)] > 1} and len(set(got.values())) < len(got)
