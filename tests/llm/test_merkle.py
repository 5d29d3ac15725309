import hashlib
import random

import odd
import pytest
from pyspark.sql import functions as F

from tickscope.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(hashes, arity):
    """All levels of a tree, leaves first."""
    levels = [list(hashes)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def path(levels, at, arity):
    """(before, after) on each level from a node to the top."""
    out = []
    for level in levels[:-1]:
        first = at // arity * arity
        out.append(("".join(level[first:at]), "".join(level[at + 1:first + arity])))
        at //= arity
    return out


def brute(rows, arity):
    """Sorted (ord, leaf, subroot, root, proof_sha256, folded_root) of (ord, group, leaf, claim)."""
    groups = sorted({r[1] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = own, tree([r[2] for r in own], arity)
    over = tree([trees[g][1][-1][0] for g in groups], arity)
    out = []
    for k, g in enumerate(groups):
        own, levels = trees[g]
        for at, r in enumerate(own):
            steps, folded = path(levels, at, arity) + path(over, k, arity), r[3]
            for before, after in steps:
                folded = H(before, folded, after)
            out.append((r[0], r[2], levels[-1][0], over[-1][0], H(*[b + a for b, a in steps]), folded))
    return sorted(out, key=repr)


def result(frame):
    return sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"]) for r in frame.collect()], key=repr)


@pytest.mark.parametrize("rise, arity", [(1, 3), (2, 3), (6, 3), (2, 2)])
def test_equal_to_brute_force(spark, docs, monkeypatch, rise, arity):
    monkeypatch.setattr(merkle, "RISE", rise)
    rng = random.Random(rise)
    rows = [(rng.choice([None, *range(120)]), f"text\n{rng.randrange(40)}", rng.choice([None, "", "é", "z", "b", "b", "b", "b"])) for _ in range(140)] + [(7, "alone", "single"), (8, None, "zz")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = merkle.verified(frame, ("doc_id", "text"), claims={"text": F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}, arity=arity)
    want = []
    for i, t, s in rows:
        now = t.replace("\n", "") if i is not None and i % 3 == 0 and t is not None else t
        want.append((i, s, leaf((i, t)), leaf((i, now))))
    assert result(out) == brute(want, arity)
    for r in out.collect():
        assert r["verified"] == (r["folded_root"] == r["root"])


def test_tampered_rows_fail_and_others_pass(spark, docs):
    frame = spark.createDataFrame([(i, "a\nb" if i % 2 else "ab", "s") for i in range(30)], "doc_id long, text string, source string")
    out = merkle.verified(frame, ("doc_id", "source", "text"), claims={"text": F.replace("text", F.lit("\n"), F.lit(""))}).collect()
    assert all(r["verified"] == (r["doc_id"] % 2 == 0) for r in out)


def test_odd_rows(spark, docs):
    fields = ("doc_id", "source", "lang", "text")
    out = merkle.verified(docs, fields)
    rows = [(r["doc_id"], r["source"], leaf([r[f] for f in fields]), leaf([r[f] for f in fields])) for r in docs.collect()]
    assert result(out) == brute(rows, 3) and all(r["verified"] for r in out.collect())
    assert merkle.verified(odd.empty(spark), fields).count() == 0
    one = merkle.verified(docs.filter("doc_id = 10"), fields).collect()
    assert [(r["leaf"] == r["subroot"] == r["root"] == r["folded_root"], r["proof_sha256"], r["verified"]) for r in one] == [(True, H(), True)]
