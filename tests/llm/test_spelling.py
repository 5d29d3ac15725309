import random
import re
import zlib
from collections import Counter

import numpy as np
import odd

from tickscope.llm import spelling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, noise=199):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(counts, least_length=6, least_count=5, ratio=5):
    lex = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    form, out = {}, {}
    for w, n in lex.items():
        near = sorted((v for v in lex if one_edit(w, v)), key=lambda v: (-lex[v], v))
        form[w] = near[0] if near and lex[near[0]] >= ratio * n else None
        out[w] = [form[w], None, n, len(near), lex[form[w]] if form[w] else None]
    for w in lex:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def result(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def misspelt(seed):
    """Words in a few shapes with repeated letters and non-ASCII ones, many of them one edit apart, with counts over four magnitudes."""
    rng, rows = random.Random(seed), []
    bases = ["aaaaaa", "abcabc", "éàüéàü", "÷×ßÿßÿ", "parallel", "committee"]
    words = set(bases)
    for w in bases * 60:
        w = list(w)
        for _ in range(rng.randrange(1, 3)):
            at, kind = rng.randrange(len(w)), rng.randrange(3)
            w[at:at + (kind != 0)] = [rng.choice("abcéàÿlm")] if kind != 2 else []
        words.add("".join(w))
    for i, w in enumerate(sorted(words)):
        rows += [(i, " ".join([w.upper() if rng.random() < 0.1 and w.isascii() else w] * min(4, k)))
                 for k in [rng.choice([1, 2, 5, 6, 30, 160, 800])] for _ in range(max(1, k // 4))]
    return rows + [(5000 + i, w) for w, n in (("chains", 9), ("chainsaw", 2000), ("chainsa", 90), ("cxainsaw", 400)) for i in range(n)]


def test_equal_to_brute_force(spark, docs):
    rows = misspelt(1)
    want = brute(brute_counts(rows))
    got = result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert got == want and sum(v[0] is not None for v in want.values()) > 20 and want["chains"][:2] == ("chainsa", "chainsaw")


def test_every_letter_and_long_runs(spark, docs):
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    rows = [(i, f"word{c}ing " * 5) for i, c in enumerate(letters)] + [(200, "wording " * 200), (201, ("x" * 3000 + " ") * 6), (202, ("x" * 2999 + " ") * 40), (203, "ÀBŸĀab·cdefgh" * 9)]
    got = result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), noise=None))
    assert got == brute(brute_counts(rows, None))
    assert got["wordaing"][3] == len(letters) and got["wording"][3] == len(letters)


def test_crcs():
    rng = random.Random(2)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 7, 48, 49, 300]))) for _ in range(200)]
    heads = [f"{rng.randrange(10 ** 9)}:".encode() for _ in parts]
    letters = np.frombuffer(b"".join(parts), np.uint8)
    edges = np.append(0, np.cumsum([len(p) for p in parts]))
    got = spelling.crcs(np.array([zlib.crc32(h) for h in heads], np.uint32), letters, edges)
    assert got.tolist() == [zlib.crc32(h + p) for h, p in zip(heads, parts)]


def test_odd_rows(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(spelling.variants(docs)) == brute(brute_counts(rows))
    assert {r["word"]: r["n"] for r in spelling.word_counts(docs, noise=7).collect()} == brute_counts(rows, 7)
    assert spelling.variants(odd.empty(spark)).count() == 0
