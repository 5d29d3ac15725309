import numpy as np
import odd
from pyspark.sql import functions as F

from tickscope.llm import QUERIES, langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    rows = QUERIES["op9_langid"](spark, sf).join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"] and any(map(str.isalpha, r["text"]))]
    assert len(rows) == truth.count() and len(held) > 150
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def grams(*texts):
    out = {}
    for text in texts:
        b = b"  " + text.lower().encode()
        for i in range(2, len(b)):
            g = b[i - 2] << 16 | b[i - 1] << 8 | b[i]
            out[g] = out.get(g, 0) + 1
    return out


def test_every_context_holds_a_distribution():
    model = langid.build({"x": grams("the cat sat on the mat"), "y": grams("der hund lag im gras")}, 1 << 26)
    p = np.exp2(-model.bits.astype(float))
    assert np.allclose(p.sum(2), 1, atol=1e-4)


def test_code_length_equals_a_direct_count():
    text, train = "The hat", "the cat sat on the mat"
    model = langid.build({"x": grams(train)}, 1 << 26)
    seen = b"  " + train.encode()

    def p(context, byte, alphabet=sorted(set(train.encode()))):
        follow = [seen[i + len(context)] for i in range(2 - len(context), len(seen) - len(context)) if seen[i:i + len(context)] == context and i + len(context) >= 2]
        short = (lambda x: 1 / 256 if x in alphabet else (256 - len(alphabet)) / 256) if not context else (lambda x: p(context[1:], x))
        if not follow:
            return short(byte)
        n, q = len(follow), set(follow)
        if byte in q:
            return follow.count(byte) / (n + len(q))
        rest = sum(short(x) for x in [*alphabet, 0] if x not in q)
        return len(q) / (n + len(q)) * short(byte) / rest
    b = b"  " + text.lower().encode()
    want = -sum(np.log2(p(b[i - 2:i], b[i])) for i in range(2, len(b)))
    raw = np.frombuffer(text.encode(), np.uint8)
    assert abs(langid.code_lengths(model, raw, np.array([0, len(raw)]))[0, 0] - want) < 1e-3


def test_odd_rows(spark, docs):
    out = langid.predict(docs, langid.fit(docs), lang_name="found", score_name="sure")
    assert out.columns == [*docs.columns, "found", "sure"]
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all((r["found"] == "und" and r["sure"] == 0) == (not any(map(str.isalpha, r["text"] or ""))) for r in rows)
    none = langid.predict(docs, langid.fit(docs.filter(F.lit(False))), lang_name="found", score_name="sure")
    assert {r["found"] for r in none.collect()} == {"und"}
    assert langid.predict(odd.empty(spark), langid.fit(docs)).count() == 0


def test_every_labelled_row_is_learned(spark, monkeypatch):
    """7,000 texts of one language and 300 of another: trees and limits come from all of them."""
    rows = [(i, f"Word{i * 7919 % 99991} of the cat" if i % 3 else "ein Wort\u00e4", "en") for i in range(7000)] + [(9000 + i, f"la {i} casa", "es") for i in range(300)]
    odd_rows = [(9500, None, "en"), (9501, "no label here", None), (9502, "", "es")]
    frame = spark.createDataFrame(rows + odd_rows, "doc_id long, text string, lang string").repartition(3)
    every = {lang: [t for _, t, x in rows if x == lang] for lang in ("en", "es")}
    for least in (1, 2):
        counts = {}
        for lang, texts in every.items():
            held = {}
            for text in texts:
                for gram in grams(text):
                    held[gram] = held.get(gram, 0) + 1
            counts[lang] = {g: n for g, n in grams(*texts).items() if held[g] >= least}
        want, got = langid.build(counts, 1 << 26), langid.fit(frame, least_texts=least)
        assert got.languages == want.languages and np.array_equal(got.row_of, want.row_of) and np.array_equal(got.bits, want.bits)
    measured = []

    def limits(labelled, *rest, work=langid.rate_limits):
        measured.append(labelled.count())
        return work(labelled, *rest)
    monkeypatch.setattr(langid, "rate_limits", limits)
    assert langid.recognised(frame).count() > 0
    assert sum(measured) == len(rows) + 1 and min(measured) > 2000
