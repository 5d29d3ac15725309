"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
import odd
import test_decontam
import test_neardup

SF = "/root/testdata/sf0.001"


def test_stages(spark, docs):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    outputs = [frame]
    for _, stage in corpus_pipeline.STAGES:
        outputs.append(stage(spark, outputs[-1], SF).checkpoint())
    told, unique, clean, mixed, shards = ([tuple(r) for r in o.collect()] for o in outputs[1:])
    assert all(o.columns == frame.columns for o in outputs[1:-1])
    start = [tuple(r) for r in frame.collect()]
    text = frame.columns.index("text")
    assert Counter(told) == Counter(r for r in start if any(map(str.isalpha, r[text] or "")))
    want = test_neardup.classes([(r[0], r[text]) for r in told])
    assert Counter(unique) == Counter(r for r in told if want[r[0]] == r[0])
    bad = {d for d, *_ in test_decontam.naive([(r[0], r[text]) for r in unique], bench)}
    assert bad and Counter(clean) == Counter(r for r in unique if r[0] not in bad)
    assert set(mixed) <= set(clean) and max(Counter(mixed).values()) <= 2
    words = lambda rows: sum(len(odd.words(r[text])) for r in rows)
    assert abs(words(mixed) / words(clean) - 1.5) < 0.1
    assert len(shards) == len(mixed) and Counter(r[0] for r in shards) == Counter(r[0] for r in mixed)
    assert corpus_pipeline.run(spark, SF).count() == len(mixed)


def test_odd_rows_pass_through(spark, docs):
    frame = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, SF).checkpoint()
        assert k == 4 or frame.columns == docs.columns
    assert frame.count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.empty(spark), SF).count() == 0


def test_language_id_rejects_noise_and_unlearned_languages(spark):
    import base64
    import random
    import string
    draw = random.Random(5)
    noise = lambda n: "".join(draw.choices(string.ascii_lowercase, k=n))
    foreign = ["Комитет вчера решил, что новый мост будет открыт весной, хотя инженеры предупреждали о расходах.",
               "Η επιτροπή αποφάσισε χθες ότι η νέα γέφυρα θα ανοίξει την άνοιξη.", "委员会昨天决定新桥将在春天开放，尽管几位工程师对费用提出了警告。"]
    bad = [*foreign, foreign[0] * 40, noise(40), noise(4000), " ".join(noise(draw.randint(2, 9)) for _ in range(300)),
           *[base64.b64encode(draw.randbytes(n)).decode() for n in (45, 300, 3000)]]
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = [r["text"] for r in frame.filter("text rlike '^[A-Za-z ,.]{400}'").orderBy("doc_id").limit(40).collect()]
    short = [" ".join(t.split()[:n]) for t in clean for n in (1, 2, 4)]
    mixed = [t[:300] + " " + base64.b64encode(draw.randbytes(100)).decode() + " " + t[300:400] for t in clean]
    rows = [(10**7 + i, t, lang) for i, (t, lang) in enumerate([(t, lang) for t in bad for lang in (None, "en")])]
    rows += [(2 * 10**7 + i, t, None) for i, t in enumerate(short + mixed)]
    planted = frame.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, planted, "").collect()}
    assert not [t[:40] for i, t, _ in rows if i < 2 * 10**7 and i in left]
    assert not [t for i, t, _ in rows if i >= 2 * 10**7 and i not in left]
    assert {r["doc_id"] for r in frame.collect() if any(map(str.isalpha, r["text"] or ""))} <= left
