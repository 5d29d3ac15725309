import hashlib
import random
import re

import odd

from tickscope.llm import QUERIES, pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def naive(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def base(text):
    return [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]


def test_base_equals_the_patterns_on_random_text():
    rng = random.Random(1)
    pieces = ["4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6", "a@b.c", "@", ".", "..", "+1 (555) 123-4567", "+", "x", " ", "-", "--", "é", "a.b+c@d-e.f.g@h.i", "0" * 20, "5", "(", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        assert base(text) == naive(text), text


def test_query_equals_brute_force_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_pii"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r["n_email"] + r["n_phone"] for r in rows) > 0
    for r in rows:
        want = naive(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x[0] == k for x in want) for k in pii.BASE_KINDS]


def test_added_kinds_need_checksum_or_context():
    kinds = lambda t: [s[0] for s in pii.find_spans(t) if s[0] not in pii.BASE_KINDS]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 AND go") == ["iban"]
    assert kinds("pay to DE88 3704 0044 0532 0130 00") == []
    assert kinds("her SSN is 123-45-6789.") == ["ssn"] and kinds("part 123-45-6789 of it") == []
    assert pii.redact("a b@c.de f", pii.find_spans("a b@c.de f")) == "a <email> f"


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000):
        base(text)


def test_odd_rows(spark, docs):
    out = pii.detect_pii(docs).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r for r in out}
    assert by[1]["spans"] == [] and by[1]["redacted"] is None and by[2]["redacted"] == ""
    assert [s["kind"] for s in by[14]["spans"]] == ["email", "card"]
    assert pii.detect_pii(odd.empty(spark)).count() == 0


def test_ibans_beside_each_other_and_after_a_token():
    first, second = "DE89370400440532013000", "GB29NWBK60161331926819"
    spans = lambda text: [text[a:b] for a, b in pii.ibans(text)]
    assert spans(f"{first} {second}") == [first, second]
    assert spans(f"ID12 {first}") == [first]
    assert spans(f"ID12 DE89 3704 0044 0532 0130 00 {second} end") == ["DE89 3704 0044 0532 0130 00", second]
    assert spans("x" + first) == []
    assert len(spans("AB12 " * 50_000)) == 0


def test_context_words_stand_alone():
    for text, ssn in (("bassnote 123-45-6789", False), ("SSN: 123-45-6789", True), ("my_ssn 123-45-6789", True), ("two ssns, 123-45-6789", True), ("social security 123-45-6789", True), ("taxidermy 123-45-6789", False)):
        assert any(s[0] == "ssn" for s in pii.find_spans(text)) == ssn, text
    assert [s[3] for s in pii.find_spans("description 1.2.3.4")] == [pii.BASE_SCORE["ip"]]
    assert pii.find_spans("IP 1.2.3.4")[0][3] > pii.BASE_SCORE["ip"]
