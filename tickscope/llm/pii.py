"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Four base kinds (email, ip, card, phone) are always reported when their pattern matches and
their validator agrees. The further kinds (iban, ssn) are added when their score, raised by
context words nearby, reaches a threshold. All scans are linear in the length of the text:
an email is searched from each ``@`` outwards, numbers by runs of digits.

Map only: no shuffle, one pass, any text length. Null texts count as empty and have no
spans; a null id is given back as it is; repeated rows each get their own result; an empty table gives
an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
#: Characters before and after a span in which context words are looked for.
NEAR = 48
#: Score of a confirmed match, what a context word adds, and the score from which an added kind counts.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
BOOST, THRESHOLD = 0.3, 0.6
CONTEXT = {
    "email": ("mail", "email", "contact", "write to"), "ip": ("ip", "server", "host", "address"), "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "telephone", "call", "tel", "mobile"), "iban": ("iban", "account", "konto", "bank"), "ssn": ("ssn", "social security", "tax id"),
}
#: Context words stand alone (or with a plural s): "bassnote" is none.
NEARBY = {kind: re.compile(rf"(?<![^\W_])(?:{'|'.join(words)})s?(?![^\W_])") for kind, words in CONTEXT.items()}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Matches every run of digits, so a failed one is passed in one step.
IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: the local part is the run before each ``@``, back to the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL:
            first -= 1
        if first < at and (m := DOMAIN.match(text, at + 1)):
            out.append((first, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if m[1] and all(int(p.lstrip("0")[:4] or "0") <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []


def ibans(text: str) -> list[tuple[int, int]]:
    """The longest end of each match that mod-97 confirms; the search goes on from there, or after the first character of a match without one."""
    out, m = [], IBAN.search(text)
    while m:
        at = m.start() + 1  # matches start at a word's start, so the next one is at the next word at the earliest
        for end in range(m.end(), m.start() + 14, -1):
            code = text[m.start():end].replace(" ", "")
            if text[end - 1] != " " and (end == len(text) or not text[end].isalnum()) and 15 <= len(code) <= 34 and mod97(code):
                out.append((m.start(), end))
                at = end
                break
        m = IBAN.search(text, at)
    return out


def ssns(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in SSN.finditer(text)] if "-" in text else []


FINDERS: dict[str, Callable[[str], list[tuple[int, int]]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def find_spans(text: str) -> list[Span]:
    """All spans (kind, start, end, score) of one text in code points, by kind as in KINDS, then start."""
    out = []
    for kind, find in FINDERS.items():
        for start, end in find(text):
            around = (text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]).lower()
            score = min(1.0, BASE_SCORE[kind] + BOOST * bool(NEARBY[kind].search(around)))
            if kind in BASE_KINDS or score >= THRESHOLD:
                out.append((kind, start, end, score))
    return out


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets (of overlapping spans the earlier, then longer one counts)."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True) -> DataFrame:
    """One row a document: ``id_col``, spans (kind, start, end, score; none: an empty array) and, if asked for, the redacted text (null text: null)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>" + ", redacted string" * redacted
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        found = [find_spans(t) if t else [] for t in texts]
        rows = [[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in f] for f in found]
        clean = [pa.array([redact(t, f) if f else t for t, f in zip(texts, found)], pa.string())] if redacted else []
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, spans_type), *clean], names=[id_col, "spans", "redacted"][:2 + redacted])
    return map_batches(docs.select(col(id_col), col(text_col)), work, schema)
