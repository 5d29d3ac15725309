import base64
import hashlib
import random

import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import types as T

from tickscope.llm import warc

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       *[T.StructField(c, T.StringType()) for c in ("digest", "size", "first", "key", "Payload", "a.b")]])


def pages(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def table():
    rng = random.Random(3)
    rows = [(i, f"http://h{i % 5}.example/p?q={i}", f"<p>{rng.randrange(30)}</p>\r\n\r\nWARC/1.1\r\n") for i in range(60)]
    return rows + [(100, None, None), (101, "", ""), (102, "http://x/é\r\nWARC-Type: evil", "é" * 50_000), (103, "u", "<long>" + "ab" * 200_000), (None, "u", "no id"), (None, "u", "no id"),
                   (104, "u", "one id"), (None, "v", "one id"), (105, "u", "twice"), (105, "u", "twice"), (106, "w", "twice")]


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        low = first.get(html or "")
        again = low is not None and i != low
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", low if again else None))
    return sorted(out, key=repr)


def result(frame):
    return sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in frame.collect()], key=repr)


@pytest.mark.parametrize("frame_bytes, bundle_bytes", [(1, 1), (2000, 4000), (1 << 20, 64 << 20)])
def test_round_trip(spark, docs, frame_bytes, bundle_bytes):
    rows = table()
    assert result(warc.archived(pages(spark, rows).repartition(5), frame_bytes=frame_bytes, bundle_bytes=bundle_bytes)) == expected(rows)


def test_payloads_urls_and_random_access(spark, docs):
    rows = table()
    folder, index = warc.write_archive(pages(spark, rows).repartition(3), frame_bytes=3000)
    every = {}
    for r in warc.read_archive(index, folder).collect():
        every.setdefault(r["record_id"], []).append(r)
    assert sum(map(len, every.values())) == len(rows) == index.count()
    text = {i: html or "" for i, _, html in rows if i is not None}
    for same in every.values():
        for r in same:
            assert "\r" not in r["target_uri"] and " " not in r["target_uri"]
            if r["record_type"] == "response" and r["key"] is not None:
                assert r["payload"].decode() == text[int(r["key"])]
            elif r["record_type"] == "revisit":
                assert r["payload"] is None and r["payload_bytes"] == len(text[int(r["refers_to"])].encode())
    wanted = index.filter("record_id like '%x-page:1%' or record_id like '%page:-:%'")
    got = warc.lookup(index, folder, wanted).collect()
    assert sorted(r["record_id"] for r in got) == sorted(r["record_id"] for r in wanted.collect())
    assert all(r["payload"] == every[r["record_id"]][0]["payload"] for r in got)


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, docs):
    folder, index = warc.write_archive(pages(spark, table()).coalesce(1), frame_bytes=3000)
    system, path = warc.opened(folder)
    files = system.get_file_info(pafs.FileSelector(path))
    assert {f.base_name for f in files} == {r["bundle"] for r in index.select("bundle").distinct().collect()}
    for f in files:
        data = system.open_input_file(f.path).read()
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        parts = warc.seek_table(f"{folder}/{f.base_name}")
        assert len(parts) > 2 and b"".join(warc.read_frame(f"{folder}/{f.base_name}", *p) for p in parts) == plain
        at, records = 0, 0
        while at < len(plain):
            _, at = warc.decode(plain, at)
            records += 1
        assert records == index.filter(index.bundle == f.base_name).count()


def test_min_bytes_and_empty(spark, docs):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    assert [(r[0], r[3]) for r in result(warc.archived(pages(spark, rows), min_bytes=3))] == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert warc.archived(pages(spark, [])).count() == 0


def test_broken_archives_are_noticed(spark, docs):
    record = warc.encode("1", "u", b"body", base64.b32encode(hashlib.sha1(b"body").digest()).decode(), None, "1970-01-01T00:00:00Z")
    assert warc.decode(record)[0]["payload"] == b"body"
    with pytest.raises(ValueError):
        warc._checked(warc.decode(record.replace(b"body", b"bodi"))[0], True)
    with pytest.raises(ValueError):
        warc.decode(record[:-3] + b"xyz")
