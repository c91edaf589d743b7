from __future__ import annotations

import hashlib

import pytest

from stratagrid.llm import warc as W

SCHEMA = "page_id long, html string, url string, digest int, data string, first string"
ROWS = [(5, "x" * 100), (3, "x" * 100), (9, "x" * 100), (1, "y" * 99), (2, "y" * 99), (4, None), (6, ""), (7, "é" * 70000), (8, "é" * 70000), (10, "\r\n\r\n" * 9000), (None, "x" * 100), (11, "z" * 1000), (11, "z" * 1000), (None, "w" * 200)]


def frame(spark):
    return spark.createDataFrame([(a, b, f"http://h/{a}\r\n", 1, "d", "f") for a, b in ROWS], SCHEMA)


def want():
    out = []
    for a, b in ROWS:
        raw = (b or "").encode()
        ids = [x for x, y in ROWS if y == b and x is not None]
        first = min(ids) if len(raw) >= 100 and ids and a != min(ids) else None
        out.append((a, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first is None else "revisit", first))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [7, 4096, 1 << 16])
def test_round_trip_at_any_chunk_size(spark, chunk):
    chunks = W.write_records(frame(spark), chunk)
    assert sorted((tuple(r) for r in W.read_records(chunks).collect()), key=str) == want()
    assert chunks.selectExpr("max(length(data))").first()[0] < chunk + 700


def test_an_archive_is_a_warc_file(spark):
    rows = W.write_records(frame(spark).coalesce(1), 1000).orderBy("archive", "record", "chunk").collect()
    data, payloads = b"".join(bytes(r.data) for r in rows), []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        block, end, data = data[:n], data[n : n + 4], data[n + 4 :]
        assert end == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\n")
        payload = block.split(b"\r\n\r\n", 1)[1]
        if fields["WARC-Type"] == "response":
            assert hashlib.sha256(payload).hexdigest() == fields["WARC-Payload-Digest"][7:]
        payloads.append(payload)
    assert len(payloads) == len(ROWS)


def test_a_changed_or_lost_chunk_is_found(spark):
    chunks = W.write_records(frame(spark), 1000)
    rows = [r.asDict() for r in chunks.collect()]
    hit = next(r for r in rows if r["chunks"] > 3 and r["chunk"] == 1)
    for bad in ([r for r in rows if r is not hit], [r if r is not hit else r | {"data": b"q" + bytes(r["data"])[1:]} for r in rows]):
        with pytest.raises(Exception, match="digest|order|missing"):
            W.read_records(spark.createDataFrame(bad, W.CHUNKS)).collect()


def test_empty(spark):
    assert W.read_records(W.write_records(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_addresses_text_keys_and_many_digests(spark):
    rows = [("null", "a" * 200, "http://h/" + "u" * 70000), ("a>b\r\nc é", "a" * 200, "http://h/\r\n\r\nx"), (None, "b" * 300, None), ("zz", "", "u" * 200000), ("x", "c" * 5000, "é" * 70000), ("y", "c" * 5000, "")]
    df = spark.createDataFrame(rows, "page_id string, html string, url string")
    want = sorted([("null", 200, "revisit", "a>b\r\nc é"), ("a>b\r\nc é", 200, "response", None), (None, 300, "response", None), ("zz", 0, "response", None), ("x", 5000, "response", None), ("y", 5000, "revisit", "x")], key=str)
    for chunk, few in ((1 << 16, 10), (100, 0)):
        got = W.read_records(W.write_records(df, chunk, broadcast_digests=few), "string").collect()
        assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == want


def test_hot_payloads_do_not_change_the_records(spark, monkeypatch):
    monkeypatch.setattr(W, "HOT", 2)
    got = W.read_records(W.write_records(frame(spark), broadcast_digests=0)).collect()
    assert sorted(map(tuple, got), key=str) == want()
    assert W.read_records(W.write_records(spark.createDataFrame([], SCHEMA))).count() == 0
