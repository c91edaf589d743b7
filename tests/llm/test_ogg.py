from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from stratagrid.llm import ogg as O

SCHEMA = "doc_id long, text string, media int, id string, n_bytes string"


def slow_crc(data):
    reg = 0
    for x in data:
        reg ^= x << 24
        for _ in range(8):
            reg = (reg << 1) ^ 0x04C11DB7 if reg & 0x80000000 else reg << 1
        reg &= 0xFFFFFFFF
    return reg


def test_checksum_against_the_bitwise_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 27, 300):
        data = rng.randbytes(n)
        assert O.ogg_crc(data) == slow_crc(data)
    assert O.ogg_crc(b"123456789") == 0x89A1897F


@pytest.mark.parametrize("block", [1, 254, 255, 256, 510, 4096, 70000])
@pytest.mark.parametrize("streams", [1, 2, 3])
def test_round_trip(block, streams):
    rng = random.Random(block)
    for n in (0, 64, 255, 256, 5 * 255, 4096, 200_001 if block > 1 else 700):
        payload = rng.randbytes(n)
        data = O.mux(payload, 8000, streams, block)
        back, about = O.unmux(data)
        assert back == payload and len(about) == streams and sum(s["samples"] for s in about) == n
        for s in about:
            assert s["times"] == sorted(s["times"]) and (not s["samples"] or s["times"][-1] == s["samples"] / 8000)


def test_damage_is_found():
    data = O.mux(bytes(range(256)) * 500, block=70000)
    first = data.index(b"OggS", 4)
    for bad in (data[:100] + b"\xff" + data[101:], data[:-3], data[:first] + data[first:first] + data[data.index(b"OggS", first + 4) :], data + data[:first], b"RIFF" + data[4:]):
        with pytest.raises(ValueError):
            O.unmux(bad)
    pages = [p for p in data.split(b"OggS") if p]
    with pytest.raises(ValueError):
        O.unmux(b"".join(b"OggS" + p for p in pages[:-1]))
    assert b"".join(b"OggS" + p for p in pages) == data


def test_media_column(spark):
    texts = ["", None, "é" * 32, "a" * 63, "a" * 65, "x y " * 50000, "a" * 63]
    rows = [(i if i else None, t, 1, "q", "r") for i, t in enumerate(texts)]
    media = O.encode_media(spark.createDataFrame(rows, SCHEMA))
    got = {r.doc_id: r for r in O.media_features(media).collect()}
    stored = {r.doc_id: bytes(r.media) for r in media.collect()}
    for d, t, *_ in rows:
        raw = (t or "").encode()
        want = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[d]), hashlib.sha256(stored[d]).hexdigest())
    assert got[3][1:] == got[6][1:] and got[None][1:] == got[1][1:]
    assert O.media_features(O.encode_media(spark.createDataFrame([], SCHEMA))).count() == 0
    assert O.media_features(spark.createDataFrame([(1, 2, None)], "doc_id long, n_bytes long, media binary")).first().feature is None
