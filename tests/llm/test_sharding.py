from __future__ import annotations

import zlib

import numpy as np

from stratagrid.llm.sharding import assign_shards, jump_hash

SCHEMA = "doc_id long, text string, shard int, _salt string"
ROWS = [(i, f"text {i % 7}", 9, "x") for i in range(500)] + [(None, None, 1, None), (7, "é" * 3, 1, ""), (7, "", 1, ""), (8, None, None, None)]


def one_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_follows_the_published_loop_and_moves_only_into_the_new_shard():
    keys = np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = jump_hash(keys, 24), jump_hash(keys, 25)
    assert a.tolist() == [one_jump(int(k), 24) for k in keys]
    assert set(b[a != b]) == {24} and 60 < (a != b).sum() < 190
    assert jump_hash(keys[:0], 3).size == 0 and set(jump_hash(keys, 1)) == {0}


def test_shards_rows_sizes_and_gapless_slots(spark):
    got = assign_shards(spark.createDataFrame(ROWS, SCHEMA), 5, salts=4).toPandas()
    assert len(got) == len(ROWS)
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)
    assert sorted(zip(got["size"], got.text_crc32, strict=True)) == want
    assert got[got.doc_id == 7].shard.nunique() == 1 and (got[got["shard"] != got.grown_shard].grown_shard == 5).all()


def test_empty_table(spark):
    assert assign_shards(spark.createDataFrame([], SCHEMA), 5).count() == 0
