from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from stratagrid.llm import packing as P

SCHEMA = "doc_id long, text string, rank int, size string, id int"


def test_ids_are_those_of_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", " ", "<|endoftext|> x", "a" * 3000, "\n\n  \t é😀 '’s 12 ½ ٣", "  The end.  　x\xa0y"] + ["".join(rng.choice("ab é😀\n'sT1½,! 中") for _ in range(200)) for _ in range(200)]
    encode = P.encoder(P.vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_combinations_and_nnls():
    w = P.combinations(30)
    every = {(a, b, 30 - a - b) for a in range(1, 30) for b in range(1, a + 1) if 0 <= 30 - a - b <= b}
    assert {tuple(x) for x in w.tolist()} == every and len(w) == len(every)
    true = np.zeros(len(w))
    true[[3, 40, 60]] = [50, 20, 70]
    a = np.zeros((30, len(w)))
    for s, row in enumerate(w):
        for v in row:
            if v:
                a[v, s] += 1
    x = P.nnls(w, (a @ true).astype(int))
    assert (x >= 0).all() and np.abs(a @ x - a @ true).max() < 5


@pytest.mark.parametrize("lengths", [[600] * 1001, [1], [], list(range(1, 64)) * 7, [63] * 5 + [1] * 3, [40] * 1000 + [17] * 999])
def test_plan_places_every_token_once_and_pads_nothing(lengths):
    window = 1024 if max(lengths, default=0) > 64 else 64
    counts = np.bincount(lengths, minlength=window)[:window].astype(np.int64) if lengths else np.zeros(window, dtype=np.int64)
    chosen = P.plan(counts, window)
    sums = [sum(b - a for _, a, b in parts) for n, parts in chosen]
    assert all(s == window or s & (s - 1) == 0 for s in sums) and sum(n for (n, _), s in zip(chosen, sums, strict=True) if s < window) <= window.bit_length()
    seen = {}
    filled = {}
    for v, a, b, lo, hi, seq, off in P.placements(chosen):
        for k in range(lo, hi):
            seen.setdefault((v, k), []).append((a, b))
            filled.setdefault(seq + k - lo, []).append((off, b - a))
    assert sorted(v for v, _ in seen) == sorted(lengths)
    for (v, k), parts in seen.items():
        assert k < counts[v] and [x for p in sorted(parts) for x in range(*p)] == list(range(v))
    for parts in filled.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n


def test_pack_against_the_ids_of_every_row(spark):
    import public_tokenizers

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", "ä", "word", "12"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    rows = [(i % 140, t, 1, "a", 2) for i, t in enumerate(texts)] + [(None, None, 1, "a", 2), (500, "", 1, "a", 2), (501, "same same", 1, "", 1), (501, "same same", 1, "", 1), (502, "long " * 5000, 1, "", 1)]
    encode = P.encoder(P.vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    got = P.pack(spark.createDataFrame(rows, SCHEMA), window=64).toPandas()
    left = {}
    for d, t, *_ in rows:
        left.setdefault(-1 if d is None else d, []).append(np.array([*encode(t or ""), 0], dtype="<u4"))
    assert got["length"].sum() == sum(len(x) for v in left.values() for x in v)
    for r in got.itertuples():
        ids = left[-1 if r.doc_id != r.doc_id else int(r.doc_id)]
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids)
    for k, g in got.groupby(got.doc_id.fillna(-1)):
        if len(left[int(k)]) == 1:
            g = g.sort_values("start")
            assert g.start.tolist() == [0, *np.cumsum(g["length"])[:-1]]
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g["length"])[:-1]]
        assert g["length"].sum() == 64 or g["length"].sum() & (g["length"].sum() - 1) == 0
    assert P.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_special_strings_are_those_of_the_tokenizers_library_at_its_defaults(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.vocabulary_path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n x", "<|endoftext| >", "no  such\n", "it's<|endoftext|>'s é  "]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    encode = P.encoder(P.vocabulary_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, P.SPECIAL)
    assert want[0] == [64, 220, 50256, 275] and [encode(x) for x in texts] == want
    ids = np.array([*want[0], 0], dtype="<u4")
    for r in P.pack(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), window=8).collect():
        assert r.doc_tokens == 5 and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
