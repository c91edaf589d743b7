from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from stratagrid.llm.common import components
from stratagrid.llm.simhash import fingerprint, forest, links, near_duplicates


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def grouped(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


TEXTS = ["", None, " \t\n", "One", "one two", "A b C d e", "a B c D E", "Éa\xa0b c d\x85e f", "x " * 70000, "the same words again and again " * 40]


def test_fingerprint_against_the_plain_definition(spark):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["Aa", "b", "ça", "dd", "e"]) for _ in range(rng.randrange(30))) for _ in range(100)]
    assert [fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    h = spark.sql("select xxhash64('a b c') as h").first().h % 2**64
    assert h == xxhash.xxh64_intdigest(b"a b c", seed=42)


def test_forest_joins_exactly_what_brute_force_joins():
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**64, 60, dtype=np.uint64)
    near = [s ^ np.uint64(1 << int(k)) ^ np.uint64(1 << int(m)) for s in seeds for k, m in rng.integers(0, 64, (6, 2))]
    every = np.unique(np.concatenate([seeds, np.array(near, dtype=np.uint64)]))
    want = [(int(a), int(b)) for i, a in enumerate(every) for b in every[:i] if bin(int(a) ^ int(b)).count("1") <= 3]
    plain = grouped(want, [int(x) for x in every])
    for side in (4, 256):
        assert grouped(forest(every, None, 3, side), [int(x) for x in every]) == plain
    cut = rng.random(len(every)) < 0.5
    a, b = every[cut], every[~cut]
    got = grouped(forest(a, b, 3, 8) + forest(a, None, 3) + forest(b, None, 3), [int(x) for x in every])
    assert got == plain


def test_links_with_small_tiles_lose_nothing(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    every = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << k) for k in range(0, 64, 3)), np.array([k for k in range(1, 400)], dtype=np.uint64)]))
    want = [(int(a), int(b)) for i, a in enumerate(every) for b in every[:i] if bin(int(a) ^ int(b)).count("1") <= 3]
    prints = spark.createDataFrame([(int(x.view(np.int64)),) for x in every], "fp long")
    for tile, n in ((8, None), (1024, None), (1024, 1 << 30), (4, 1 << 40)):  # the last two as if there were so many prints
        got = [(r.u % 2**64, r.v % 2**64) for r in links(prints, 3, tile, n).collect()]
        assert grouped(got, [int(x) for x in every]) == grouped(want, [int(x) for x in every])


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["aa", "b", "ca", "dd", "e", "ff"]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:30]] + texts[:20] + TEXTS
    rows = [(i * 3 % 101, t, 5, 6, "x") for i, t in enumerate(texts)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp long, id long, component string")).toPandas()
    fps = [slow_fingerprint(t) for t in texts]
    group = grouped([(a, b) for a in set(fps) for b in set(fps) if bin(a ^ b).count("1") <= 3], set(fps))
    least = {}
    for (d, *_), f in zip(rows, fps, strict=True):
        least[group[f]] = min(least.get(group[f], 999), d)
    want = sorted((d, f"{f:016x}", least[group[f]]) for (d, *_), f in zip(rows, fps, strict=True))
    assert sorted(got.itertuples(index=False, name=None)) == want


def test_masks_leave_no_pair_out():
    from stratagrid.llm.simhash import masks

    assert [len(masks(n, 3, 1024)) for n in (100, 1 << 26, 1 << 27, 1 << 36, 1 << 60)] == [4, 4, 10, 20, 20]
    rng = np.random.default_rng(2)
    for n in (100, 1 << 30, 1 << 40):
        for _ in range(200):
            away = sum(1 << int(k) for k in rng.choice(64, 3, replace=False))
            assert any(m % 2**64 & away == 0 for m in masks(n, 3, 1024))


def test_joins_with_hot_keys(spark):
    from pyspark.sql import functions as F

    from stratagrid.llm.common import join_to

    rows = spark.createDataFrame([(i, 7 if i < 300 else i % 40, f"x{i}") for i in range(600)] + [(900, None, None)], "id long, k long, n string")
    facts = rows.where("k < 30").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).select("k", F.col("top"), "n")
    want = None
    for most, hot in ((1 << 20, 10), (0, 100), (70, 100), (0, 10_000)):
        got = sorted(map(tuple, join_to(rows.drop("n"), facts, "k", F.col("id"), hot, most).select("id", "k", "top").collect()), key=str)
        want = want or got
        assert got == want and len(got) == 601


def test_null_keys_and_empty_table(spark):
    got = near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "zz yy xx ww"), (4, "a b c")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 4), (None, None), (4, 4)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains_stars_and_repeats(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 3), (3, 7), (5, 5), (-4, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == grouped(pairs, {x for p in pairs for x in p})


def jaccard(a, b):
    of = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))}
    x, y = of(a.split()), of(b.split())
    return len(x & y) / len(x | y)


def test_similar_documents_at_0_8(spark):
    from stratagrid.llm.simhash import similar_documents

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(2000)]
    rows, want = [], {}
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(150, 400))]
        rows.append((i, " ".join(text), 1, "x"))
        near = list(text)
        for _ in range(max(1, len(text) // 100)):  # about 1 % of the words: similarities about 0.9
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((1000 + i, " ".join(near), 1, "x"))
        want[1000 + i] = jaccard(rows[-2][1], rows[-1][1])
        far = list(text)
        for _ in range(len(text) // 8):
            far[rng.randrange(len(far))] = rng.choice(words)
        rows.append((2000 + i, " ".join(far), 1, "x"))
    rows += [(3000, None, 1, "x"), (3001, "", 1, "x"), (None, rows[0][1], 1, "x")]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string, node int, fp string")).collect()}
    close = [k for k, j in want.items() if j >= 0.85]
    assert len(close) > 60 and sum(got[k] == k - 1000 for k in close) >= 0.97 * len(close)
    assert all(got[k] == k for k in range(120)) and sum(got[2000 + i] == 2000 + i for i in range(120)) >= 118
    assert got[3001] == got[3000] == 3000 and got[None] == 0
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wide_links_with_small_tiles_lose_nothing(spark):
    from stratagrid.llm.simhash import wide_links

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, (6, 2), dtype=np.uint64)
    rows = [bytes(b.tobytes()) for b in base]
    for b in base:
        for _ in range(30):
            x = b.copy()
            x[1] ^= np.uint64(1 << int(rng.integers(64)))
            x[1] ^= np.uint64(1 << int(rng.integers(64)))
            rows.append(x.tobytes())
    rows = sorted(set(rows))
    value = [int.from_bytes(r, "little") for r in rows]
    want = [(i, j) for i in range(len(rows)) for j in range(i) if (value[i] ^ value[j]).bit_count() <= 3]
    df = spark.createDataFrame([(i, bytearray(r), v.bit_count()) for i, (r, v) in enumerate(zip(rows, value, strict=True))], "node long, fp binary, ones int")
    for tile in (4, 512):
        got = [(r.u, r.v) for r in wide_links(df, 3, tile).collect()]
        assert grouped(got, range(len(rows))) == grouped(want, range(len(rows)))


def test_similar_documents_on_both_sides_of_0_8(spark):
    from stratagrid.llm.simhash import similar_documents

    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows, want = [], {}
    for i in range(600):
        text = [rng.choice(words) for _ in range(300)]
        near = list(text)
        for k in range(6 if i < 300 else 7 + i % 3):  # apart from each other: each takes five shingles
            near[10 + 30 * k] = "changed"
        rows += [(i, " ".join(text)), (1000 + i, " ".join(near))]
        want[i] = jaccard(rows[-2][1], rows[-1][1])
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    close, far = [i for i, j in want.items() if 0.80 <= j <= 0.85], [i for i, j in want.items() if 0.70 <= j < 0.80]
    assert len(close) == 300 and len(far) == 300
    assert sum(got[1000 + i] == i for i in close) >= 0.98 * len(close)
    assert all(got[1000 + i] == 1000 + i for i in far)


def test_chains_of_links_through_a_loose_group(spark):
    from stratagrid.llm.simhash import similar_documents

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    rows, text = [], [rng.choice(words) for _ in range(400)]
    for i in range(24):  # each four words from the one before, thus near, and ever further from the first
        rows.append((i, " ".join(text)))
        for k in range(4):
            text[(16 * i + 4 * k) % 400] = f"new{i}x{k}"
    rng.shuffle(rows)
    texts = dict(rows)
    edges = [(i, j) for i in texts for j in texts if i < j and jaccard(texts[i], texts[j]) >= 0.8]
    got = {r.doc_id: r.component_id for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(edges) >= 23 and set(got.values()) == {0}


def test_label_links_join_what_all_links_join(spark):
    from stratagrid.llm import simhash as S

    rng = np.random.default_rng(5)
    rows = []
    for c in range(3):
        base = rng.integers(-(2**62), 2**62, 60)
        for k in range(40):
            own = base.copy()
            own[rng.choice(60, 3 + k % 2, replace=False)] = rng.integers(-(2**62), 2**62, 3 + k % 2)
            rows.append((c, 100 * c + (k if k % 3 else 0), 1000 * c + k, np.unique(own)))
    fp = [S.print_of([r[3].view(np.uint64)], 8) for r in rows]
    radius = 120
    near = lambda i, j: (int.from_bytes(fp[i], "little") ^ int.from_bytes(fp[j], "little")).bit_count() <= radius
    alike = lambda i, j: len(set(rows[i][3]) & set(rows[j][3])) / len(set(rows[i][3]) | set(rows[j][3])) >= 0.8
    same = [(r[2], q[2]) for r in rows for q in rows if r[:2] == q[:2]]
    want = same + [(rows[i][2], rows[j][2]) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] and near(i, j) and alike(i, j)]
    df = spark.createDataFrame([(c, lab, node, bytearray(f), int.from_bytes(f, "little").bit_count(), x.tolist()) for (c, lab, node, x), f in zip(rows, fp, strict=True)], "component long, label long, node long, fp binary, ones int, shingles array<long>")
    names = [r[2] for r in rows]
    for most in (900, 5000, 1 << 21):
        got = [(r.u, r.v) for r in S.label_links(df, radius, 0.8, most).collect()]
        assert grouped(same + got, names) == grouped(want, names) != grouped(same, names)
    assert len(got) < len(names)  # one tile for a component: no more edges than labels
