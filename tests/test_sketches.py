from __future__ import annotations

import random

from stratagrid.operators import sketches as K


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    bits, items = K.bloom_size(0.01, 500), spark.range(500).withColumnRenamed("id", "x")
    k = K.bloom_hashes(bits, 500)
    for partitioned in (False, True):
        f = K.bloom(items, "x", k, bits, partitioned)
        told = K.bloom_contains(f, spark.range(5000).withColumnRenamed("id", "x"), "x", k, bits, partitioned)
        r = K.confusion(told, items, "x").first()
        assert r.fn == 0 and r.tp == 500 and r.fp < 200 and r.tn + r.fp == 4500
    a, b = (K.bloom(items.where(c), "x", k, bits) for c in ("x < 250", "x >= 250"))
    assert K.bloom_union(a, b).count() == K.bloom(items, "x", k, bits).count()
    assert K.hamming(a, a) == 0 and K.hamming(a, b) > 0


def test_counting_removal_and_saturation(spark):
    items = spark.createDataFrame([(i % 10,) for i in range(100)], "x long")
    c = K.counting(items, "x", 3, 4096, 4)
    assert {r.estimate for r in K.counting_lookup(c, items, "x", 3, 4096).collect()} == {10}
    left = K.counting_remove(c, items.where("x < 5"), "x", 3, 4096, 4)
    assert {r.x: r.estimate for r in K.counting_lookup(left, items, "x", 3, 4096).collect()} == {i: 0 if i < 5 else 10 for i in range(10)}
    many = spark.range(1000).selectExpr("1L as x")
    assert K.counting_lookup(K.counting(many, "x", 3, 64, 2), many, "x", 3, 64).first().estimate == 3


def test_counter_vector_bits():
    v = K.CounterVector(3, 2)
    assert [v.increment(0) for _ in range(4)] == [True, True, True, False] and v.text() == "110000"
    assert v.decrement(0) and not v.decrement(1) and v.text() == "010000"
    w = K.CounterVector(3, 2)
    w.increment(0, 2)
    v.merge(w)
    assert v.text() == "110000"


def test_ordered_filters_never_count_too_little():
    rng = random.Random(1)
    items = [rng.randrange(60) for _ in range(600)]
    true = {x: items.count(x) for x in items}
    low = K.fold(K.SpectralMinimum(K.Cells(4, 2048), 12), items)
    twice = K.fold(K.SpectralRecurring(K.Cells(4, 2048), K.Cells(3, 1024, 5), 12), items)
    assert all(low.lookup(x) >= n for x, n in true.items()) and all(twice.lookup(x) >= n for x, n in true.items())
    bits = K.fold(K.Bitwise(4, 1 << 14, 8), items)
    assert sum(bits.lookup(x) == n for x, n in true.items()) > 0.9 * len(true)
    aging = K.fold(K.AgingPair(4, 8192, 20), range(100))
    assert all(aging.lookup(x) for x in range(85, 100)) and not any(aging.lookup(x) for x in range(50))
    fading = K.fold(K.Stable(4, 512, 3, 80), range(2000))
    assert fading.lookup(1999) > 0 and sum(fading.lookup(x) > 0 for x in range(200)) < 50


def test_ordered_sketches_fold_every_event_in_order(spark, tmp_path):
    from pyspark.sql import functions as F

    from stratagrid.plans import registry

    rng = random.Random(6)
    rows = [(i, 7 * rng.randrange(400)) for i in range(3000)]
    spark.createDataFrame(rng.sample(rows, len(rows)), "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    users = sorted({u for _, u in rows})
    parts = -(-len(users) // registry.FOLDED_USERS)
    part = {r.u: r.p for r in spark.createDataFrame([(u,) for u in users], "u long").select("u", F.pmod(F.xxhash64("u"), F.lit(parts)).alias("p")).collect()}
    made = {p: registry._ordered_filters() for p in range(parts)}
    for _, u in rows:
        for m in made[part[u]].values():
            m.add(u)
    want = [(u, *(int(m.lookup(u)) for m in made[part[u]].values())) for u in users]
    assert parts > 1 and sorted(map(tuple, registry.QUERIES["ordered_sketches"](spark, str(tmp_path)).collect())) == want


def test_bitwise_counts_do_not_wrap():
    f = K.Bitwise(4, 1 << 14)
    for n in range(1, 300):
        f.add("x")
        assert f.lookup("x") == n
    assert len(f.levels) == 9 and f.lookup("y") == 0


def test_recurring_minimum_takes_out_what_was_put_in():
    rng = random.Random(3)
    items = [rng.randrange(80) for _ in range(900)]
    f = K.fold(K.SpectralRecurring(K.Cells(4, 2048), K.Cells(3, 1024, 5), 12), items)
    gone = items[:500]
    for x in gone:
        f.remove(x)
    left = {x: items[500:].count(x) for x in set(items)}
    assert sum(f.lookup(x) == n for x, n in left.items()) > 0.9 * len(left)
    v = K.CounterVector(2, 3)
    assert v.set(0, 5) and v.count(0) == 5 and not v.set(1, 9) and v.count(1) == 7


def test_xor_tables_hold_every_key_and_few_others(spark):
    rng = random.Random(2)
    pairs = {rng.randrange(-(1 << 62), 1 << 62): rng.randrange(1 << 40) for _ in range(3000)}
    df = spark.createDataFrame([*pairs.items(), (None, 3)], "key long, item long")
    asked = spark.createDataFrame([(k,) for k in pairs] + [(rng.randrange(1 << 62),) for _ in range(3000)], "key long")
    got = K.xor_lookup(df, asked, block=700).collect()
    found = {r.key: r["item"] for r in got if r.found}
    assert all(found[k] == v for k, v in pairs.items()) and len(found) - len(pairs) < 60 and all(r["item"] is None for r in got if not r.found)
    assert {r.found for r in K.xor_lookup(df.limit(0), asked).collect()} == {False}


def test_evaluator_reads_files(spark, tmp_path):
    (tmp_path / "in.txt").write_text("".join(f"w{i}\n" for i in range(200)))
    (tmp_path / "asked.txt").write_text("".join(f"   {1 + i % 3} w{i}\n" for i in range(150, 400)) + "no count\n")
    members, counted = K.read_items(spark, str(tmp_path / "in.txt")), K.read_counted(spark, str(tmp_path / "asked.txt"))
    rows = K.trials(members, counted, "item", 200, [0.5, 0.001]).collect()
    inside, outside = (sum(1 + i % 3 for i in r) for r in (range(150, 200), range(200, 400)))
    assert all(r.tp == inside and r.fn == 0 and r.fp + r.tn == outside for r in rows)
    assert rows[0].fp > 0.2 * outside and rows[1].fp < 0.05 * outside and rows[0].bits < rows[1].bits


def test_removed_members_are_not_found(spark):
    items = spark.range(100).withColumnRenamed("id", "x")
    f = K.bloom(items, "x", 3, 4096)
    left = K.bloom_remove(f, items.where("x < 20"), "x", 3, 4096)
    assert not [r for r in K.bloom_contains(left, items, "x", 3, 4096).collect() if r.found and r.x < 20]
