from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratagrid.operators import buckets as B
from stratagrid.operators import emm, joins, metrics, schemes, truth
from stratagrid.operators.ranks import value_at_rank
from stratagrid.plans import workload
from stratagrid.sources import points as P
from stratagrid.sources import stores
from stratagrid.streaming import slots as S

POINTS = "record_id long, join_key long, ts long, lat double, lon double"


def some_points(n=600, seed=1, hot=0.3):
    rng = random.Random(seed)
    return [(i + 1, rng.randrange(40), 1_700_000_000 + (7 if rng.random() < hot else rng.randrange(400_000)), round(rng.uniform(-40, 50), 2), round(rng.uniform(-90, 120), 2)) for i in range(n)]


def some_boxes(rows, k=12, seed=2):
    rng, out = random.Random(seed), []
    for q in range(k):
        a, b = rng.choice(rows), rng.choice(rows)  # edges lie on points
        lo = lambda x, y: (min(x, y), max(x, y))
        out.append((q, *lo(a[2], b[2]), *lo(a[3], b[3]), *lo(a[4], b[4])))
    return [*out, (k, 0, 10**10, -90.0, 90.0, -180.0, 180.0), (k + 1, 5, 6, 0.0, 1.0, 0.0, 1.0), (k + 2, 1_700_000_000, 1_800_000_000, 80.0, 85.0, 0.0, 1.0)]


def plain_buckets(rows, z):
    out, now, slots = [], [], set()
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    for i, r in enumerate(order):
        now.append(r[0])
        slots.add(r[2] // z.slot_seconds)
        last = i + 1 == len(order) or order[i + 1][2] // z.slot_seconds != r[2] // z.slot_seconds
        if len(now) >= z.most or (last and (len(slots) >= z.slots or len(now) >= z.target)):
            out.append(now)
            now, slots = [], set()
    return [*out, now] if now else out


@pytest.mark.parametrize("z", [B.Sizes(), B.Sizes(600, 50, 60, 16), B.Sizes(86400, 100, 150, 3), B.Sizes(3600, 7, 7, 1), B.Sizes(600, 1, 1, 1)])
def test_buckets_against_the_record_loop(spark, z):
    rows = some_points()
    got = B.with_buckets(spark.createDataFrame(rows, POINTS), z).collect()
    want = {i: k for k, b in enumerate(plain_buckets(rows, z)) for i in b}
    assert {r.record_id: r.bucket_id for r in got} == want and len(got) == len(rows)
    table = B.bucket_table(B.with_buckets(spark.createDataFrame(rows, POINTS), z)).orderBy("bucket_id").collect()
    assert [r.n for r in table] == [len(b) for b in plain_buckets(rows, z)] and table[-1].next_bucket is None
    assert B.Sizes(0, 5, 2, -1).normal() == B.Sizes(1, 5, 5, 1)


@pytest.mark.parametrize("name", sorted(schemes.SCHEMES))
def test_candidates_hold_the_truth(spark, name):
    rows = some_points()
    points, boxes = spark.createDataFrame(rows, POINTS).cache(), P.query_boxes(spark, some_boxes(rows))
    if name in ("slot", "slot_cover"):
        found = schemes.SCHEMES[name](points, boxes, B.Sizes(3600, 40, 60, 8))
    else:
        found = schemes.SCHEMES[name](points, boxes)
    wanted = truth.batch_truth(points, boxes)
    assert metrics.is_superset(found, wanted)
    assert found.count() == found.distinct().count()
    got = {r.query_id: r for r in metrics.accuracy(found, wanted, boxes).collect()}
    for q, s, e, a, b, c, d in some_boxes(rows):
        n = sum(s <= r[2] <= e and a <= r[3] <= b and c <= r[4] <= d for r in rows)
        assert (got[q].n_truth, got[q].tp, got[q].fn, got[q].superset) == (n, n, 0, True)
    assert schemes.SCHEMES[name](points.limit(0), boxes).count() == 0


def test_order_statistics_and_default_window(spark):
    rows = some_points(2001)
    df = spark.createDataFrame(rows, POINTS)
    import stratagrid.operators.ranks as R

    R.FEW, keep = 20, R.FEW
    try:
        values = sorted(r[3] for r in rows)
        assert [value_at_rank(df, "lat", k) for k in (0, 1000, 2000)] == [values[0], values[1000], values[2000]] and value_at_rank(df, "lat", 2001) is None
        assert truth.default_window(df).first().record_id == sorted(r[0] for r in rows)[1000]
    finally:
        R.FEW = keep


def test_multimap_lists_missing_keywords_and_wrong_keys(spark):
    lists = {"keyword1": range(1, 6), "keyword2": range(6, 9), "keyword3": (9, 10), "keyword4": range(11, 18), "single": (100,)}
    rows = spark.createDataFrame([(k, i) for k, v in lists.items() for i in v], "label string, record_id long")
    store = emm.EncryptedStore(rows)
    asked = spark.createDataFrame([(n, k) for n, k in enumerate([*lists, "missing"])] + [(10, "keyword1"), (10, "keyword2")], "query_id int, label string")
    got = {}
    for r in store.query(asked).collect():
        got.setdefault(r.query_id, set()).add(r.record_id)
    assert got == {**{n: set(v) for n, v in enumerate(lists.values())}, 10: set(range(1, 9))}
    size = store.size().first()
    assert (size.entries, size.label_bytes, size.value_bytes) == (18, 18 * 32, 18 * 16)
    other = emm.Keys(value="another")
    assert emm.decrypt(emm.lookup(store.index, emm.tokens(asked), store.counts), other).count() == 0


def test_joins_by_keyword(spark):
    rng = random.Random(3)
    left = [(f"slot{rng.randrange(6)}", rng.randrange(12), i) for i in range(200)]
    right = [(rng.choice("AB"), rng.randrange(12)) for _ in range(9)]
    entries = joins.build_masked(spark.createDataFrame(left, "keyword string, join_key long, record_id long"))
    keys2 = joins.build_keys(spark.createDataFrame(right, "keyword string, join_key long"))
    asked = [(1, "slot1", "A"), (2, "slot2", "B"), (2, "slot3", "B"), (3, "none", "A")]
    got = {(r.query_id, r.record_id) for r in joins.masked_join(entries, keys2, spark.createDataFrame(asked, "query_id int, keyword string, keyword2 string")).collect()}
    assert got == {(q, i) for q, k, k2 in asked for s, v, i in left if s == k and (k2, v) in right}
    assert spark.range(1).select(joins.strip_prefix(F.lit("user=17"), "user")).first()[0] == "17"


def test_workload(spark):
    rows = some_points(2500, hot=0.05)
    points = spark.createDataFrame(rows, POINTS)
    plan = workload.plan_table(points, "d", B.Sizes(600, 100, 150, 16)).collect()
    assert len(plan) == 100 and {r.kind for r in plan} == {"inside", "across"} and all(r.start <= r.end for r in plan)
    dense = workload.density(points).collect()
    assert sum(1 for _ in dense) == len(rows)


def test_checkin_files_plans_and_stores(spark, tmp_path):
    (tmp_path / "c.csv").write_text("userid,venueid,venuecategoryid,venuecategory,latitude,longitude,timezoneoffset,utctimestamp,id\r\n" + "".join(f"u{i},v,c,n,{'bad' if i == 2 else 40 + i / 10},{-70 - i},0,2012-04-03 18:{i:02d}:18+00,{i}\r\n" for i in range(6)) + "short,row\r\n")
    got = P.read_checkins(spark, str(tmp_path / "c.csv")).orderBy("record_id").collect()
    assert [(r.record_id, r.join_key, r.id) for r in got] == [(1, "u0", "0"), (2, "u1", "1"), (3, "u3", "3"), (4, "u4", "4"), (5, "u5", "5")] and got[0].ts == 1333477038 - 17 * 60
    assert P.read_checkins(spark, str(tmp_path / "c.csv"), 2).count() == 2
    assert P.read_join_table(spark, str(tmp_path / "c.csv"))[0] == "userid"
    (tmp_path / "e.csv").write_text("id1,id2\n1,2\n2,3\n,4\n")
    assert sorted(r[0] for r in P.read_expected_ids(spark, str(tmp_path / "e.csv")).collect()) == [1, 2, 3, 4]
    head = "dataset,query_start,query_end,actual_query_start,actual_query_end,query_lat_min,query_lat_max,query_lon_min,query_lon_max\n"
    (tmp_path / "p.csv").write_text(head + '"a ""x""",1,2,,,0,1,2,3\nb,1,2, 5 ,6,0,1,2,3\n')
    plan = P.read_query_plan(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.dataset, r.query_start, r.query_end) for r in plan] == [('a "x"', "1", "2"), ("b", "5", "6")]
    assert P.read_query_plan(spark, str(tmp_path / "p.csv"), "b").count() == 1
    (tmp_path / "q.csv").write_text(head + "b,,,,,0,1,2,3\n")
    with pytest.raises(Exception, match="range"):
        P.read_query_plan(spark, str(tmp_path / "q.csv")).collect()
    index = emm.build(spark.createDataFrame([("k", 1), ("k", 2)], "label string, record_id long"))
    stores.write_json_index(index, str(tmp_path / "j"))
    back = stores.read_json_index(spark, str(tmp_path / "j"), "ct_label binary, ct_value binary")
    assert {bytes(r.ct_label) for r in back.collect()} == {bytes(r.ct_label) for r in index.collect()}
    stores.write_index(index.withColumn("key", F.lit(3)), str(tmp_path / "x"), "key")
    assert spark.read.parquet(str(tmp_path / "x")).where("key = 3").count() == 2
    stores.append_results(spark.createDataFrame([(1,)], "a long"), str(tmp_path / "r"))
    stores.append_results(spark.createDataFrame([(2, "n")], "a long, b string"), str(tmp_path / "r"))
    assert {tuple(r) for r in stores.read_results(spark, str(tmp_path / "r")).select("a", "b").collect()} == {(1, None), (2, "n")}
    stores.write_plan(spark.createDataFrame([(1, "x")], "a long, b string"), str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True).first().b == "x"


def test_settings_lines_and_generators(spark, monkeypatch):
    monkeypatch.setenv("SLOTS", "-4")
    monkeypatch.setenv("BAD", "x")
    assert stores.setting("slots", 7) == 1 and stores.setting("bad", 7) == 7 and stores.setting("none", "t") == "t" and stores.setting("bad", 0.5) == 0.5
    line = spark.range(1).select(stores.result_line(["id"]).alias("x"))
    assert line.select(stores.parse_result(F.col("x"))["id"]).first()[0] == "0"
    assert spark.range(1).select(stores.scrape(F.lit("Build time: 12.5 ms"), "build time")).first()[0] == 12.5
    keys = stores.zipf_keys(spark, 5000, 50).groupBy("key").count().orderBy("key").collect()
    assert keys[0].key == 1 and keys[-1].key == 50 and keys[0]["count"] > 5 * keys[-1]["count"]
    assert stores.uniform_keys(spark, 100, 5).where("key between 0 and 4").count() == 100
    assert metrics.per_record(10, 480, 2.0) == (5.0, 48.0) and metrics.per_record(0, 0, 0.0) == (0.0, 0.0)


def test_streams(spark, tmp_path):
    rows = [(i, 1, 1_700_000_000 + 300 * i, 0.0, 0.0) for i in range(20)] * 2
    spark.createDataFrame(rows, POINTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(POINTS).parquet(str(tmp_path / "in"))
    for name, df, mode in (("slots", S.slot_counts(stream), "complete"), ("fresh", S.new_points(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
    counts = {r.abs_slot: r.n for r in spark.table("slots").collect()}
    assert sum(counts.values()) == 40 and set(counts) == {r[2] // 600 for r in rows}
    assert spark.table("fresh").count() == 20
