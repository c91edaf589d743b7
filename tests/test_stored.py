from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stratagrid.functions import bits
from stratagrid.operators import emm, index, metrics, schemes
from stratagrid.operators.ranks import id_part
from stratagrid.sources import points as P
from stratagrid.sources import shared, stores


def some_points(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(i, i % 7, 1704067200 + rng.randrange(4 * 86400), round(rng.uniform(-50, 50), 2), round(rng.uniform(-90, 90), 2)) for i in range(n)]
    return spark.createDataFrame(rows, "record_id long, join_key long, ts long, lat double, lon double")


BOXES = [(1, 1704067200, 1704067200 + 86400, -20.0, 20.0, -30.0, 30.0), (2, 1704070000, 1704400000, -1.0, 1.0, -1.0, 1.0), (3, 1, 2, -90.0, 90.0, -180.0, 180.0)]


def test_an_index_that_grows_answers_like_one_that_was_built_whole(spark, tmp_path):
    points, q = some_points(spark), P.query_boxes(spark, BOXES)
    edge = points.where("abs(lat) > 45 or abs(lon) > 80 or record_id < 100")  # so that the bounds are those of all
    whole = index.DayIndex.build(points, f"file://{tmp_path}/a", 4)
    grown = index.DayIndex.build(edge, f"file://{tmp_path}/b", 4).insert(points.join(edge, "record_id", "left_anti"))
    if [*whole.spark.read.parquet(f"{whole.path}/bounds").collect()] == [*grown.spark.read.parquet(f"{grown.path}/bounds").collect()]:
        for f in ("slot_candidates", "cover_candidates"):
            assert sorted(map(tuple, getattr(whole, f)(q).collect())) == sorted(map(tuple, getattr(grown, f)(q).collect()))
    assert sorted(map(tuple, whole.slot_candidates(q).collect())) == sorted(map(tuple, schemes.day_slot_candidates(points, q, 4).collect()))
    again = index.DayIndex(spark, whole.path, 4)  # opened where it lies
    assert again.rows().count() == 600


def test_sharing_and_days(spark):
    rows = spark.createDataFrame([(1, 0, 3, 3), (1, 1, 3, 3), (1, 2, 1, 1), (1, 3, 2, 2), (1, 4, 5, 5)], "day long, slot long, cx long, cy long")
    got = {r.pair: (r.away, r.shared) for r in index.sharing(rows, 442).collect()}
    assert got == {0: (0, True), 1: (2, True), 2: (1, False)}
    assert {r.shared for r in index.sharing(rows, 1).where("pair = 1").collect()} == {False}
    days = spark.createDataFrame([(10,), (12,)], "day long")
    asked = spark.createDataFrame([(9 * 86400,), (10 * 86400 + 5,), (11 * 86400,), (13 * 86400,)], "ts long")
    assert [r.day for r in index.first_days(days, asked).orderBy("ts").collect()] == [10, 10, 12, None]
    assert [r.day for r in index.first_days(days.limit(0), asked).collect()] == [None] * 4


def test_saved_stores_and_measures(spark, tmp_path):
    postings = spark.createDataFrame([("a", i) for i in range(30)] + [("b", 5)], "label string, record_id long")
    store = emm.EncryptedStore(postings).save(f"file://{tmp_path}/emm")
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id int, label string")
    assert store.query(asked).count() == 31
    told = store.benchmark(asked, 1)
    assert told["rows"] == 31 and told["entries"] == 31 and told["bytes"] == 31 * 48 and told["seconds"] > 0


def test_medians_against_sorting(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([rng.uniform(-5, 5), 1.5, 1.5])) for g in range(6) for _ in range(g * 37 + 1)] + [(9, None), (8, 2.0), (8, 1.0)]
    got = {r.g: r.m for r in metrics.upper_median(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", "m").collect()}
    want = {}
    for g in {r[0] for r in rows if r[1] is not None}:
        values = sorted(v for k, v in rows if k == g and v is not None)
        want[g] = values[len(values) // 2]
    assert got == want


def test_check_ins_are_numbered_in_file_order(spark, tmp_path):
    head = ",".join(P.CHECKIN)
    lines = [f"u{i},v,c,n,{i % 80},{i % 170},0,2024-01-01 00:00:{i % 60:02d}+00,x{i}" if i % 9 else f"u{i},v,c,n,bad,1,0,2024-01-01 00:00:00,x{i}" for i in range(3000)]
    (tmp_path / "c.csv").write_text("\n".join([head, *lines]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = P.read_checkins(spark, str(tmp_path / "c.csv")).orderBy("record_id").collect()
        few = P.read_checkins(spark, str(tmp_path / "c.csv"), 10).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    kept = [i for i in range(3000) if i % 9]
    assert [(r.record_id, r.id) for r in got] == [(k + 1, f"x{i}") for k, i in enumerate(kept)] and few == 10


def test_the_time_condition_reaches_the_scan(spark):
    plan = P.event_points(spark, "/root/testdata/sf0.001", 1704500000, 1705500000)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = next(x for x in plan.split("\n") if "PushedFilters" in x)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_bits_of_any_length(spark):
    v = spark.range(1).select(bits.from_number(F.lit(-2), 64).alias("a"), bits.zeros(3).alias("b"), bits.from_number(F.lit(5), 3).alias("c"))
    r = v.select(bits.to_number(F.col("a")).alias("n"), bits.find(F.col("b")).alias("f"), bits.text(bits.both(F.col("c"), bits.from_number(F.lit(13), 5))).alias("t"), bits.count(F.col("a")).alias("k"), bits.text(bits.shifted_down(F.col("c"), 9)).alias("z")).first()
    assert (r.n, r.f, r.t, r.k, r.z) == (-2, -1, "00101", 63, "000")


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_key_streams_are_spread(spark):
    n = [r["n"] for r in stores.uniform_keys(spark, 20000, 20, 4).groupBy("key").agg(F.count("*").alias("n")).collect()]
    assert len(n) == 20 and min(n) > 800 and max(n) < 1200
    assert id_part(spark.range(0), "id") is not None
