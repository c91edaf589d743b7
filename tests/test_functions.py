from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratagrid.functions import cells, clock, cover, crypto, grid


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "slot"), [("00:00:00", 0), ("00:09:59", 0), ("00:10:00", 1), ("08:00:00", 48), ("14:37:00", 87), ("23:59:59", 143)])
def test_slots_ignore_the_offset(spark, text, slot):
    ts = clock.text_seconds(F.lit(f"2012-04-03 {text}+05"))
    assert one(spark, clock.slot_in_day(ts)) == slot


def test_days_and_negative_times(spark):
    assert one(spark, clock.date_seconds(F.lit("1970-01-01"))) == 0
    days = lambda a, b: one(spark, clock.date_seconds(F.lit(b)) - clock.date_seconds(F.lit(a)))
    assert days("2020-02-29", "2020-03-01") == 86400 and days("2000-02-28", "2000-03-01") == 172800
    assert one(spark, clock.text_seconds(F.lit("2012-04-03 18:17:18+00"))) == 1333477038
    assert one(spark, clock.text_seconds(F.lit("no time"))) is None
    assert one(spark, clock.abs_slot(F.lit(-1))) == -1 and one(spark, clock.slot_in_day(F.lit(-1))) == 143
    assert one(spark, clock.interval_attribute(F.lit(86400 * 3 + 601), F.lit(86400))) == 2 * 144 + 1


def plain_ranges(h):
    """All canonical ranges by building the tree."""
    found = set()

    def node(lo, hi):
        found.add((lo, hi))
        if hi > lo:
            half = (lo + hi) // 2
            node(lo, half)
            node(half + 1, hi)
            if hi - lo >= 3:
                quarter = (hi - lo + 1) // 4
                found.add((lo + quarter, hi - quarter))

    node(0, (1 << h) - 1)
    return found


def test_paths_and_covers_against_the_tree(spark):
    for h in (2, 4, 5):
        every = plain_ranges(h)
        n = 1 << h
        paths = {r.v: {(x.lo, x.hi) for x in r.p} for r in spark.range(n).select(F.col("id").alias("v"), cover.dyadic_path(F.col("id"), h).alias("p")).collect()}
        assert paths == {v: {r for r in every if r[0] <= v <= r[1]} for v in range(n)}
        rows = spark.createDataFrame([(a, b) for a in range(n) for b in range(a, n)], "a long, b long").select("a", "b", cover.dyadic_cover(F.col("a"), F.col("b")).alias("c")).collect()
        for r in rows:
            best = min((y - x, x, y) for x, y in every if x <= r.a and r.b <= y)
            assert (r.c.lo, r.c.hi) in every and r.c.hi - r.c.lo == best[0] and r.c.lo <= r.a and r.b <= r.c.hi


def test_path_and_cover_literals(spark):
    path = lambda v: {(r.lo, r.hi) for r in one(spark, cover.dyadic_path(F.lit(v), 4))}
    assert path(7) == {(0, 15), (4, 11), (0, 7), (4, 7), (6, 7), (7, 7)} | {(2, 5)} & path(7) and len(path(0)) == len(path(15)) == 5
    assert path(16) == path(-1) == set()
    c = lambda a, b: tuple(one(spark, cover.dyadic_cover(F.lit(a), F.lit(b))))
    assert c(1, 14) == c(0, 15) == (0, 15) and c(3, 4) == (2, 5) and c(9, 9) == (9, 9)
    assert [one(spark, cover.ceil_log2(F.lit(n))) for n in (1, 2, 3, 1024, 1025)] == [0, 1, 2, 10, 11]


def plain_cubes(d):
    found, w = {(d, 0, 0, 0)}, d // 2
    while w >= 1:
        step = max(1, w // 2)
        found |= {(w, x, y, z) for x in range(0, d - w + 1, step) for y in range(0, d - w + 1, step) for z in range(0, d - w + 1, step)}
        w //= 2
    return found


def test_staggered_cubes_and_covers(spark):
    d = 8
    every = plain_cubes(d)
    pts = [(x, y, z) for x in range(0, 8, 3) for y in range(0, 8, 2) for z in (0, 5, 7)]
    got = spark.createDataFrame(pts, "x long, y long, z long").select("x", "y", "z", cover.staggered_cubes(F.col("x"), F.col("y"), F.col("z"), d).alias("c")).collect()
    for r in got:
        mine = [tuple(c) for c in r.c]
        assert len(mine) == len(set(mine)) and set(mine) == {c for c in every if all(c[1 + k] <= p < c[1 + k] + c[0] for k, p in enumerate((r.x, r.y, r.z)))}
    boxes = [(*p, *(min(8, a + k % 3 + 1) for k, a in enumerate(p))) for p in pts] + [(5, 9 % 8, 7, 6, 2, 8)]
    df = spark.createDataFrame(boxes, "a long, b long, c long, d long, e long, f long")
    for r in df.select("*", cover.staggered_cover((F.col("a"), F.col("b"), F.col("c")), (F.col("d"), F.col("e"), F.col("f")), d).alias("k")).collect():
        assert tuple(r.k) in every and all(s <= lo and hi <= s + r.k.w for s, lo, hi in zip(r.k[1:], r[:3], r[3:6], strict=True))
    unit = one(spark, cover.staggered_cover(tuple(map(F.lit, (5, 9, 13))), tuple(map(F.lit, (6, 10, 14))), 16))
    assert tuple(unit) == (1, 5, 9, 13)
    assert one(spark, cover.cube_label(F.struct(F.lit(1).alias("w"), F.lit(5).alias("x"), F.lit(9).alias("y"), F.lit(13).alias("z")))) == "(5,9,13)-(6,10,14)"
    r = F.struct(F.lit(0).alias("lo"), F.lit(7).alias("hi"))
    assert one(spark, cover.box_label(r, r, r)) == "0,7|0,7|0,7"


def test_grid_and_point_bytes(spark):
    cell = lambda v: one(spark, grid.grid_cell(F.lit(v), F.lit(0.0), F.lit(100.0), 4))
    assert [cell(v) for v in (-5.0, 0.0, 20.0, 99.9, 100.0, 300.0)] == [0, 0, 3, 14, 15, 15]
    assert one(spark, grid.grid_end(F.lit(100.0), F.lit(0.0), F.lit(100.0), 4)) == 15 and one(spark, grid.grid_end(F.lit(900.0), F.lit(0.0), F.lit(100.0), 4)) == 16
    assert one(spark, grid.grid_cell(F.lit(5.0), F.lit(5.0), F.lit(5.0), 4)) == 0
    for p in [(0, 1, 127), (-1, 2**31 - 1, -(2**31))]:
        raw = grid.point_bytes(*(F.lit(v) for v in p))
        assert bytes(one(spark, raw)) == b"".join(v.to_bytes(4, "big", signed=True) for v in p) and tuple(one(spark, grid.bytes_point(raw))) == p


def test_cells_codes_and_query_cells(spark):
    bounds = (40.5, 41.0, -74.2, -73.7)
    codes = [one(spark, cells.code_text(F.lit(c.level), F.lit(c.ix), F.lit(c.iy), bounds)) for c in one(spark, cells.point_cells(F.lit(40.65), F.lit(-74.2), bounds, 3))]
    assert codes == ["40.625000,-74.075000,1", "40.687500,-74.137500,2", "40.656250,-74.168750,3"]
    assert len(one(spark, cells.point_cells(F.lit(40.5), F.lit(-74.2), bounds, 3))) == 3
    point = {tuple(c) for c in one(spark, cells.point_cells(F.lit(40.71), F.lit(-73.99), bounds, 4))}
    assert point & set(cells.query_cells((40.7, 40.76, -74.0, -73.98), bounds, 4))
    assert cells.query_cells((0, 90, -180, 0), bounds, 4) == [(1, 0, 0), (1, 0, 1), (1, 1, 0), (1, 1, 1)] and cells.query_cells((1, 2, 3, 4), bounds, 4) == []
    assert len(one(spark, cells.point_cells(F.lit(40.65), F.lit(-74.2), bounds, 3, leaf_only=True))) == 1
    for low, high, levels in (([1.0], [], 3), ([], [], 3), ([2.0], [1.0], 3), ([0.0], [1.0], 0)):
        with pytest.raises(ValueError):
            cells.check_domain(low, high, levels)


def test_hashes_and_encryption(spark):
    import hashlib

    assert bytes(one(spark, crypto.sha256(F.lit("abc")))) == hashlib.sha256(b"abc").digest() and bytes(one(spark, crypto.sha128(F.lit("a"), F.lit("bc")))) == hashlib.sha256(b"abc").digest()[:16]
    for t in ("abc", "x", "12"):
        assert one(spark, crypto.key64(F.lit(t))) == int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little", signed=True)
    assert bytes(one(spark, crypto.long_bytes(F.lit(-2)))) == (-2).to_bytes(8, "big", signed=True)
    key = crypto.sha256(F.lit("key"))
    made = crypto.encrypt(F.lit(123456), key)
    assert len(one(spark, made)) == 16 and one(spark, crypto.decrypt(made, key)) == "123456" and one(spark, crypto.decrypt(made, crypto.sha256(F.lit("other")))) != "123456"
