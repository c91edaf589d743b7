"""Candidate generation: each scheme's exact candidates, (query_id, record_id), a superset of the box's records.

Pruning is exact (set membership, no filters that err), so candidates are the same in every run. What grows is scanned, grouped by (bucket or day, slot), and joined by equality. Query tables carry no hint: Spark broadcasts them while they are small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.functions import cells, cover, grid
from stratagrid.functions.clock import DAY_SECONDS, SLOTS_PER_DAY, abs_slot, floor_div, slot_in_day
from stratagrid.operators import buckets as B
from stratagrid.operators import truth
from stratagrid.operators.ranks import id_part, rank_within
from stratagrid.sources.shared import written

#: Levels of the spatial cells that slots, and covers of slots, are pruned by.
SLOT_LEVEL, COVER_LEVEL, GRID_BITS, DAY_HEIGHT = 8, 3, 7, 8


def _cells(df: DataFrame, points: DataFrame, level: int) -> DataFrame:
    b = truth.bounds(points).select(F.col("lat_min").alias("b_a"), F.col("lat_max").alias("b_b"), F.col("lon_min").alias("b_c"), F.col("lon_max").alias("b_d"))
    got = df.join(F.broadcast(b))
    return got.withColumn("cx", cells.cell(F.col("lat"), F.col("b_a"), F.col("b_b"), level)).withColumn("cy", cells.cell(F.col("lon"), F.col("b_c"), F.col("b_d"), level)).drop("b_a", "b_b", "b_c", "b_d")


def _query_cells(queries: DataFrame, points: DataFrame, level: int) -> DataFrame:
    """Queries with the cells x0..x1, y0..y1 of their boxes; boxes outside the bounds are left out."""
    b = truth.bounds(points).select(F.col("lat_min").alias("b_a"), F.col("lat_max").alias("b_b"), F.col("lon_min").alias("b_c"), F.col("lon_max").alias("b_d"))
    q = queries.join(F.broadcast(b)).where("lat_max >= b_a and lat_min <= b_b and lon_max >= b_c and lon_min <= b_d")
    for name, c, lo, hi in (("x0", "lat_min", "b_a", "b_b"), ("x1", "lat_max", "b_a", "b_b"), ("y0", "lon_min", "b_c", "b_d"), ("y1", "lon_max", "b_c", "b_d")):
        q = q.withColumn(name, cells.cell(F.col(c), F.col(lo), F.col(hi), level))
    return q.select("query_id", "s", "e", "x0", "x1", "y0", "y1")


def _hits(slots: DataFrame, ranges: DataFrame, key: str) -> DataFrame:
    """(query_id, key, slot) of slots in a query's range with a record in the query's cells."""
    met = slots.join(ranges, key).where("slot between lo and hi and cx between x0 and x1 and cy between y0 and y1")
    return met.select("query_id", key, "slot").distinct()


def bucketed_cells(points: DataFrame, sizes: B.Sizes, level: int) -> DataFrame:
    """The index of the bucket schemes: records with their bucket, slot and cell, made once in the shared folder, as
    buckets, slots and hits are all read from it."""
    return written(B.with_buckets(_cells(points, points, level).select("record_id", "ts", "cx", "cy"), sizes))


def slot_candidates(points: DataFrame, queries: DataFrame, sizes: B.Sizes = B.Sizes(), level: int = SLOT_LEVEL) -> DataFrame:
    """All records of each slot of a bucket that the query's time meets and that has a record in the query's cells."""
    bucketed = bucketed_cells(points, sizes, level)
    q = _query_cells(queries, points, level)
    spans = B.touched(B.bucket_table(bucketed), queries).select("query_id", "bucket_id", abs_slot(F.greatest("s", "start_ts"), sizes.normal().slot_seconds).alias("lo"), abs_slot(F.least("e", "end_ts"), sizes.normal().slot_seconds).alias("hi")).join(q.drop("s", "e"), "query_id")
    slots = bucketed.select("bucket_id", F.col("abs_slot").alias("slot"), "cx", "cy").distinct()
    hit = _hits(slots, spans, "bucket_id")
    return bucketed.select("record_id", "bucket_id", F.col("abs_slot").alias("slot")).join(hit, ["bucket_id", "slot"]).select("query_id", "record_id")


def slot_cover_candidates(points: DataFrame, queries: DataFrame, sizes: B.Sizes = B.Sizes(), level: int = COVER_LEVEL) -> DataFrame:
    """Per touched bucket whose slots in the query's range hit: all records in the single dyadic cover of that range."""
    bucketed = bucketed_cells(points, sizes, level)
    slots = B.bucket_slots(bucketed)
    local = bucketed.join(slots.select("bucket_id", "abs_slot", F.col("local_slot").cast("bigint").alias("slot")), ["bucket_id", "abs_slot"])
    ranges = B.local_ranges(bucketed, queries, sizes.normal().slot_seconds).where("lo >= 0").join(_query_cells(queries, points, level).drop("s", "e"), "query_id")
    hit = _hits(local.select("bucket_id", "slot", "cx", "cy").distinct(), ranges, "bucket_id").select("query_id", "bucket_id").distinct()
    covers = ranges.join(hit, ["query_id", "bucket_id"], "left_semi").select("query_id", "bucket_id", cover.dyadic_cover(F.col("lo"), F.col("hi")).alias("c"))
    return local.join(covers, "bucket_id").where("slot between c.lo and c.hi").select("query_id", "record_id")


def _days(queries: DataFrame) -> DataFrame:
    """(query_id, day, lo, hi): the slots of each day that a query's time meets; both ends are clamped."""
    day = F.explode(F.sequence(floor_div(F.col("s"), DAY_SECONDS), floor_div(F.col("e"), DAY_SECONDS))).alias("day")
    q = queries.select("query_id", "s", "e", day)
    return q.select("query_id", "day", F.when(floor_div(F.col("s"), DAY_SECONDS) == F.col("day"), slot_in_day(F.col("s"))).otherwise(F.lit(0)).alias("lo"), F.when(floor_div(F.col("e"), DAY_SECONDS) == F.col("day"), slot_in_day(F.col("e"))).otherwise(F.lit(SLOTS_PER_DAY - 1)).alias("hi"))


def _day_points(points: DataFrame, level: int) -> DataFrame:
    return _cells(points, points, level).select("record_id", floor_div(F.col("ts"), DAY_SECONDS).alias("day"), slot_in_day(F.col("ts")).alias("slot"), "cx", "cy")


def day_slot_candidates(points: DataFrame, queries: DataFrame, level: int = SLOT_LEVEL) -> DataFrame:
    """As slot_candidates, with days for buckets."""
    p = _day_points(points, level)
    ranges = _days(queries).join(_query_cells(queries, points, level).drop("s", "e"), "query_id")
    hit = _hits(p.select("day", "slot", "cx", "cy").distinct(), ranges, "day")
    return p.select("record_id", "day", "slot").join(hit, ["day", "slot"]).select("query_id", "record_id")


def day_cover_candidates(points: DataFrame, queries: DataFrame, level: int = COVER_LEVEL) -> DataFrame:
    """As slot_cover_candidates, with days for buckets."""
    p = _day_points(points, level)
    ranges = _days(queries).join(_query_cells(queries, points, level).drop("s", "e"), "query_id")
    hit = _hits(p.select("day", "slot", "cx", "cy").distinct(), ranges, "day").select("query_id", "day").distinct()
    covers = ranges.join(hit, ["query_id", "day"], "left_semi").select("query_id", "day", cover.dyadic_cover(F.col("lo"), F.col("hi")).alias("c"))
    return p.join(covers, "day").where("slot between c.lo and c.hi").select("query_id", "record_id")


def grid_points(points: DataFrame, bits: int = GRID_BITS) -> DataFrame:
    """(record_id, x, y, z): time, latitude and longitude on the grid."""
    t = truth.bounds(points).select(F.col("ts_min").alias("t0"), F.col("ts_max").alias("t1"))
    got = points.join(F.broadcast(t))
    return got.select("record_id", grid.grid_cell(F.col("ts"), F.col("t0"), F.col("t1"), bits).alias("x"), grid.grid_cell(F.col("lat"), F.lit(grid.LAT[0]), F.lit(grid.LAT[1]), bits).alias("y"), grid.grid_cell(F.col("lon"), F.lit(grid.LON[0]), F.lit(grid.LON[1]), bits).alias("z"))


def grid_boxes(points: DataFrame, queries: DataFrame, bits: int = GRID_BITS) -> DataFrame:
    """(query_id, x0, x1, x2, y0, ...): the cells of a box's start, of its end (which its upper bound lies in), and its
    end rounded up. Boxes before or after all points are left out."""
    t = truth.bounds(points).select(F.col("ts_min").alias("t0"), F.col("ts_max").alias("t1"))
    q = queries.join(F.broadcast(t)).where("e >= t0 and s <= t1")
    out = [F.col("query_id")]
    for axis, lo, hi, a, b in (("x", "s", "e", F.col("t0"), F.col("t1")), ("y", "lat_min", "lat_max", *map(F.lit, grid.LAT)), ("z", "lon_min", "lon_max", *map(F.lit, grid.LON))):
        out += [grid.grid_cell(F.col(lo), a, b, bits).alias(f"{axis}0"), grid.grid_cell(F.col(hi), a, b, bits).alias(f"{axis}1"), grid.grid_end(F.col(hi), a, b, bits).alias(f"{axis}2")]
    return q.select(*out)


def dyadic_grid_candidates(points: DataFrame, queries: DataFrame, bits: int = GRID_BITS) -> DataFrame:
    """All records in the product of the three axes' dyadic covers. No label is made: a query has a row for each time cell
    of its cover (2^bits at most), the join is by time cell, and the other covers are range conditions."""
    q = grid_boxes(points, queries, bits)
    q = q.select("query_id", *(cover.dyadic_cover(F.col(f"{c}0"), F.col(f"{c}1")).alias(f"c{c}") for c in "xyz"))
    q = q.withColumn("x", F.explode(F.sequence("cx.lo", "cx.hi")))
    return grid_points(points, bits).join(q, "x").where("y between cy.lo and cy.hi and z between cz.lo and cz.hi").select("query_id", "record_id")


def staggered_covers(points: DataFrame, queries: DataFrame, bits: int = GRID_BITS, aligned: bool = False) -> DataFrame:
    """(query_id, w, x, y, z): the staggered cube of each box; the end is the upper bound's cell and one more. ``aligned``:
    only cubes at multiples of their width."""
    q = grid_boxes(points, queries, bits)
    cube = cover.staggered_cover(tuple(F.col(f"{c}0") for c in "xyz"), tuple(F.col(f"{c}1") + 1 for c in "xyz"), 1 << bits, aligned)
    return q.select("query_id", cube.alias("c")).select("query_id", "c.*")


def staggered_grid_candidates(points: DataFrame, queries: DataFrame, bits: int = GRID_BITS) -> DataFrame:
    """All records in each box's staggered cube."""
    c = staggered_covers(points, queries, bits).select("query_id", "w", *(F.col(n).alias(f"c{n}") for n in "xyz"))
    c = c.withColumn("x", F.explode(F.sequence("cx", F.col("cx") + F.col("w") - 1)))
    return grid_points(points, bits).join(c, "x").where("y >= cy and y < cy + w and z >= cz and z < cz + w").select("query_id", "record_id")


def dyadic_label_counts(points: DataFrame, bits: int = GRID_BITS) -> DataFrame:
    """(x, y, z, n, labels): occupied cells, their records, and how many labels of three ranges each has: the product of
    the path lengths, so that nothing is exploded."""
    p = grid_points(points, bits).groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    size = lambda c: cover.dyadic_path_length(F.col(c), bits)
    return p.withColumn("labels", size("x") * size("y") * size("z"))


def dyadic_postings(points: DataFrame, queries: DataFrame, bits: int = GRID_BITS) -> DataFrame:
    """(query_id, label, record_id): the posting lists under the queries' labels. A record is under a label if each of
    its three paths holds the label's range."""
    q = grid_boxes(points, queries, bits).select("query_id", *(cover.dyadic_cover(F.col(f"{c}0"), F.col(f"{c}1")).alias(f"c{c}") for c in "xyz"))
    p = grid_points(points, bits)
    cells_ = p.select("x", "y", "z").distinct()
    cells_ = cells_.select("x", "y", "z", *(cover.dyadic_path(F.col(c), bits).alias(f"p{c}") for c in "xyz"))
    q = q.withColumn("x", F.explode(F.sequence("cx.lo", "cx.hi")))
    met = cells_.join(q, "x").where("array_contains(px, cx) and array_contains(py, cy) and array_contains(pz, cz)")
    under = met.select("query_id", cover.box_label(F.col("cx"), F.col("cy"), F.col("cz")).alias("label"), "x", "y", "z")
    return p.join(under, ["x", "y", "z"]).select("query_id", "label", "record_id")


def staggered_postings(points: DataFrame, bits: int = GRID_BITS) -> DataFrame:
    """(w, x, y, z, n): every staggered cube with records, and how many. Cells are counted before they are exploded."""
    p = grid_points(points, bits).groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    c = p.select("n", F.explode(cover.staggered_cubes(F.col("x"), F.col("y"), F.col("z"), 1 << bits)).alias("c"))
    return c.groupBy("c.w", "c.x", "c.y", "c.z").agg(F.sum("n").alias("n"))


def cube_labels(points: DataFrame, bits: int = GRID_BITS) -> DataFrame:
    """(x, y, z, n, labels): occupied cells, their records, and how many staggered cubes hold each."""
    p = grid_points(points, bits).groupBy("x", "y", "z").agg(F.count("*").alias("n"))
    return p.withColumn("labels", F.size(cover.staggered_cubes(F.col("x"), F.col("y"), F.col("z"), 1 << bits)).cast("bigint"))


def label_stats(cells_: DataFrame) -> DataFrame:
    """Cells, labels, and the mean and largest number of labels of a cell."""
    return cells_.agg(F.count("*").alias("cells"), F.sum("labels").alias("labels"), F.round(F.avg("labels"), 6).alias("mean"), F.max("labels").alias("most"))


def posting_stats(cubes: DataFrame) -> DataFrame:
    """Of each cube width: cubes, postings, the longest and the mean posting list."""
    return cubes.groupBy("w").agg(F.count("*").alias("cubes"), F.sum("n").alias("postings"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"))


def position_index(points: DataFrame, attribute) -> DataFrame:
    """(attr, first, last): the positions, in the order of (attribute, record_id), of each distinct attribute. Counts of
    attributes and their running sum; records are not sorted."""
    counts = points.groupBy(attribute.alias("attr")).agg(F.count("*").alias("n"))
    before = Window.orderBy("attr").rowsBetween(Window.unboundedPreceding, -1)
    # As long as the attribute's domain (grid cells, or slots of the time span).
    return counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("attr", "first", (F.col("first") + F.col("n") - 1).alias("last"))


def merged_position_ranges(index: DataFrame, spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(query_id, lo, hi): the position ranges of attributes in a query's span [a, b], first looked up through the cover
    of the span (a row for each attribute in it), filtered, and merged where they touch."""
    by = by or []
    wide = spans.withColumn("c", cover.dyadic_cover(F.col("a"), F.col("b")))
    wide = wide.withColumn("attr", F.explode(F.sequence("c.lo", "c.hi")))
    found = index.join(wide, [*by, "attr"])
    kept = found.where("attr between a and b").select("query_id", *by, "first", "last").distinct()
    group = ["query_id", *by]
    reach = F.max("last").over(Window.partitionBy(*group).orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    begins = kept.withColumn("new", F.when(reach.isNull() | (F.col("first") > reach + 1), 1).otherwise(0))
    island = begins.withColumn("island", F.sum("new").over(Window.partitionBy(*group).orderBy("first")))
    return island.groupBy(*group, "island").agg(F.min("first").alias("lo"), F.max("last").alias("hi")).drop("island")


def two_level_spans(points: DataFrame, queries: DataFrame, bits: int = GRID_BITS) -> DataFrame:
    return grid_boxes(points, queries, bits).select("query_id", F.col("x0").alias("a"), F.col("x1").alias("b"))


def two_level_candidates(points: DataFrame, queries: DataFrame, bits: int = GRID_BITS) -> DataFrame:
    """Two rounds on time alone: attributes to position ranges, and the ranges' covers to records."""
    g = grid_points(points, bits)
    index = position_index(g, F.col("x"))
    ranges = merged_position_ranges(index, two_level_spans(points, queries, bits))
    covers = ranges.select("query_id", cover.dyadic_cover(F.col("lo"), F.col("hi")).alias("c"))
    # A position is a cell's first and a rank in the cell; only cells that a cover cuts need ranks. The index has a row
    # for each of the 2^bits cells at most.
    spans = covers.join(F.broadcast(index), F.expr("first <= c.hi and last >= c.lo")).select("query_id", F.col("attr").alias("x"), F.greatest(F.col("c.lo") - F.col("first"), F.lit(0)).alias("r0"), (F.least("c.hi", "last") - F.col("first")).alias("r1"), (F.col("last") - F.col("first")).alias("top"))
    whole = g.join(spans.where("r0 = 0 and r1 = top"), "x").select("query_id", "record_id")
    part = spans.where("r0 > 0 or r1 < top")
    ranked = rank_within(g.join(part.select("x").distinct(), "x", "left_semi"), ["x"], ["record_id"], id_part(points))
    return whole.union(ranked.join(part, "x").where("rank between r0 and r1").select("query_id", "record_id")).distinct()


def two_level_day_candidates(points: DataFrame, queries: DataFrame) -> DataFrame:
    """The same per day over its 144 slots: the records of the slots that a query's time meets on each day, and what
    their positions' covers add."""
    p = points.select("record_id", floor_div(F.col("ts"), DAY_SECONDS).alias("day"), slot_in_day(F.col("ts")).alias("slot"))
    counts = p.groupBy("day", F.col("slot").alias("attr")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("day").orderBy("attr").rowsBetween(Window.unboundedPreceding, -1)
    index = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("day", "attr", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    spans = _days(queries).select("query_id", "day", F.col("lo").alias("a"), F.col("hi").alias("b"))
    covers = merged_position_ranges(index, spans, ["day"]).select("query_id", "day", cover.dyadic_cover(F.col("lo"), F.col("hi")).alias("c"))
    asked = p.join(covers.select("day").distinct(), "day", "left_semi")  # only days that a query meets are numbered
    numbered = rank_within(asked, ["day"], ["slot", "record_id"], F.col("slot") * B.PARTS + id_part(points, parts=B.PARTS), "pos")
    wanted = numbered.join(covers, "day").where("pos between c.lo and c.hi")
    return wanted.select("query_id", "record_id").distinct()


SCHEMES = {
    "slot": slot_candidates,
    "slot_cover": slot_cover_candidates,
    "day_slot": day_slot_candidates,
    "day_cover": day_cover_candidates,
    "dyadic_grid": dyadic_grid_candidates,
    "staggered_grid": staggered_grid_candidates,
    "two_level": two_level_candidates,
    "two_level_day": two_level_day_candidates,
}
