"""Query workloads: dense cells, centres inside a bucket and across two, and windows scaled about them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.functions.clock import DAY_SECONDS, floor_div
from stratagrid.operators import buckets as B
from stratagrid.operators import truth
from stratagrid.operators.ranks import value_at_rank

#: Fixed values of the workload.
METERS_PER_DEGREE = 111_320.0
CELL_METERS = 1000.0
WINDOW_METERS = 1000.0
INSIDE_SECONDS = 3600
ACROSS_SECONDS = 7200
SCALES = (1, 2, 4, 8, 16)
CENTRES = 10
NEARBY = 100


def meters_per_degree_lon(lat: Column) -> Column:
    return F.greatest(F.lit(1.0), F.lit(METERS_PER_DEGREE) * F.cos(F.radians(lat)))


def density(points: DataFrame) -> DataFrame:
    """``points`` with the cell (cell_x, cell_y) of a kilometre that each lies in and the cell's records (cell_count)."""
    low = points.agg(F.min("lat").alias("a"), F.min("lon").alias("c")).first()
    if low.a is None:
        return points.select("*", F.lit(0).alias("cell_x"), F.lit(0).alias("cell_y"), F.lit(0).alias("cell_count"))
    scale = max(1.0, METERS_PER_DEGREE * math.cos(math.radians(value_at_rank(points, "lat", points.count() // 2))))
    x = F.floor((F.col("lon") - low.c) * scale / CELL_METERS).cast("bigint")
    y = F.floor((F.col("lat") - low.a) * METERS_PER_DEGREE / CELL_METERS).cast("bigint")
    placed = points.withColumn("cell_x", x).withColumn("cell_y", y)
    counts = placed.groupBy("cell_x", "cell_y").agg(F.count("*").alias("cell_count"))
    return placed.join(counts, ["cell_x", "cell_y"])


def _filled(ranked: DataFrame, own: list[str], score: list[Column], limit: int) -> DataFrame:
    """The ``limit`` best rows: of each group ``own`` its best, then, if these are too few, the best of all again."""
    first = ranked.withColumn("_one", F.row_number().over(Window.partitionBy(*own).orderBy(*score))).where("_one = 1").drop("_one")
    best = first.orderBy(*score).limit(limit).withColumn("_again", F.lit(0))
    fill = ranked.orderBy(*score).limit(limit).withColumn("_again", F.lit(1))
    return best.union(fill).orderBy("_again", *score).limit(limit).drop("_again")


def inside_centres(points: DataFrame, sizes: B.Sizes = B.Sizes(), limit: int = CENTRES) -> DataFrame:
    """The points about which the widest window still lies in one bucket: densest cells first, then the widest windows,
    then the fullest buckets, then the earliest; one for each cell and bucket first."""
    placed = density(B.with_buckets(points, sizes))
    met = placed.join(B.bucket_table(placed).select("bucket_id", "start_ts", "end_ts", F.col("n").alias("bucket_n")), "bucket_id")
    widest = (F.least(F.col("ts") - F.col("start_ts"), F.col("end_ts") - F.col("ts")) * 2).cast("double")
    base = F.least(F.lit(float(INSIDE_SECONDS)), widest / max(SCALES) * 0.98)
    ranked = met.withColumn("widest", widest).withColumn("base_seconds", base).where("end_ts > start_ts and widest > 0 and base_seconds >= 60")
    score = [F.desc("cell_count"), F.desc("widest"), F.desc("bucket_n"), F.asc("ts"), F.asc("record_id")]
    return _filled(ranked, ["cell_x", "cell_y", "bucket_id"], score, limit).select("record_id", "ts", "lat", "lon", "bucket_id", "cell_count", "widest", "base_seconds", "bucket_n")


def edge_records(points: DataFrame, sizes: B.Sizes = B.Sizes(), near: int = NEARBY) -> DataFrame:
    """The last ``near`` records of each bucket and the first of the next, under the number of the former."""
    bucketed = B.with_buckets(points, sizes)
    part = Window.partitionBy("bucket_id")
    late = bucketed.withColumn("r", F.row_number().over(part.orderBy(F.desc("ts"), F.desc("record_id")))).where(F.col("r") <= near)
    early = bucketed.withColumn("r", F.row_number().over(part.orderBy("ts", "record_id"))).where((F.col("r") <= near) & (F.col("bucket_id") > 0))
    side = lambda df, name, shift: df.select((F.col("bucket_id") - shift).alias("pair"), F.lit(name).alias("side"), *points.columns)
    pairs = B.bucket_table(bucketed).where("next_bucket is not null").select(F.col("bucket_id").alias("pair"))
    return side(late, "left", 0).union(side(early, "right", 1)).join(pairs, "pair", "left_semi")


def across_centres(points: DataFrame, sizes: B.Sizes = B.Sizes(), limit: int = CENTRES) -> DataFrame:
    """For each two neighbouring buckets the record near their border in the densest cell (then the nearest); the
    ``limit`` best pairs."""
    table = B.bucket_table(B.with_buckets(points, sizes))
    after = table.select((F.col("bucket_id") - 1).alias("bucket_id"), F.col("start_ts").alias("next_start"), F.col("n").alias("next_n"))
    pairs = table.join(after, "bucket_id").select(F.col("bucket_id").alias("pair"), "end_ts", "next_start", (F.col("n") + F.col("next_n")).alias("pair_n"))
    pairs = pairs.withColumn("border", (F.col("end_ts") + F.col("next_start")) / F.lit(2.0)).withColumn("gap", F.greatest(F.lit(0), F.col("next_start") - F.col("end_ts")))
    cells = density(points).select("record_id", "cell_x", "cell_y", "cell_count")
    near = edge_records(points, sizes).join(pairs, "pair")
    # Records near borders are few: NEARBY on each side of a bucket.
    near = cells.join(near, "record_id").withColumn("away", F.abs(F.col("ts") - F.col("border")))
    best = near.withColumn("_k", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("cell_count"), F.asc("away"), F.asc("ts"), F.asc("record_id")))).where("_k = 1")
    base = F.greatest(F.lit(float(ACROSS_SECONDS)), F.col("gap") + F.lit(2.0 * B.Sizes().slot_seconds), F.col("away") * 2 + F.lit(2.0 * B.Sizes().slot_seconds))
    score = [F.desc("cell_count"), F.asc("away"), F.desc("pair_n"), F.asc("pair")]
    return best.withColumn("base_seconds", base).orderBy(*score).limit(limit).select("record_id", "ts", "lat", "lon", F.col("pair").alias("bucket_id"), "cell_count", "away", "base_seconds", "pair_n")


def windows(points: DataFrame, centres: DataFrame, kind: str, scales: tuple[int, ...] = SCALES) -> DataFrame:
    """A window for each centre and scale: time, latitude and longitude grow together, held inside the bounds; with
    flags for what was clamped and the days spanned."""
    b = points.agg(*(f(c).cast("double").alias(f"{c}_{n}") for c in ("ts", "lat", "lon") for n, f in (("a", F.min), ("b", F.max))))
    each = centres.withColumn("alpha", F.explode(F.array(*map(F.lit, scales)))).join(F.broadcast(b))
    half_t = F.col("base_seconds") * F.col("alpha") / 2.0
    half_lat = F.col("alpha") * F.lit(WINDOW_METERS) / 2.0 / METERS_PER_DEGREE
    half_lon = F.col("alpha") * F.lit(WINDOW_METERS) / 2.0 / meters_per_degree_lon(F.col("lat"))
    out = each
    for c, half in (("ts", half_t), ("lat", half_lat), ("lon", half_lon)):
        for side, sign in (("lo", -1), ("hi", 1)):
            planned = F.col(c) + sign * half
            out = out.withColumn(f"{c}_{side}", F.greatest(F.col(f"{c}_a"), F.least(F.col(f"{c}_b"), planned))).withColumn(f"{c}_{side}_cut", (planned < F.col(f"{c}_a")) | (planned > F.col(f"{c}_b")))
        out = out.withColumn(f"{c}_clamped", (F.col(f"{c}_lo_cut") | F.col(f"{c}_hi_cut")).cast("int"))
    days = floor_div(F.col("ts_hi"), DAY_SECONDS) - floor_div(F.col("ts_lo"), DAY_SECONDS) + 1
    return out.select(
        F.lit(kind).alias("kind"), "record_id", "alpha", F.round("ts_lo", 3).alias("start"), F.round("ts_hi", 3).alias("end"),
        *(F.round(f"{c}_{s}", 6).alias(f"{c}_{n}") for c in ("lat", "lon") for s, n in (("lo", "min"), ("hi", "max"))),
        "ts_clamped", "lat_clamped", "lon_clamped", days.alias("days"),
    )


def second_text(x: Column) -> Column:
    """'YYYY-MM-DD HH:MM:SS+00' of epoch seconds, cut to whole ones; no session time zone takes part."""
    made = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(x).cast("decimal(18,6)"))
    return F.concat(F.substring(made.cast("string"), 1, 19), F.lit("+00"))


#: How each kind of centre was chosen, as plans say it.
POLICY = {
    "intra_tree": "adaptive bucket interior; alpha=16 time window kept within one tree when possible; 1km baseline spatial window",
    "cross_tree": "adaptive bucket boundary; alpha=1 crosses at least two trees; 1km baseline spatial window",
}


def full_plan(points: DataFrame, dataset: str, sizes: B.Sizes = B.Sizes(), scales: tuple[int, ...] = SCALES) -> DataFrame:
    """Every column of a query plan: for each centre (``repeat`` counts them within a kind) and scale the planned and the
    held window, what was held, its records and share of all, and the buckets and days that it meets."""
    numbered = lambda df, order: df.withColumn("repeat", F.row_number().over(Window.orderBy(*order)))  # noqa: E731  CENTRES rows
    inside = numbered(inside_centres(points, sizes), [F.desc("cell_count"), F.desc("widest"), F.desc("bucket_n"), F.asc("ts"), F.asc("record_id")])
    across = numbered(across_centres(points, sizes), [F.desc("cell_count"), F.asc("away"), F.desc("pair_n"), F.asc("bucket_id")])
    side = lambda df, kind, reach: df.select(F.lit(kind).alias("baseline_type"), "repeat", "ts", "lat", "lon", "cell_count", F.col("base_seconds").alias("base"), reach.alias("reach"))
    centres = side(inside, "intra_tree", F.floor(F.col("widest") / F.col("base_seconds")).cast("bigint")).union(side(across, "cross_tree", F.lit(None).cast("bigint")))
    b = points.agg(*(f(c).cast("double").alias(f"{c}_{n}") for c in ("ts", "lat", "lon") for n, f in (("a", F.min), ("b", F.max))), F.count("*").alias("n_points"))
    w = centres.withColumn("alpha", F.explode(F.array(*map(F.lit, scales)))).join(F.broadcast(b))
    half = {
        "ts": F.col("base") * F.col("alpha") / 2.0,
        "lat": F.col("alpha") * F.lit(WINDOW_METERS) / 2.0 / METERS_PER_DEGREE,
        "lon": F.col("alpha") * F.lit(WINDOW_METERS) / 2.0 / meters_per_degree_lon(F.col("lat")),
    }
    for c, h in half.items():
        for name, planned in (("lo", F.col(c) - h), ("hi", F.col(c) + h)):
            w = w.withColumn(f"{c}_{name}_0", planned).withColumn(f"{c}_{name}", F.greatest(F.col(f"{c}_a"), F.least(F.col(f"{c}_b"), planned)))
        w = w.withColumn(f"{c}_held", ((F.col(f"{c}_lo") != F.col(f"{c}_lo_0")) | (F.col(f"{c}_hi") != F.col(f"{c}_hi_0"))).cast("int"))
    w = w.withColumn("query_id", F.concat_ws("/", "baseline_type", "repeat", "alpha"))
    boxes = w.select("query_id", F.col("ts_lo").alias("s"), F.col("ts_hi").alias("e"), F.col("lat_lo").alias("lat_min"), F.col("lat_hi").alias("lat_max"), F.col("lon_lo").alias("lon_min"), F.col("lon_hi").alias("lon_max"))
    found = truth.batch_truth(points, boxes).groupBy("query_id").agg(F.count("*").alias("true_result_size"))
    table = B.bucket_table(B.with_buckets(points, sizes))
    met = B.touched(table, boxes).groupBy("query_id").agg(F.count("*").alias("tree_count_touched"), F.array_join(F.transform(F.array_sort(F.collect_list("bucket_id")), lambda x: x.cast("string")), ";").alias("bucket_ids"))
    w = w.join(found, "query_id", "left").join(met, "query_id", "left").na.fill({"true_result_size": 0, "tree_count_touched": 0, "bucket_ids": ""})
    span = F.greatest(F.lit(0.0), F.col("ts_hi") - F.col("ts_lo"))
    days = floor_div(F.col("ts_hi"), DAY_SECONDS) - floor_div(F.col("ts_lo"), DAY_SECONDS) + 1
    lat_window, lon_window = F.round(F.col("lat_hi") - F.col("lat_lo"), 8), F.round(F.col("lon_hi") - F.col("lon_lo"), 8)
    trees = F.col("tree_count_touched")
    return w.select(
        F.lit(dataset).alias("dataset"), "baseline_type", "alpha", "repeat",
        second_text(F.col("ts_lo_0")).alias("planned_query_start"), second_text(F.col("ts_hi_0")).alias("planned_query_end"),
        second_text(F.col("ts_lo")).alias("actual_query_start"), second_text(F.col("ts_hi")).alias("actual_query_end"),
        *(F.round(f"{c}_{s}", 8).alias(f"query_{c}_{n}") for c in ("lat", "lon") for s, n in (("lo", "min"), ("hi", "max"))),
        F.round("base", 6).alias("baseline_temporal_window_seconds"), F.lit(round(WINDOW_METERS / METERS_PER_DEGREE, 10)).alias("baseline_lat_window"), F.round(F.lit(WINDOW_METERS) / meters_per_degree_lon(F.col("lat")), 8).alias("baseline_lon_window"),
        F.round(F.col("base") * F.col("alpha"), 6).alias("scaled_temporal_window_seconds"), lat_window.alias("scaled_lat_window"), lon_window.alias("scaled_lon_window"),
        F.round(span / 3600.0, 6).alias("temporal_window_hours"), lat_window.alias("lat_window_size"), lon_window.alias("lon_window_size"),
        F.col("ts_held").alias("time_clamped"), F.col("lat_held").alias("lat_clamped"), F.col("lon_held").alias("lon_clamped"), F.greatest("ts_held", "lat_held", "lon_held").alias("was_clamped"),
        second_text(F.col("ts_lo_0")).alias("unclamped_query_start"), second_text(F.col("ts_hi_0")).alias("unclamped_query_end"),
        *(F.round(f"{c}_{s}_0", 8).alias(f"unclamped_query_{c}_{n}") for c in ("lat", "lon") for s, n in (("lo", "min"), ("hi", "max"))),
        F.when(F.col("base") != 0, F.round(span / F.col("base"), 6)).otherwise(F.lit(0.0)).alias("actual_temporal_scaling_factor"),
        "true_result_size", F.round(F.col("true_result_size") / F.col("n_points"), 10).alias("selectivity"),
        F.round("lat", 8).alias("query_center_lat"), F.round("lon", 8).alias("query_center_lon"), second_text(F.col("ts").cast("double")).alias("query_center_ts"), F.col("cell_count").alias("center_cell_count"),
        "tree_count_touched", "bucket_ids", days.alias("day_count_spanned"),
        (trees == 1).cast("int").alias("is_intra_tree"), (trees > 1).cast("int").alias("is_cross_tree"), (days == 1).cast("int").alias("is_intra_day"), (days > 1).cast("int").alias("is_cross_day"),
        F.lit(max(scales)).alias("requested_max_alpha"), F.col("reach").alias("actual_max_intra_tree_alpha"),
        ((F.col("baseline_type") == "intra_tree") & (F.col("alpha") == max(scales)) & (trees > 1)).cast("int").alias("intra_tree_alpha16_crossed"),
        F.when(F.col("baseline_type") == "intra_tree", POLICY["intra_tree"]).otherwise(POLICY["cross_tree"]).alias("selection_policy"),
    )


def plan_table(points: DataFrame, dataset: str, sizes: B.Sizes = B.Sizes()) -> DataFrame:
    """The whole plan: windows of both kinds of centres, under a data set's name."""
    one = windows(points, inside_centres(points, sizes), "inside").union(windows(points, across_centres(points, sizes), "across"))
    return one.select(F.lit(dataset).alias("dataset"), "*")
