"""Exact range filters, bounds and default windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.functions.clock import DAY_SECONDS, floor_div
from stratagrid.operators.ranks import value_at_rank


def inside(box: tuple) -> Column:
    """The closed box (s, e, lat_min, lat_max, lon_min, lon_max) as a condition on points. Where points come from a
    table, give its reader the times as well, so that the scan skips what lies outside."""
    s, e, a, b, c, d = box
    return F.col("ts").between(s, e) & F.col("lat").between(a, b) & F.col("lon").between(c, d)


def in_box() -> Column:
    """The same with the bounds in columns."""
    return F.col("ts").between(F.col("s"), F.col("e")) & F.col("lat").between(F.col("lat_min"), F.col("lat_max")) & F.col("lon").between(F.col("lon_min"), F.col("lon_max"))


def in_boxes(points: DataFrame, queries: DataFrame) -> DataFrame:
    """Points joined with the boxes that they lie in: queries are dealt to the days that they touch, so that the join is
    by equality of days and the rest of the box is a residual condition. Spark broadcasts the queries if they are small."""
    days = queries.withColumn("day", F.explode(F.sequence(floor_div(F.col("s"), DAY_SECONDS), floor_div(F.col("e"), DAY_SECONDS))))
    return points.withColumn("day", floor_div(F.col("ts"), DAY_SECONDS)).join(days, "day").where(in_box()).drop("day")


def batch_truth(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, record_id) of many boxes at once."""
    return in_boxes(points, queries).select("query_id", "record_id")


def bounds(points: DataFrame) -> DataFrame:
    """One row: ts_min to lon_max, and lat_pad, lon_pad: 0.1 % of the span, 1e-6 at least."""
    pad = lambda c: F.greatest(F.lit(1e-6), (F.max(c) - F.min(c)) * F.lit(0.001))
    return points.agg(*(f(c).alias(f"{c}_{n}") for c in ("ts", "lat", "lon") for n, f in (("min", F.min), ("max", F.max))), pad("lat").alias("lat_pad"), pad("lon").alias("lon_pad"))


def default_window(points: DataFrame) -> DataFrame:
    """The box about the middle record (by id): its day, and 2 % of the span to each side, held inside the bounds. The
    middle id is found by counting ids in ranges, so that no task sorts all records."""
    middle = points.where(F.col("record_id") == F.lit(value_at_rank(points, "record_id", points.count() // 2))).limit(1)
    b = bounds(points)
    out = middle.join(F.broadcast(b))  # one row
    edge = lambda c: [F.greatest(F.col(f"{c}_min"), F.col(c) - (F.col(f"{c}_max") - F.col(f"{c}_min")) * 0.02).alias(f"q_{c}_min"), F.least(F.col(f"{c}_max"), F.col(c) + (F.col(f"{c}_max") - F.col(f"{c}_min")) * 0.02).alias(f"q_{c}_max")]
    day = floor_div(F.col("ts"), DAY_SECONDS) * DAY_SECONDS
    return out.select("record_id", day.alias("q_s"), (day + DAY_SECONDS - 1).alias("q_e"), *edge("lat"), *edge("lon"))


def pending(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The plan's rows whose keys are not among the done ones."""
    return plan.join(done.select(*keys), keys, "left_anti")


def chosen(plan: DataFrame, **lists: str) -> DataFrame:
    """The rows whose columns are in the comma lists given; an empty list lets all through."""
    for name, text in lists.items():
        if wanted := [x.strip() for x in text.split(",") if x.strip()]:
            plan = plan.where(F.col(name).cast("string").isin(wanted))
    return plan
