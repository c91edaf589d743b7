"""Accuracy, storage and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.functions.clock import DAY_SECONDS, floor_div, slot_in_day
from stratagrid.operators.ranks import BINS, hinted


def accuracy(candidates: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_candidates, n_truth, tp, fp, fn, fp_rate, superset) for every query. One full join on (query, record)
    of the two sides; both may be of any size."""
    a = candidates.select("query_id", "record_id").distinct().withColumn("c", F.lit(1))
    b = truth.select("query_id", "record_id").distinct().withColumn("t", F.lit(1))
    met = a.join(b, ["query_id", "record_id"], "full").groupBy("query_id").agg(F.count("c").alias("n_candidates"), F.count("t").alias("n_truth"), F.sum(F.when(F.col("c").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("tp"))
    every = queries.select("query_id").join(met, "query_id", "left").na.fill(0)
    fp, fn = F.col("n_candidates") - F.col("tp"), F.col("n_truth") - F.col("tp")
    return every.select("query_id", "n_candidates", "n_truth", "tp", fp.alias("fp"), fn.alias("fn"), F.when(F.col("n_candidates") > 0, F.round(fp / F.col("n_candidates"), 9)).otherwise(F.lit(0.0)).alias("fp_rate"), (fn == 0).alias("superset"))


def is_superset(candidates: DataFrame, truth: DataFrame) -> bool:
    return truth.select("query_id", "record_id").join(candidates, ["query_id", "record_id"], "left_anti").isEmpty()


def false_positives(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    return candidates.join(truth, ["query_id", "record_id"], "left_anti")


def summary(df: DataFrame, by: list[str], value: str, places: int = 6) -> DataFrame:
    """n, mean and sample standard deviation (0 for one row) of each group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), places).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), places).alias("std"))


def slot_density(cells: DataFrame) -> DataFrame:
    """Of (ts, cx, cy): for each day and slot the records and distinct cells."""
    return cells.groupBy(floor_div(F.col("ts"), DAY_SECONDS).alias("day"), slot_in_day(F.col("ts")).alias("slot")).agg(F.count("*").alias("n"), F.count_distinct("cx", "cy").alias("cells"))


def capacity(density: DataFrame) -> DataFrame:
    """The most records and cells of a slot, and 1.5 times the latter, rounded up: what a filter should hold."""
    return density.agg(F.max("n").alias("max_records"), F.max("cells").alias("max_cells"), F.ceil(F.max("cells") * F.lit(1.5)).alias("capacity"))


def interval_false_positives(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Of (query_id, day, slot) on both sides: intervals returned, true ones, and those returned for nothing."""
    a, b = candidates.distinct(), truth.distinct().withColumn("t", F.lit(1))
    return a.join(b, ["query_id", "day", "slot"], "left").groupBy("query_id").agg(F.count("*").alias("intervals"), F.count("t").alias("true_intervals"), (F.count("*") - F.count("t")).alias("fp_intervals"))


def per_record(n_records: int, n_bytes: int, seconds: float) -> tuple[float, float]:
    """Records a second, and bytes a record; 0 where the divisor is."""
    return (n_records / seconds if seconds else 0.0), (n_bytes / n_records if n_records else 0.0)


def upper_median(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """sorted[n // 2] of each group (the upper of two middles; nulls don't count). The values of a group are counted in BINS
    bins of its range; the distinct values of the bin that holds the middle are counted again, and only they are ordered:
    no task sorts a group."""
    df = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    spans = df.groupBy(*by).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count("*").alias("_n"))
    bin_ = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col("_v") - F.col("_a")).cast("double") / (F.col("_b") - F.col("_a")).cast("double") * BINS), F.lit(BINS - 1))).otherwise(F.lit(0)).cast("int")
    binned = df.join(hinted(spans), by).withColumn("_k", bin_)
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    middle = F.floor(F.col("_n") / F.lit(2))
    bins = binned.groupBy(*by, "_k").agg(F.count("*").alias("_c"), F.max("_n").alias("_n")).withColumn("_upto", upto)
    held = bins.where((F.col("_upto") > middle) & (F.col("_upto") - F.col("_c") <= middle)).select(*by, "_k", (F.col("_upto") - F.col("_c")).alias("_before"), middle.alias("_at"))
    inside = binned.drop("_n").join(hinted(held), [*by, "_k"]).groupBy(*by, "_v").agg(F.count("*").alias("_c"), F.max("_before").alias("_before"), F.max("_at").alias("_at"))
    reach = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("_reach", reach).where((F.col("_reach") > F.col("_at")) & (F.col("_reach") - F.col("_c") <= F.col("_at"))).select(*by, F.col("_v").alias(out))


def rates(records: Column, size: Column, seconds: Column) -> tuple[Column, Column]:
    """Records a second, and bytes a record, of columns; 0 where the divisor is."""
    over = lambda a, b: F.when(b != 0, a / b).otherwise(F.lit(0.0))
    return over(records, seconds), over(size, records)
