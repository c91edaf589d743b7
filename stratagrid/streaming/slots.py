"""Points as a stream: slot counts with late data, for the time that an index is between two batch builds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slot_counts(points: DataFrame, late: str = "30 minutes", slot: str = "10 minutes") -> DataFrame:
    """(abs_slot, n) of a stream of points with epoch seconds in ``ts``; records later than ``late`` are not counted."""
    timed = points.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late)
    counted = timed.groupBy(F.window("at", slot).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.floor(F.unix_timestamp("w.start") / F.lit(600)).cast("bigint").alias("abs_slot"), "n")


def new_points(points: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Points whose record_id has not been seen within the time that late data may take: incremental insertion."""
    return points.withColumn("at", F.timestamp_seconds("ts")).withWatermark("at", late).dropDuplicatesWithinWatermark(["record_id"]).drop("at")
