"""Adaptive time buckets: consecutive records, in time order, cut when a bucket is full or has gone through enough slots."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.functions.clock import DAY_SECONDS, abs_slot, floor_div
from stratagrid.operators.ranks import id_part, rank_within

#: Parts of the range of ids that a second's records are dealt to when they are numbered.
PARTS = 256

@dataclass(frozen=True)
class Sizes:
    """slot_seconds, and of a bucket: records at which it ends with its slot, at which it ends at once, slots it may have."""

    slot_seconds: int = 600
    target: int = 2000
    most: int = 3000
    slots: int = 256

    def normal(self) -> Sizes:
        return Sizes(max(1, self.slot_seconds), max(1, self.target), max(1, self.target, self.most), max(1, self.slots))


def slot_states(points: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(abs_slot, k, open_n, bucket): each occupied slot's records, how many records the bucket that is open at its start
    has, and that bucket's number.

    Cutting is sequential, over slots, not records: one task folds a row for each occupied slot (the span of time over
    the slot's length, 52,560 rows a year for ten minutes), however many records these hold."""
    z = sizes.normal()
    counts = points.groupBy(abs_slot(F.col("ts"), z.slot_seconds).alias("abs_slot")).agg(F.count("*").alias("k"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = slots = bucket = 0
        for b in batches:
            opens, numbers = [], []
            for k in b.column(1).to_pylist():
                opens.append(n)
                numbers.append(bucket)
                if n + k >= z.most:  # cut when full, and every ``most`` records from there
                    over = k - (z.most - n)
                    bucket += 1 + over // z.most
                    n = over % z.most
                    slots = int(n > 0)
                else:
                    n, slots = n + k, slots + 1
                if n and (n >= z.target or slots >= z.slots):
                    n, slots, bucket = 0, 0, bucket + 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(opens, pa.int64()), pa.array(numbers, pa.int64())], names=["abs_slot", "k", "open_n", "bucket"])

    return counts.repartition(1).sortWithinPartitions("abs_slot").mapInArrow(fold, "abs_slot long, k long, open_n long, bucket long")


def with_buckets(points: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """``points`` with abs_slot and bucket_id.

    A slot without a cut inside gives its bucket to all its records. Records of the others are numbered within the slot
    in the order of (ts, record_id), in parts by second and range of ids; the bucket follows from the number."""
    z = sizes.normal()
    states = slot_states(points, z)
    met = points.withColumn("abs_slot", abs_slot(F.col("ts"), z.slot_seconds)).join(states, "abs_slot")
    cut = F.col("open_n") + F.col("k") > z.most
    whole = met.where(~cut).select(*points.columns, "abs_slot", F.col("bucket").alias("bucket_id"))
    inside = met.where(cut)
    second = (F.col("ts") - F.col("abs_slot") * z.slot_seconds) * PARTS + id_part(points, "record_id", PARTS)
    ranked = rank_within(inside, ["abs_slot"], ["ts", "record_id"], second)
    over = F.col("rank") - (F.lit(z.most) - F.col("open_n"))
    number = F.when(over < 0, F.col("bucket")).otherwise(F.col("bucket") + 1 + F.floor(over / F.lit(z.most)).cast("bigint"))
    return whole.unionByName(ranked.select(*points.columns, "abs_slot", number.alias("bucket_id")))


def bucket_slots(bucketed: DataFrame) -> DataFrame:
    """(bucket_id, abs_slot, local_slot, n): a bucket's occupied slots, numbered from 0."""
    order = Window.partitionBy("bucket_id").orderBy("abs_slot")
    return bucketed.groupBy("bucket_id", "abs_slot").agg(F.count("*").alias("n")).withColumn("local_slot", (F.row_number().over(order) - 1).cast("int"))


def bucket_table(bucketed: DataFrame) -> DataFrame:
    """(bucket_id, start_ts, end_ts, start_slot, end_slot, n, n_slots, next_bucket)."""
    made = bucketed.groupBy("bucket_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.min("abs_slot").alias("start_slot"), F.max("abs_slot").alias("end_slot"), F.count("*").alias("n"), F.count_distinct("abs_slot").alias("n_slots"))
    # Buckets are numbered without gaps.
    last = made.agg(F.max("bucket_id").alias("last"))
    return made.join(F.broadcast(last)).withColumn("next_bucket", F.when(F.col("bucket_id") < F.col("last"), F.col("bucket_id") + 1)).drop("last")


def touched(buckets: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs of a query and a bucket whose times meet. Both are dealt to the days that they lie in, so that the join is by
    equality; a pair is kept at the first day that they share."""
    days = lambda a, b: F.explode(F.sequence(floor_div(F.col(a), DAY_SECONDS), floor_div(F.col(b), DAY_SECONDS)))
    q = queries.select("query_id", "s", "e", days("s", "e").alias("day"))
    met = buckets.withColumn("day", days("start_ts", "end_ts")).join(q, "day").where("start_ts <= e and end_ts >= s")
    return met.where(F.col("day") == floor_div(F.greatest("s", "start_ts"), DAY_SECONDS)).drop("day")


def local_ranges(bucketed: DataFrame, queries: DataFrame, slot_seconds: int = 600) -> DataFrame:
    """(query_id, bucket_id, lo, hi): the local slots of a touched bucket that a query's time meets; none: -1, -1."""
    met = touched(bucket_table(bucketed), queries).select("query_id", "bucket_id", abs_slot(F.greatest("s", "start_ts"), slot_seconds).alias("a"), abs_slot(F.least("e", "end_ts"), slot_seconds).alias("b"))
    slots = bucket_slots(bucketed)
    joined = met.join(slots, "bucket_id").groupBy("query_id", "bucket_id").agg(
        F.min(F.when(F.col("abs_slot").between(F.col("a"), F.col("b")), F.col("local_slot"))).alias("lo"),
        F.max(F.when(F.col("abs_slot").between(F.col("a"), F.col("b")), F.col("local_slot"))).alias("hi"),
    )
    return joined.select("query_id", "bucket_id", F.coalesce("lo", F.lit(-1)).alias("lo"), F.coalesce("hi", F.lit(-1)).alias("hi"))


def locate(buckets: DataFrame, times: DataFrame) -> DataFrame:
    """For each ts of ``times``, the first bucket that ends at or after its slot's start (null: none). A bucket answers for
    the slot starts after the end of the one before it, up to its own end; both sides are dealt to days, so that the join
    is by equality. What lies before all buckets is the first one's."""
    ends = buckets.select((F.col("bucket_id") + 1).alias("bucket_id"), F.col("end_ts").alias("before"))
    spans = buckets.join(ends, "bucket_id", "left").select("bucket_id", (F.coalesce("before", F.col("start_ts") - 1) + 1).alias("a"), F.col("end_ts").alias("b"))
    spans = spans.where("a <= b")  # of buckets that end in one second the first has it
    first = buckets.agg(F.min("start_ts").alias("first"))
    days = F.explode(F.sequence(floor_div(F.col("a"), DAY_SECONDS), floor_div(F.col("b"), DAY_SECONDS)))
    asked = times.distinct().join(F.broadcast(first)).withColumn("at", F.greatest(floor_div(F.col("ts"), 600) * 600, F.col("first")))
    met = asked.withColumn("day", floor_div(F.col("at"), DAY_SECONDS)).join(spans.withColumn("day", days), "day", "left")
    inside = F.col("at").between(F.col("a"), F.col("b"))
    return met.groupBy("ts").agg(F.min(F.when(inside, F.col("bucket_id"))).alias("bucket_id"))


def bucket_stats(buckets: DataFrame) -> DataFrame:
    return buckets.agg(F.count("*").alias("n_buckets"), F.sum("n").alias("n_records"), F.max("n").alias("max_records"), F.round(F.avg("n"), 6).alias("avg_records"), F.max("n_slots").alias("max_slots"), F.round(F.avg("n_slots"), 6).alias("avg_slots"), F.sum(F.lit(48) + F.col("n_slots") * 16).alias("metadata_bytes"))

