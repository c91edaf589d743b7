"""A stored index of records by day and slot: built once, added to, and asked by pruning.

The rows (day, slot, record_id, cx, cy) lie in a directory for each day, so that a question reads the days it meets. To
add records appends rows; there is nothing to rebuild, as every summary above a slot is an aggregate of its rows. Cells
are those of the bounds the index was built with; what lies outside is held at their edge, on both sides of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagrid.functions import cells, cover
from stratagrid.functions.clock import DAY_SECONDS, floor_div, slot_in_day
from stratagrid.operators import schemes, truth

ROWS = "slot bigint, record_id bigint, cx bigint, cy bigint, day bigint"
#: Columns of a bound table.
BOUNDS = ("lat_min", "lat_max", "lon_min", "lon_max")


class DayIndex:
    """The index under a path of the shared folder."""

    def __init__(self, spark: SparkSession, path: str, level: int) -> None:
        self.spark, self.path, self.level = spark, path, level

    @classmethod
    def build(cls, points: DataFrame, path: str, level: int = schemes.SLOT_LEVEL) -> DayIndex:
        """Writes the index of ``points`` (record_id, ts, lat, lon); an index that is there is replaced."""
        index = cls(points.sparkSession, path, level)
        truth.bounds(points).select(*BOUNDS, F.lit(level).alias("level")).write.mode("overwrite").parquet(f"{path}/bounds")
        index._put(points, "overwrite")
        return index

    def _put(self, points: DataFrame, mode: str) -> None:
        b = self.spark.read.parquet(f"{self.path}/bounds")
        met = points.join(F.broadcast(b))
        at = lambda v, lo, hi: cells.cell(F.col(v), F.col(lo), F.col(hi), self.level)
        rows = met.select(slot_in_day(F.col("ts")).alias("slot"), "record_id", at("lat", "lat_min", "lat_max").alias("cx"), at("lon", "lon_min", "lon_max").alias("cy"), floor_div(F.col("ts"), DAY_SECONDS).alias("day"))
        rows.repartition("day", F.col("slot")).write.mode(mode).partitionBy("day").parquet(f"{self.path}/rows")

    def insert(self, points: DataFrame) -> DayIndex:
        """Adds records: each stands in its slot, with its cell, from then on."""
        self._put(points, "append")
        return self

    def add_to_cover(self, nodes: DataFrame) -> DayIndex:
        """Adds cells to cover nodes: (day, lo, hi, cx, cy), where [lo, hi] is a canonical range of slots of the day. A
        question whose cover on the day is that range then takes the cell as present."""
        nodes.select("day", "lo", "hi", "cx", "cy").write.mode("append").parquet(f"{self.path}/cover")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/rows")

    def _asked(self, queries: DataFrame) -> DataFrame:
        b = self.spark.read.parquet(f"{self.path}/bounds").select(*(F.col(c).alias(f"b_{c}") for c in BOUNDS))
        q = queries.join(F.broadcast(b)).where("lat_max >= b_lat_min and lat_min <= b_lat_max and lon_max >= b_lon_min and lon_min <= b_lon_max")
        for name, c, axis in (("x0", "lat_min", "lat"), ("x1", "lat_max", "lat"), ("y0", "lon_min", "lon"), ("y1", "lon_max", "lon")):
            q = q.withColumn(name, cells.cell(F.col(c), F.col(f"b_{axis}_min"), F.col(f"b_{axis}_max"), self.level))
        return schemes._days(queries).join(q.select("query_id", "x0", "x1", "y0", "y1"), "query_id")

    def slot_candidates(self, queries: DataFrame) -> DataFrame:
        """(query_id, record_id) of all records of each slot in a query's time that has a record in its cells."""
        ranges, rows = self._asked(queries), self.rows()
        hit = schemes._hits(rows.select("day", "slot", "cx", "cy").distinct(), ranges, "day")
        return rows.select("record_id", "day", "slot").join(hit, ["day", "slot"]).select("query_id", "record_id")

    def cover_candidates(self, queries: DataFrame) -> DataFrame:
        """(query_id, record_id) of all records in the cover of a query's slots on each day that has a record, or a cell
        added to the cover's node, in its cells."""
        ranges, rows = self._asked(queries), self.rows()
        covers = ranges.withColumn("c", cover.dyadic_cover(F.col("lo"), F.col("hi")))
        hit = schemes._hits(rows.select("day", "slot", "cx", "cy").distinct(), ranges, "day").select("query_id", "day")
        if (added := self._cover_rows()) is not None:
            met = covers.join(added.select("day", F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"), "cx", "cy"), "day")
            hit = hit.union(met.where("c.lo = n_lo and c.hi = n_hi and cx between x0 and x1 and cy between y0 and y1").select("query_id", "day"))
        wanted = covers.join(hit.distinct(), ["query_id", "day"], "left_semi").select("query_id", "day", "c")
        return rows.select("record_id", "day", "slot").join(wanted, "day").where("slot between c.lo and c.hi").select("query_id", "record_id")

    def _cover_rows(self) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/cover")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.path}/cover")


def roll_up(rows: DataFrame, levels: int = 8) -> DataFrame:
    """(level, day, block, cx, cy): the distinct cells of each block of 2^level slots; a block has what its halves have."""
    each = rows.select("day", "slot", "cx", "cy").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return each.select("level", "day", F.expr("shiftright(slot, level)").alias("block"), "cx", "cy").distinct()


def sharing(rows: DataFrame, bits: int, most: float = 0.001) -> DataFrame:
    """(day, pair, away, shared): neighbouring slots 2i and 2i + 1 of a day: cells that one of them alone has, and whether
    their filters of ``bits`` bytes could be one: both have cells, and the share of differing bits is below ``most``."""
    half = rows.select("day", F.expr("shiftright(slot, 1)").alias("pair"), F.expr("slot & 1").alias("side"), "cx", "cy").distinct()
    sides = half.groupBy("day", "pair", "cx", "cy").agg(F.count("*").alias("k"), F.max("side").alias("late"), F.min("side").alias("early"))
    made = sides.groupBy("day", "pair").agg(F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).alias("away"), F.max("late").alias("late"), F.min("early").alias("early"))
    return made.select("day", "pair", "away", ((F.col("late") == 1) & (F.col("early") == 0) & (F.col("away") / F.lit(8.0 * bits) < most)).alias("shared"))


def first_days(days: DataFrame, times: DataFrame) -> DataFrame:
    """(ts, day) of (ts): the first day of ``days`` (day) at or after the day of each time; null if there is none. Each
    day answers for the days after the one before it; what lies before all is the first one's."""
    known = days.select("day").distinct()
    last = known.agg(F.min("day").alias("least"), F.max("day").alias("most"))
    every = last.where("least is not null").select(F.explode(F.sequence("least", "most")).alias("at"))  # a row a day of the span
    held = every.join(known, every["at"] == known["day"], "left")
    after = Window.orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    following = held.select("at", F.first("day", ignorenulls=True).over(after).alias("day"))
    asked = times.select("ts").distinct().join(F.broadcast(last)).withColumn("at", F.greatest(floor_div(F.col("ts"), DAY_SECONDS), F.col("least")))
    return asked.join(following, "at", "left").select("ts", "day")

