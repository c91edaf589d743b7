"""Points and query boxes: from the events table, from check-in CSV files, and from query-plan CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagrid.functions.clock import text_seconds
from stratagrid.operators.ranks import rank_within

POINT = ("record_id", "join_key", "ts", "lat", "lon")
#: The columns of a check-in file, in order.
CHECKIN = ("userid", "venueid", "venuecategoryid", "venuecategory", "latitude", "longitude", "timezoneoffset", "utctimestamp", "id")
BOX = "query_id int, s bigint, e bigint, lat_min double, lat_max double, lon_min double, lon_max double"


def coordinate(user: Column, event: Column, a: int, b: int, cells: int, shift: float) -> Column:
    """The test tables hold no coordinates: these are derived from ids, the same in every engine."""
    return ((user * a + event * b) % cells).cast("double") / F.lit(100.0) - F.lit(shift)


def event_points(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """The events as points; only the columns that are needed are read. ``since`` and ``until``, in epoch seconds, both
    included, are conditions on the stored time, which the scan skips row groups by."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = e.schema["ts"].dataType.simpleString()
    at = lambda seconds: F.timestamp_seconds(F.lit(seconds)).cast(kind)
    if since is not None:
        e = e.where(F.col("ts") >= at(since))
    if until is not None:
        e = e.where(F.col("ts") < at(until + 1))
    user, event = F.col("user_id"), F.col("event_id")
    return e.select(
        event.alias("record_id"),
        user.alias("join_key"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000)).cast("bigint").alias("ts"),
        coordinate(user, event, 7919, 31, 18000, 90.0).alias("lat"),
        coordinate(user, event, 104729, 17, 36000, 180.0).alias("lon"),
    )


def read_checkins(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(record_id, join_key, ts, lat, lon, id) of a check-in CSV with a header: columns count by place. Rows whose time
    or coordinates can't be read are left out; the others are numbered from 1 in file order; ``limit`` keeps the first."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in CHECKIN])
    raw = spark.read.csv(path, schema=schema, header=True, mode="PERMISSIVE", enforceSchema=True, ignoreTrailingWhiteSpace=True)
    told = raw.select(
        F.monotonically_increasing_id().alias("_at"),
        F.col("userid").alias("join_key"),
        text_seconds(F.col("utctimestamp")).alias("ts"),
        F.expr("try_cast(latitude as double)").alias("lat"),
        F.expr("try_cast(longitude as double)").alias("lon"),
        F.regexp_replace("id", "\r$", "").alias("id"),
    ).where("ts is not null and lat is not null and lon is not null")
    # The upper bits of the first number are the partition: rows are numbered in each and shifted by those before it.
    numbered = rank_within(told, [], ["_at"], F.shiftrightunsigned("_at", 33), "_n").select((F.col("_n") + 1).cast("bigint").alias("record_id"), "join_key", "ts", "lat", "lon", "id")
    return numbered if limit is None else numbered.where(F.col("record_id") <= limit)


def read_join_table(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The name of a join table's join column (its first), and its rows."""
    raw = spark.read.csv(path, header=True)
    return raw.columns[0], raw.where(F.col(raw.columns[-1]).isNotNull())


def read_expected_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids in either column of a two-column file with a header."""
    raw = spark.read.csv(path, header=True).toDF("a", "b")
    return raw.select(F.explode(F.array(F.expr("try_cast(trim(a) as bigint)"), F.expr("try_cast(trim(b) as bigint)"))).alias("record_id")).where("record_id is not null").distinct()


def read_query_plan(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """A query-plan CSV by header name, quotes and blanks handled; start and end fall back to the planned ones. A row
    without a range is an error."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    have = set(raw.columns)
    either = lambda *names: F.coalesce(*(F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    start, end = either("actual_query_start", "query_start"), either("actual_query_end", "query_end")
    bounds = {n: F.expr(f"try_cast(`{n}` as double)") for n in ("query_lat_min", "query_lat_max", "query_lon_min", "query_lon_max")}
    whole = start.isNotNull() & end.isNotNull()
    for c in bounds.values():
        whole = whole & c.isNotNull()
    plan = raw.withColumn("query_start", F.when(F.assert_true(whole, "a plan row has no range").isNull(), start)).withColumn("query_end", end)
    for n, c in bounds.items():
        plan = plan.withColumn(n, c)
    return plan if dataset is None else plan.where(F.col("dataset") == dataset)


def query_boxes(spark: SparkSession, boxes: list[tuple]) -> DataFrame:
    """Closed boxes in time, latitude and longitude, a row each."""
    return spark.createDataFrame(boxes, BOX)


def require_rows(df: DataFrame, n: int) -> DataFrame:
    """df, or ValueError if it hasn't exactly n rows."""
    if (found := df.count()) != n:
        raise ValueError(f"{found} rows, {n} wanted")
    return df
