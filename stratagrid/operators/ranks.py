"""Order statistics without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS, FEW = 1000, 10_000


def value_at_rank(df: DataFrame, column: str, rank: int):
    """The value at a rank (from 0) of a numeric column without nulls; None beyond the end. Each pass counts the values
    in a thousand bins of the range that is left, on the executors; the driver sees the bins, and FEW values at last."""
    now = df.select(column)
    span = now.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count("*").alias("n")).first()
    if rank < 0 or rank >= span.n:
        return None
    a, b, n = span.a, span.b, span.n
    while a < b and n > FEW:
        k = F.least(F.floor((F.col(column) - F.lit(a)).cast("double") / float(b - a) * BINS), F.lit(BINS - 1))
        rows = now.where(F.col(column).between(a, b)).groupBy(k.alias("k")).agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count("*").alias("n")).collect()
        for r in sorted(rows, key=lambda r: r.k):
            if rank < r.n:
                a, b, n = r.a, r.b, r.n
                break
            rank -= r.n
    if a == b:
        return a
    return sorted(r[0] for r in now.where(F.col(column).between(a, b)).collect())[rank]


def id_part(df: DataFrame, column: str = "record_id", parts: int = 256):
    """A column expression: the part, 0 to parts-1, of the range of all ids that an id lies in. It grows with the id."""
    span = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if span.a is None or span.a == span.b:
        return F.lit(0)
    return F.floor((F.col(column) - F.lit(span.a)).cast("double") / float(span.b - span.a + 1) * parts).cast("bigint")


def rank_within(df: DataFrame, keys: list[str], order: list[str], part, out: str = "rank") -> DataFrame:
    """Adds ``out``: the position, from 0, of each row among those of its keys. ``part`` never falls as ``order`` grows:
    rows are numbered within (keys, part) and shifted by the counts of the parts before, so no task has to hold all rows
    of one key."""
    dealt = df.withColumn("_part", part)
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return dealt.withColumn("_local", local).join(starts, [*keys, "_part"]).withColumn(out, F.col("_local") + F.col("_start")).drop("_part", "_local", "_start")


def hinted(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """Broadcast if its rows, counted now, are few; beyond that Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
