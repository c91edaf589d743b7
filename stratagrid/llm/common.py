"""Helpers shared by the training-data operators: tables, shared folder, ranks, components."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratagrid.sources import shared


@dataclass(frozen=True)
class Made:
    """What ``remove`` needs of a written table. Not its DataFrame: that holds the plan and a status of each file on the
    driver for as long as it lives, and tables that no one removes would add up."""

    sparkSession: SparkSession
    _stratagrid_path: str


#: The tables that were written and not removed, in order; what is left is removed when the driver ends.
MADE: list[Made] = []
#: Bytes of a batch of rows between the JVM and Python, which holds memory outside the heap on both sides.
BATCH = "8m"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by their bytes, as texts may be long, unless the session has a bound of its own."""
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key, usual) == usual:
        spark.conf.set(key, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows of df, written once to the shared folder and read from there, in batches of bounded bytes."""
    small_batches(df.sparkSession)
    out = shared.written(df, codec)
    MADE.append(Made(out.sparkSession, out._stratagrid_path))
    return out


def remove(df: DataFrame) -> None:
    """Deletes the table behind a ``written`` DataFrame that no later step reads."""
    shared.remove(df)
    path = getattr(df, "_stratagrid_path", None)
    MADE[:] = [x for x in MADE if x._stratagrid_path != path]


def remove_since(mark: int, but: DataFrame) -> None:
    """Deletes what has been written since MADE had ``mark`` tables, but the one given."""
    kept = Made(but.sparkSession, but._stratagrid_path)
    for x in MADE[mark:]:
        if x != kept:
            shared.remove(x)
    del MADE[mark:]
    MADE.append(kept)


def dense_positions(df: DataFrame, group: list[str], order: list[str], spread: Column, out: str, salts: int = 64, weight: str | None = None) -> DataFrame:
    """Adds ``out``: the position of each row in its group, gapless from 0 (with ``weight``: the sum of the weights
    before it). A group is dealt to ``salts`` parts by ``spread``; each part is numbered by itself and shifted by the
    sizes of the parts before it, so that no task holds a whole group. The table of sizes has a row for each group and
    salt at most; the groups must be few (shards, lengths), and it is broadcast."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    salted = df.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*group, "_salt").agg(F.sum(w).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, "_salt").orderBy(*order)
    local = F.sum(w).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - w if weight else F.row_number().over(inside).cast("long") - 1
    return (
        salted.withColumn("_local", local)
        .join(F.broadcast(starts), [*group, "_salt"])
        .withColumn(out, (F.col("_local") + F.col("_start")).cast("long"))
        .drop("_salt", "_local", "_start")
    )


def join_to(rows: DataFrame, facts: DataFrame, key: str, spread: Column, hot: int = 10_000, most_bytes: int = 8 << 20, row_bytes: Column | int = 64) -> DataFrame:
    """``rows`` left-joined with ``facts``, which has one row for each value of ``key`` and, in ``n``, how many rows have it.

    Facts whose counted bytes are few are broadcast. Else those of keys with ``hot`` rows or more, which are few, still are
    (their bytes are counted too), and their rows are dealt out by ``spread``; the others meet by shuffle. So no task gets
    all rows of a hot key, and nothing is broadcast unmeasured."""
    facts = written(facts)
    size = row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes)
    sums = facts.agg(F.sum(size).alias("every"), F.sum(F.when(F.col("n") >= hot, size)).alias("hot")).first()
    if (sums.every or 0) <= most_bytes:
        return rows.join(F.broadcast(facts.drop("n")), key, "left")
    values = [c for c in facts.columns if c not in (key, "n")]
    few = facts.where(F.col("n") >= hot).select(F.col(key).alias("_key"), F.lit(True).alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in values))
    met = rows.join(F.broadcast(few) if (sums.hot or 0) <= most_bytes else few, F.col(key) == F.col("_key"), "left")
    met = met.withColumn("_spread", F.when(F.col("_hot"), F.pmod(spread, F.lit(1 << 20)) + 1).otherwise(F.lit(0)).cast("long"))
    others = facts.where(F.col("n") < hot).select(key, F.lit(0).cast("long").alias("_spread"), *(F.col(c).alias(f"_cold_{c}") for c in values))
    met = met.join(others, [key, "_spread"], "left")
    return met.select(*rows.columns, *(F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in values))


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v, both long; any order, repeats allowed): component is
    the smallest node reachable. Alternates the large-star and small-star steps, which need a number of rounds that is
    logarithmic in practice; minima are aggregated before the shuffle and joined back, so no neighbourhood is ever
    gathered into one row or task. Each round's edges are written to the shared folder."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = near.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
        met = near.join(least, F.col("u") == F.col("_u")).drop("_u")
        if large:
            moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = met.select("v", "m").union(least.select(F.col("_u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where("u <> v").distinct()

    def print_of(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())

    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = print_of(now)
    for _ in range(max_rounds):
        new = written(star(star(now, True), False))
        found = print_of(new)
        remove(now)
        now = new
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
