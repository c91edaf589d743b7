"""Where indexes, plans and results are put: Parquet, JSON, CSV, paged key stores; and parsers of result lines."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_index(df: DataFrame, path: str, key: str | None = None) -> None:
    """An encrypted index as Parquet; with ``key``, a directory for each value so that a look-up reads one."""
    w = df.write.mode("overwrite")
    (w.partitionBy(key) if key else w).parquet(path)


def write_json_index(df: DataFrame, path: str) -> None:
    """An index as JSON lines: binary columns in base64."""
    cols = [F.base64(c).alias(c) if t == "binary" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").json(path)


def read_json_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that ``write_json_index`` wrote; ``schema`` names the original types."""
    binary = {p.split()[0] for p in schema.split(",") if p.split()[1] == "binary"}
    told = ", ".join(f"{p.split()[0]} {'string' if p.split()[1] == 'binary' else p.split()[1]}" for p in schema.split(","))
    raw = spark.read.schema(told).json(path)
    return raw.select(*(F.unbase64(c).alias(c) if c in binary else F.col(c) for c in raw.columns))


def write_plan(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_results(df: DataFrame, path: str) -> None:
    """Adds rows; columns that are new since the last time are merged on reading."""
    df.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def result_line(columns: list[str], mark: str = "[RESULT]") -> Column:
    """'[RESULT] k=v k=v ...' of a row."""
    return F.concat_ws(" ", F.lit(mark), *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))


def parse_result(line: Column) -> Column:
    """The map of a result line's fields."""
    return F.str_to_map(F.regexp_replace(line, r"^\[[A-Z_]+\] ", ""), F.lit(" "), F.lit("="))


def scrape(log: Column, name: str) -> Column:
    """The number after 'name:' in a log line, null if there is none."""
    return F.nullif(F.regexp_extract(log, rf"(?i){name}\s*[:=]\s*([0-9.]+)", 1), F.lit("")).cast("double")


def setting(name: str, default: int | float | str, spark: SparkSession | None = None) -> int | float | str:
    """A parameter from spark.conf, else the environment, else the default; integers are 1 at least; what can't be read
    gives the default."""
    raw = (spark.conf.get(f"spark.stratagrid.{name}", None) if spark else None) or os.environ.get(name.upper())
    if raw is None:
        return default
    try:
        return max(1, int(raw)) if isinstance(default, int) else type(default)(raw)
    except ValueError:
        return default


def put(store: DataFrame, items: DataFrame, key: str = "key") -> DataFrame:
    """A key store with items put in: an item of a key that is there takes its place."""
    return store.join(items, key, "left_anti").unionByName(items)


def get(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_semi")


def delete(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


#: A prime, and a generator of its multiplicative group: number i of a stream is its i-th mix, the same in every engine.
PRIME, STEP = 2_147_483_647, 48_271


def unit(i: Column, seed: int) -> Column:
    """A number in [0, 1) that i and the seed decide: two rounds of a multiplicative congruence."""
    one = ((i % F.lit(PRIME)) * F.lit(STEP) + F.lit(seed * 7919 + 1)) % F.lit(PRIME)
    two = (one.bitwiseXOR(F.shiftright(one, 13)) * F.lit(STEP)) % F.lit(PRIME)
    return two / F.lit(float(PRIME))


def uniform_keys(spark: SparkSession, n: int, top: int, seed: int = 1) -> DataFrame:
    return spark.range(n).select("id", F.floor(unit(F.col("id"), seed) * top).cast("bigint").alias("key"))


def range_keys(spark: SparkSession, n: int, first: int = 0) -> DataFrame:
    return spark.range(n).select("id", (F.col("id") + first).alias("key"))


def zipf_keys(spark: SparkSession, n: int, top: int, theta: float = 0.8, seed: int = 1) -> DataFrame:
    """Keys 1 to top with probability about k^-theta, by the inverse of the continuous distribution function."""
    u = unit(F.col("id"), seed)
    power = 1.0 - theta
    k = F.exp(u * F.log(F.lit(top + 1.0))) if abs(power) < 1e-9 else F.pow(u * ((top + 1.0) ** power - 1.0) + 1.0, F.lit(1.0 / power))
    return spark.range(n).select("id", F.least(F.floor(k), F.lit(top)).cast("bigint").alias("key"))
