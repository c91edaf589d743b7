"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset, a session in one process
    gets a folder of its own; a cluster has no folder that all can see, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stratagrid-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is put there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """The rows of df, written once as a Parquet table in the shared folder and read from there: lineage ends here, and
    a lost executor costs no recomputation. The table is removed when the driver ends, or by ``remove``."""
    spark = df.sparkSession
    path = new_path(spark, "table")
    df.write.option("compression", codec).parquet(path)
    out = read_once(spark, df.schema, path)
    out._stratagrid_path = path
    return out


def read_once(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """The Parquet table at path, whose files' statuses stay on the driver for as long as this DataFrame's plan does and no
    longer: Spark's own cache of them holds those of up to 250 MB of tables that are read no more."""
    key = "spark.sql.hive.filesourcePartitionFileCacheSize"
    usual = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        return spark.read.schema(schema).parquet(path)
    finally:
        spark.conf.set(key, usual)


def remove(df: DataFrame) -> None:
    """Deletes the table behind a ``written`` DataFrame that no later step reads."""
    if path := getattr(df, "_stratagrid_path", None):
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is None:
            return
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: the cluster's own clean-up of the folder applies
        return
