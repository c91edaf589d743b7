"""Sharding by jump consistent hashing (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm", 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense_positions, table


#: Rows of a shard that one task numbers, about, and parts of a shard at most (their sizes are broadcast).
PART, MOST_SALTS = 250_000, 16_384


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to shards-1, of each unsigned 64-bit key. No ring table: expected steps are logarithmic in
    ``shards``, and one more shard moves 1/(shards+1) of the keys, all of them into the new shard."""
    key = keys.astype(np.uint64).copy()
    at = np.full(len(key), -1, dtype=np.int64)
    to = np.zeros(len(key), dtype=np.int64)
    while (live := np.flatnonzero(to < shards)).size:
        at[live] = to[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        to[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
    return at.astype(np.int32)


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", grow_by: int = 1, salts: int | None = None) -> DataFrame:
    """One row for each row of df: key, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard.

    The key's XXH64 and the number of shards alone decide ``shard`` and ``grown_shard`` (the shard with ``grow_by`` more
    shards). ``slot`` numbers a shard's rows gaplessly from 0 in the order of a salt, key, size and checksum; the salt
    is a hash of these three, so that many rows of one key are numbered in parts, and there are ``salts`` of them, by
    default as many as keep a part at about PART rows.
    Null text: size 8, checksum 0, as for the empty text. Null keys share one shard. Rows that repeat a key share its
    shard and have slots of their own. Other columns are not carried, whatever their names. Empty table: no rows."""

    salts = salts or min(MOST_SALTS, max(64, df.count() // (shards * PART)))

    @F.pandas_udf("shard int, grown_shard int")
    def jump(h: pd.Series) -> pd.DataFrame:
        keys = h.to_numpy(dtype=np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(keys, shards), "grown_shard": jump_hash(keys, shards + grow_by)})

    body = F.coalesce(F.col(text), F.lit(""))
    slim = df.select(F.col(key).alias("_key"), F.xxhash64(key).alias("_h"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    dealt = slim.withColumn("_to", jump("_h")).select("_key", "_h", "size", "text_crc32", "_to.shard", "_to.grown_shard")
    placed = dense_positions(dealt, ["shard"], ["_key", "size", "text_crc32"], F.xxhash64(F.lit("slot"), "_h", "size", "text_crc32"), "slot", salts)
    return placed.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards by the key law, and their shards were there 25."""
    return assign_shards(table(spark, sf_dir, "documents"), 24)
