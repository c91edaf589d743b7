"""Joins restricted by a keyword: plain, and on derived 64-bit keys of which neither shows a join value.

A record of table 1 with join value v stands under each of its keywords (time keys, spatial cells). An entry's masked
value is h(keyword, i) xor y(v) with y(v) a keyed hash of v; a client who asks for a keyword and a keyword of table 2
sends the masks to take off and to put on, and what comes out is table 2's key of (keyword 2, v) if such a record
exists. So the search is a hash join of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.functions.cells import point_cells
from stratagrid.functions.crypto import key64
from stratagrid.operators.ranks import id_part, rank_within
from stratagrid.operators.truth import in_boxes


def keyword_semijoin(left: DataFrame, right: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, record_id) of left's records in a box whose join value some right record with the query's keyword has.
    ``right``: (join_key, keyword); ``queries``: boxes with a keyword."""
    inside = in_boxes(left, queries).select("query_id", "keyword", "record_id", "join_key")
    return inside.join(right.select("keyword", "join_key").distinct(), ["keyword", "join_key"], "left_semi").select("query_id", "record_id")


def strip_prefix(value: Column, attribute: str) -> Column:
    """A join value without the 'attribute' or 'attribute=' in front."""
    return F.regexp_replace(value, f"^{attribute}=?", "")


def mask(keyword: Column, i: Column, secret: str = "w") -> Column:
    return key64(F.lit(secret), keyword.cast("string"), F.lit("|"), i.cast("string"))


def value_key(value: Column, secret: str = "z") -> Column:
    return key64(F.lit(secret), value.cast("string"))


def build_masked(rows: DataFrame, value: str | None = None) -> DataFrame:
    """(keyword, i, masked, record_id) of (keyword, join_key, record_id): one entry for each keyword and join value, with
    the group's records; i numbers a keyword's join values from 1, in parts of the range of values, so that no task holds
    a hot keyword. ``value``, if given, is a column that is carried along."""
    distinct = rows.select("keyword", "join_key").distinct()
    numbered = rank_within(distinct, ["keyword"], ["join_key"], id_part(distinct, "join_key"), "i").withColumn("i", (F.col("i") + 1).cast("int"))
    entries = numbered.select("keyword", "join_key", "i", mask(F.col("keyword"), F.col("i")).bitwiseXOR(value_key(F.col("join_key"))).alias("masked"))
    return rows.join(entries, ["keyword", "join_key"]).select("keyword", "i", "masked", "record_id", *([value] if value else []))


def build_keys(rows: DataFrame) -> DataFrame:
    """Table 2's keys: the distinct h(keyword, 0) xor y(v) of (keyword, join_key)."""
    return rows.select(mask(F.col("keyword"), F.lit(0)).bitwiseXOR(value_key(F.col("join_key"))).alias("x")).distinct()


def masked_join(entries: DataFrame, keys2: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, record_id): entries under the query's keywords (query_id, keyword, keyword2) whose value, with the first
    keyword's mask taken off and the second's put on, is a key of table 2."""
    return _hits(entries, asked).join(keys2, "x", "left_semi").select("query_id", "record_id").distinct()


def _hits(entries: DataFrame, asked: DataFrame) -> DataFrame:
    met = entries.join(asked, "keyword")
    x = F.col("masked").bitwiseXOR(mask(F.col("keyword"), F.col("i"))).bitwiseXOR(mask(F.col("keyword2"), F.lit(0)))
    return met.withColumn("x", x)


def masked_values(entries: DataFrame, keys2: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, value, value2): the stored values of both tables behind each hit; ``entries`` carry ``value``, and
    ``keys2`` is (x, value2)."""
    return _hits(entries, asked).join(keys2, "x").select("query_id", "value", "value2").distinct()


def cell_rows(points: DataFrame, bounds: tuple, levels: int) -> DataFrame:
    """The space side of table 1: records under the codes of their cells, one for each level."""
    each = points.select("join_key", "record_id", F.explode(point_cells(F.col("lat"), F.col("lon"), bounds, levels)).alias("c"))
    return each.select(cell_keyword(F.col("c.level"), F.col("c.ix"), F.col("c.iy")).alias("keyword"), "join_key", "record_id")


def cell_keyword(level: Column, ix: Column, iy: Column) -> Column:
    """A cell as one number: keyword of the space side."""
    return (level.cast("bigint") * (1 << 40)) + (ix.cast("bigint") * (1 << 20)) + iy.cast("bigint")


def masked_storage(entries: DataFrame, keys2: DataFrame) -> DataFrame:
    """Entries, keys and their bytes: eight for each number, and the stored values of the entries."""
    one = entries.agg(F.count("*").alias("entries"), (F.count("*") * 8).alias("entry_bytes"), F.coalesce(F.sum(F.length("value")), F.lit(0)).alias("value_bytes"))
    return one.join(F.broadcast(keys2.agg(F.count("*").alias("keys"), (F.count("*") * 8).alias("key_bytes"))))


def both(one: DataFrame, two: DataFrame) -> DataFrame:
    """The rows that the time side and the space side share."""
    return one.select("query_id", "record_id").intersect(two.select("query_id", "record_id"))


def token_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("keyword").agg(F.count("*").alias("n"))


def id_range(rows: DataFrame, low: int, high: int) -> DataFrame:
    return rows.where(F.col("record_id").between(low, high))
