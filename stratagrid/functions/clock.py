"""Time as slots: epoch seconds, days and ten-minute slots, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_SECONDS = 600
DAY_SECONDS = 86400
SLOTS_PER_DAY = 144


def floor_div(x: Column, by: int) -> Column:
    """Floor division; right for negative numbers too (``div`` cuts towards zero)."""
    return F.floor(x / F.lit(by)).cast("bigint")


def date_seconds(text: Column) -> Column:
    """UTC midnight of a YYYY-MM-DD text, in epoch seconds."""
    return F.unix_timestamp(F.to_date(text, "yyyy-MM-dd").cast("timestamp"))


def text_seconds(text: Column) -> Column:
    """Epoch seconds of 'YYYY-MM-DD HH:MM:SS' with any suffix, which is ignored; null if it isn't a time."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))


def abs_slot(ts: Column, seconds: int = SLOT_SECONDS) -> Column:
    return floor_div(ts, seconds)


def day_start(ts: Column) -> Column:
    return floor_div(ts, DAY_SECONDS) * DAY_SECONDS


def slot_in_day(ts: Column) -> Column:
    """0 to 143."""
    return floor_div(ts - day_start(ts), SLOT_SECONDS)


def interval_attribute(ts: Column, first_day: Column) -> Column:
    """Slots since the start of the first day."""
    return floor_div(day_start(ts) - first_day, DAY_SECONDS) * SLOTS_PER_DAY + slot_in_day(ts)


def slot_key(bucket: Column, slot: Column) -> Column:
    return F.concat(F.lit("bucket_"), bucket, F.lit("_slot_"), slot)


def cover_key(bucket: Column, low: Column, high: Column, prefix: str = "cover_bucket_") -> Column:
    return F.concat(F.lit(prefix), bucket, F.lit("_"), low, F.lit("-"), high)


def day_cover_key(day: Column, low: Column, high: Column, prefix: str = "cover_") -> Column:
    return cover_key(day, low, high, prefix)


def day_slot_key(day: Column, slot: Column) -> Column:
    return F.concat(F.lit("utctimestamp"), day, F.lit("_"), slot)
