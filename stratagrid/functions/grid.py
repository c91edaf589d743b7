"""A regular grid over time, latitude and longitude, and boxes on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAT, LON = (-90.0, 90.0), (-180.0, 180.0)


def share(value: Column, low: Column, high: Column) -> Column:
    """Position of value in [low, high] as a share; 0 for an empty range."""
    span = (high - low).cast("double")
    return F.when(span == 0, F.lit(0.0)).otherwise((value - low).cast("double") / F.nullif(span, F.lit(0.0)))


def grid_cell(value: Column, low: Column, high: Column, bits: int) -> Column:
    """The cell, cut towards zero and held in [0, 2^bits - 1]."""
    top = (1 << bits) - 1
    return F.least(F.greatest((share(value, low, high) * float(top)).cast("bigint"), F.lit(0).cast("bigint")), F.lit(top).cast("bigint"))


def grid_end(value: Column, low: Column, high: Column, bits: int) -> Column:
    """The end of a box on an axis: rounded up, held in [0, 2^bits]."""
    top = (1 << bits) - 1
    return F.least(F.greatest(F.ceil(share(value, low, high) * float(top)).cast("bigint"), F.lit(0).cast("bigint")), F.lit(1 << bits).cast("bigint"))


def contains_point(box: list[tuple[Column, Column]], point: list[Column]) -> Column:
    """Half-open: start <= p < end on each axis."""
    return _all((s <= p) & (p < e) for (s, e), p in zip(box, point, strict=True))


def contains_box(outer: list[tuple[Column, Column]], inner: list[tuple[Column, Column]], slack: int = 0) -> Column:
    """Whether inner lies in outer; with slack the inner's ends may be as much further."""
    return _all((s <= a) & (b <= e + slack) for (s, e), (a, b) in zip(outer, inner, strict=True))


def intersects(one: list[tuple[Column, Column]], two: list[tuple[Column, Column]]) -> Column:
    """Whether half-open boxes share a point; an empty box shares none."""
    return _all((s < b) & (a < e) & (s < e) & (a < b) for (s, e), (a, b) in zip(one, two, strict=True))


def contains_range(lo: Column, hi: Column, a: Column, b: Column) -> Column:
    """Closed: [lo, hi] holds [a, b]."""
    return (lo <= a) & (b <= hi)


def point_bytes(x: Column, y: Column, z: Column) -> Column:
    """Twelve bytes, each number big-endian."""
    return F.unhex(F.concat(*(F.lpad(F.hex(c.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for c in (x, y, z))))


def bytes_point(raw: Column) -> Column:
    """The struct (x, y, z) that ``point_bytes`` wrote."""
    number = lambda k: F.conv(F.hex(F.substring(raw, 4 * k + 1, 4)), 16, 10).cast("bigint")
    signed = lambda n: F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n).cast("int")
    return F.struct(*(signed(number(k)).alias(n) for k, n in enumerate("xyz")))


def _all(conditions) -> Column:
    found = F.lit(True)
    for c in conditions:
        found = found & c
    return found
