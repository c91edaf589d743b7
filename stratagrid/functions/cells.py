"""Hierarchical spatial cells: at level l a domain is cut into 2^l by 2^l cells."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_domain(low: list[float], high: list[float], levels: int) -> None:
    """ValueError unless the domain has the same number of bounds on both sides, is not empty, and has a level."""
    if len(low) != len(high) or not low:
        raise ValueError("a domain needs as many lower as upper bounds")
    if levels < 1 or any(a >= b for a, b in zip(low, high, strict=True)):
        raise ValueError("a domain needs levels, and bounds in order")


def cell(value: Column, low: Column | float, high: Column | float, level: int) -> Column:
    """The cell of a value on one axis, held inside the domain; the upper bound lies in the last cell."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    n = 1 << level
    at = F.floor((value - low) / (high - low) * float(n)).cast("bigint")
    return F.least(F.greatest(at, F.lit(0).cast("bigint")), F.lit(n - 1).cast("bigint"))


def point_cells(lat: Column, lon: Column, bounds: tuple, levels: int, leaf_only: bool = False) -> Column:
    """A point's cells, one for each level from 1 (or the last level alone): an array of (level, ix, iy)."""
    a, b, c, d = bounds
    wanted = [levels] if leaf_only else range(1, levels + 1)
    return F.array(*(F.struct(F.lit(k).alias("level"), cell(lat, a, b, k).alias("ix"), cell(lon, c, d, k).alias("iy")) for k in wanted))


def query_cells(box: tuple[float, float, float, float], bounds: tuple[float, float, float, float], levels: int) -> list[tuple[int, int, int]]:
    """The cells of a query box: each cell that lies inside it and whose parent does not, and the cells of the last level
    that it cuts. A box of the whole domain has the cells of level 1. The upper edges belong to the box."""
    (a, b, c, d), (lo_a, hi_a, lo_c, hi_c) = box, bounds

    def at(v: float, low: float, high: float) -> int:
        n = 1 << levels
        return min(max(int((v - low) / (high - low) * n // 1), 0), n - 1)

    x0, x1, y0, y1 = at(a, lo_a, hi_a), at(b, lo_a, hi_a), at(c, lo_c, hi_c), at(d, lo_c, hi_c)
    if b < lo_a or a > hi_a or d < lo_c or c > hi_c:
        return []
    return sorted(_cover(1, 0, 0, levels, (x0, x1, y0, y1)))


def _cover(level: int, px: int, py: int, levels: int, leaf: tuple[int, int, int, int]) -> Iterator[tuple[int, int, int]]:
    x0, x1, y0, y1 = leaf
    n = 1 << (levels - level)
    for ix in (2 * px, 2 * px + 1):
        for iy in (2 * py, 2 * py + 1):
            a, b, c, d = ix * n, ix * n + n - 1, iy * n, iy * n + n - 1
            if a > x1 or b < x0 or c > y1 or d < y0:
                continue
            if x0 <= a and b <= x1 and y0 <= c and d <= y1:
                yield level, ix, iy
            else:
                yield from _cover(level + 1, ix, iy, levels, leaf)


def leaf_cells(x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
    """The cells of the last level alone, from x0 to x1 and y0 to y1: an array of (ix, iy)."""
    row = lambda ix: F.transform(F.sequence(y0, y1), lambda iy: F.struct(ix.alias("ix"), iy.alias("iy")))
    return F.flatten(F.transform(F.sequence(x0, x1), row))


def code_text(level: Column, ix: Column, iy: Column, bounds: tuple[float, float, float, float]) -> Column:
    """'lat,lon,level' of a cell's centre, six digits each."""
    a, b, c, d = bounds
    n = F.pow(F.lit(2.0), level)
    return F.format_string("%.6f,%.6f,%d", F.lit(a) + (ix + 0.5) * (b - a) / n, F.lit(c) + (iy + 0.5) * (d - c) / n, level)
