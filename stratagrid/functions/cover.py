"""Canonical ranges and cubes in closed form: no tree is ever built.

Dyadic ranges over [0, 2^h): all aligned blocks, and the middle half of each block of four or more. Staggered cubes over
[0, D)^3: the whole, cubes of width w (2 <= w < D, powers of two) at multiples of w/2, and unit cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_log2(n: Column) -> Column:
    """The least h with 2^h >= n, for n >= 1."""
    return F.ceil(F.log2(n.cast("double"))).cast("int")


def dyadic_path(v: Column, height: int) -> Column:
    """All canonical ranges that hold v: an array of (lo, hi), smallest blocks first, distinct; empty outside."""
    parts = []
    for j in range(height + 1):
        s = 1 << j
        low = F.floor(v / F.lit(s)).cast("bigint") * s
        parts.append(F.array(F.struct(low.alias("lo"), (low + s - 1).alias("hi"))))
        if s >= 4:
            mid = F.struct((low + s // 4).alias("lo"), (low + 3 * s // 4 - 1).alias("hi"))
            inside = v.between(low + s // 4, low + 3 * s // 4 - 1)
            parts.append(F.filter(F.array(F.when(inside, mid)), lambda x: x.isNotNull()))
    every = F.flatten(F.array(*parts))
    return F.filter(every, lambda r: (v >= 0) & (v < 1 << height) & (r["lo"] >= 0))


def dyadic_path_length(v: Column, height: int) -> Column:
    """How many ranges ``dyadic_path`` has: a block for each level, and a middle half wherever the two bits below a
    level's highest differ."""
    v = v.cast("bigint")
    middles = F.bit_count(v.bitwiseXOR(F.shiftright(v, 1)).bitwiseAND(F.lit((1 << max(0, height - 1)) - 1)))
    return F.when((v >= 0) & (v < 1 << height), middles + height + 1).otherwise(F.lit(0)).cast("bigint")


def let(value: Column, body) -> Column:
    """body(value), with the value evaluated once: where expressions are built on each other their text would double at
    each step, until the generated code is too long to compile."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dyadic_cover(a: Column, b: Column) -> Column:
    """The smallest canonical range that holds [a, b], a <= b: a struct (lo, hi). For few rows: questions, not records."""

    def sized(r: Column) -> Column:
        x = r["a"].bitwiseXOR(r["b"])
        bits = F.floor(F.log2(F.greatest(x, F.lit(1)).cast("double"))).cast("int") + 1
        size = F.when(x == 0, F.lit(1).cast("bigint")).otherwise(F.pow(F.lit(2.0), bits).cast("bigint"))
        return let(F.struct(r["a"].alias("a"), r["b"].alias("b"), size.alias("size")), placed)

    def placed(r: Column) -> Column:
        low = F.floor(r["a"] / r["size"]).cast("bigint") * r["size"]
        quarter = F.floor(r["size"] / F.lit(4)).cast("bigint")
        return let(F.struct(r["a"].alias("a"), r["b"].alias("b"), r["size"].alias("size"), low.alias("low"), quarter.alias("quarter")), ends)

    def ends(r: Column) -> Column:
        first, last = r["low"] + r["quarter"], r["low"] + 3 * r["quarter"] - 1
        middle = (r["size"] >= 4) & (first <= r["a"]) & (r["b"] <= last)
        return F.struct(F.when(middle, first).otherwise(r["low"]).alias("lo"), F.when(middle, last).otherwise(r["low"] + r["size"] - 1).alias("hi"))

    return let(F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), sized)


def staggered_cubes(x: Column, y: Column, z: Column, width: int) -> Column:
    """All canonical cubes that hold a cell: an array of (w, x, y, z)."""
    levels, w = [], 1
    while w <= width:
        starts = [_starts(c, w, width) for c in (x, y, z)]
        levels.append(_product(w, *starts))
        w *= 2
    return F.flatten(F.array(*levels))


def _starts(c: Column, w: int, width: int) -> Column:
    """The starts on one axis of canonical cubes of a width that hold cell c."""
    if w == width:
        return F.array(F.lit(0).cast("bigint"))
    if w == 1:
        return F.array(c.cast("bigint"))
    last = F.floor(c / F.lit(w // 2)).cast("bigint") * (w // 2)
    return F.filter(F.array(last - w // 2, last), lambda s: (s >= 0) & (s <= width - w))


def _product(w: int, xs: Column, ys: Column, zs: Column) -> Column:
    cube = lambda p, q, r: F.struct(F.lit(w).cast("bigint").alias("w"), p.alias("x"), q.alias("y"), r.alias("z"))
    return F.flatten(F.flatten(F.transform(xs, lambda p: F.transform(ys, lambda q: F.transform(zs, lambda r: cube(p, q, r))))))


def staggered_cover(low: tuple[Column, Column, Column], high: tuple[Column, Column, Column], width: int, aligned_only: bool = False) -> Column:
    """One canonical cube that holds the cells [low, high) (exclusive ends): the least width 2^k >= the longest side at
    which, on each axis, the aligned start or (unless ``aligned_only``) the one half a width on holds both ends; else the
    whole."""
    side = F.greatest(*(h - l for l, h in zip(low, high, strict=True)), F.lit(1))
    result = F.struct(F.lit(width).cast("bigint").alias("w"), *(F.lit(0).cast("bigint").alias(n) for n in "xyz"))
    w = width // 2
    while w >= 1:
        half = max(1, w // 2)
        starts = []
        for l, h in zip(low, high, strict=True):
            aligned = F.floor(l / F.lit(w)).cast("bigint") * w
            at = F.when(h <= aligned + w, aligned)
            if w > 1 and not aligned_only:
                late = F.floor(l / F.lit(half)).cast("bigint") * half
                at = at.when((h <= late + w) & (late <= width - w), late)
            starts.append(at)
        fits = (side <= w) & starts[0].isNotNull() & starts[1].isNotNull() & starts[2].isNotNull()
        cube = F.struct(F.lit(w).cast("bigint").alias("w"), *(F.coalesce(s, F.lit(0)).cast("bigint").alias(n) for s, n in zip(starts, "xyz", strict=True)))
        result = F.when(fits, cube).otherwise(result)
        w //= 2
    return result


def range_label(lo: Column, hi: Column) -> Column:
    return F.concat_ws(",", lo, hi)


def box_label(x: Column, y: Column, z: Column) -> Column:
    """The label of three ranges, 'x0,x1|y0,y1|z0,z1'."""
    return F.concat_ws("|", *(range_label(r["lo"], r["hi"]) for r in (x, y, z)))


def cube_label(cube: Column) -> Column:
    """'(x,y,z)-(x,y,z)' of a cube's two corners."""
    corner = lambda add: F.concat(F.lit("("), F.concat_ws(",", *((cube[n] + add).cast("string") for n in "xyz")), F.lit(")"))
    return F.concat(corner(F.lit(0)), F.lit("-"), corner(cube["w"]))
