"""Bit vectors as arrays of 0 and 1 (tinyint), the lowest bit first, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bit(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("tinyint")


def zeros(size: Column | int) -> Column:
    return F.array_repeat(_bit(0), size)


def from_number(x: Column, size: int) -> Column:
    """The lowest ``size`` bits of a number."""
    return F.array(*(_bit(F.shiftrightunsigned(x.cast("bigint"), k).bitwiseAND(F.lit(1))) for k in range(size)))


def to_number(v: Column) -> Column:
    """The number with these bits; of 64, the highest is the sign."""
    places = F.transform(v, lambda b, i: F.call_function("shiftleft", b.cast("bigint"), i))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda n, b: n.bitwiseOR(b))


def text(v: Column) -> Column:
    """The bits as text, the highest first."""
    return F.array_join(F.transform(F.reverse(v), lambda b: b.cast("string")), "")


def both(one: Column, two: Column) -> Column:
    """And; like or, xor and minus for vectors of one length, to which the shorter is widened with zeros."""
    return _pairwise(one, two, lambda a, b: a * b)


def either(one: Column, two: Column) -> Column:
    return _pairwise(one, two, lambda a, b: F.greatest(a, b))


def differing(one: Column, two: Column) -> Column:
    return _pairwise(one, two, lambda a, b: F.abs(a - b))


def minus(one: Column, two: Column) -> Column:
    """The bits of one that two has not."""
    return _pairwise(one, two, lambda a, b: a * (1 - b))


def _pairwise(one: Column, two: Column, f) -> Column:
    zero = F.lit(0)
    return F.zip_with(one, two, lambda a, b: _bit(f(F.coalesce(a, zero), F.coalesce(b, zero))))


def inverted(v: Column) -> Column:
    return F.transform(v, lambda b: _bit(1 - b))


def shifted_up(v: Column, by: int) -> Column:
    """Towards higher bits; the length stays, zeros come in."""
    return F.slice(F.concat(zeros(by), v), F.lit(1), F.size(v))


def shifted_down(v: Column, by: int) -> Column:
    return resized(F.slice(v, F.lit(by + 1), F.greatest(F.size(v) - by, F.lit(0))), F.size(v))


def resized(v: Column, size: Column | int, fill: int = 0) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    return F.slice(F.concat(v, F.array_repeat(_bit(fill), F.greatest(size - F.size(v), F.lit(0)))), F.lit(1), size)


def appended(v: Column, other: Column) -> Column:
    """``other`` on top of v."""
    return F.concat(v, other)


def with_bit(v: Column, at: Column | int, value: Column | int = 1) -> Column:
    """v with the bit at a place (from 0) set."""
    return F.transform(v, lambda b, i: F.when(i == at, _bit(value)).otherwise(b))


def flipped(v: Column, at: Column | int) -> Column:
    return F.transform(v, lambda b, i: F.when(i == at, _bit(1 - b)).otherwise(b))


def count(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("bigint"), lambda n, b: n + b)


def find(v: Column, after: int = -1) -> Column:
    """The lowest place above ``after`` with a 1; -1 if there is none."""
    places = F.filter(F.transform(v, lambda b, i: F.when((b == 1) & (i > after), i).otherwise(F.lit(-1))), lambda i: i >= 0)
    return F.coalesce(F.array_min(places), F.lit(-1))


def less(one: Column, two: Column) -> Column:
    """Whether one comes before two as a number; of vectors of one length."""
    return text(one) < text(two)
