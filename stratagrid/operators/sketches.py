"""Probabilistic filters over Spark: Bloom filters as tables of set bits, counting and spectral variants, and those whose
state depends on the order of insertion, which are folded in one pass over an ordered (small) input."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bloom_size(fp: float, n: int) -> int:
    """Bits for n items at a false-positive rate."""
    return max(1, math.ceil(-n * math.log(fp) / math.log(2) ** 2))


def bloom_hashes(bits: int, n: int) -> int:
    return max(1, round(bits / n * math.log(2)))


def random_words(n: int, seed: int) -> list[int]:
    """n numbers of 62 bits from a seed, by a rule that any engine can repeat: SHA-256 of 'seed/k'."""
    return [int.from_bytes(hashlib.sha256(f"{seed}/{k}".encode()).digest()[:8], "big") >> 2 for k in range(n)]


def h3(item: Column, seed: int) -> Column:
    """A hash of the H3 family (Carter and Wegman 1979) of a whole number: the exclusive or of the random words at the
    places of its 64 bits that are set."""
    words = F.expr(f"array({', '.join(f'{w}L' for w in random_words(64, seed))})")  # one call, one literal
    places = F.split(F.lpad(F.bin(item.cast("bigint")), 64, "0"), "")  # the highest bit first
    chosen = F.zip_with(F.slice(places, 1, 64), words, lambda b, w: F.when(b == "1", w).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(chosen, F.lit(0).cast("bigint"), lambda a, w: a.bitwiseXOR(w))


def h3_positions(item: Column, k: int, bits: int, partitioned: bool = False, seed: int = 1) -> Column:
    """As ``positions``, by k independent hashes of the H3 family."""
    part = max(1, bits // k) if partitioned else bits
    return F.array(*(F.pmod(h3(item, seed + i), F.lit(part)) + (i * part if partitioned else 0) for i in range(k)))


def positions(item: Column, k: int, bits: int, partitioned: bool = False) -> Column:
    """The k cells of an item, by double hashing h1 + i h2; partitioned: hash i has cells of its own, bits // k of them."""
    h1, h2 = F.pmod(F.xxhash64(item), F.lit(1 << 40)), F.pmod(F.xxhash64(F.lit("second"), item), F.lit(1 << 20)) + 1
    if partitioned:
        part = max(1, bits // k)
        return F.array(*(F.pmod(h1 + h2 * i, F.lit(part)) + i * part for i in range(k)))
    return F.array(*(F.pmod(h1 + h2 * i, F.lit(bits)) for i in range(k)))


def bloom(items: DataFrame, column: str, k: int, bits: int, partitioned: bool = False, family: Callable[..., Column] = positions) -> DataFrame:
    """(cell): the set bits. ``family``: the hashes, ``positions`` or ``h3_positions``."""
    return items.select(column).distinct().select(F.explode(family(F.col(column), k, bits, partitioned)).alias("cell")).distinct()


def bloom_contains(filter_: DataFrame, items: DataFrame, column: str, k: int, bits: int, partitioned: bool = False, family: Callable[..., Column] = positions) -> DataFrame:
    """Distinct items with ``found``: whether all their cells are set. Never false for an item put in."""
    asked = items.select(column).distinct().select(column, F.explode(F.array_distinct(family(F.col(column), k, bits, partitioned))).alias("cell"))
    met = asked.join(filter_.select("cell", F.lit(1).alias("set")), "cell", "left")
    return met.groupBy(column).agg((F.count("set") == F.count("*")).alias("found"))


def bloom_union(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.union(f)
    return out.distinct()


def hamming(one: DataFrame, two: DataFrame) -> int:
    """Cells set in one filter alone."""
    return one.join(two, "cell", "left_anti").count() + two.join(one, "cell", "left_anti").count()


def bloom_remove(filter_: DataFrame, items: DataFrame, column: str, k: int, bits: int, partitioned: bool = False, family: Callable[..., Column] = positions) -> DataFrame:
    """The filter without the items' bits: others that share one are then no longer found."""
    return filter_.join(bloom(items, column, k, bits, partitioned, family), "cell", "left_anti")


def counting(items: DataFrame, column: str, k: int, cells: int, width: int = 4, family: Callable[..., Column] = positions) -> DataFrame:
    """(cell, count): counters that stop at 2^width - 1. Items are counted before they are hashed."""
    counts = items.groupBy(column).agg(F.count("*").alias("_n"))
    each = counts.select("_n", F.explode(F.array_distinct(family(F.col(column), k, cells))).alias("cell"))
    return each.groupBy("cell").agg(F.least(F.sum("_n"), F.lit((1 << width) - 1)).alias("count"))


def counting_remove(counters: DataFrame, items: DataFrame, column: str, k: int, cells: int, width: int = 4, family: Callable[..., Column] = positions) -> DataFrame:
    """Counters with items taken out; never below 0, and zeros leave the table."""
    gone = counting(items, column, k, cells, 62, family).withColumnRenamed("count", "gone")
    left = counters.join(gone, "cell", "left").select("cell", (F.col("count") - F.coalesce("gone", F.lit(0))).alias("count"))
    return left.where("count > 0")


def counting_lookup(counters: DataFrame, items: DataFrame, column: str, k: int, cells: int, family: Callable[..., Column] = positions) -> DataFrame:
    """Distinct items with ``estimate``: the least of their counters, never less than the true count below saturation."""
    asked = items.select(column).distinct().select(column, F.explode(F.array_distinct(family(F.col(column), k, cells))).alias("cell"))
    return asked.join(counters, "cell", "left").groupBy(column).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


class Cells:
    """Hashing for the filters that are folded in order: k cells of a value."""

    def __init__(self, k: int, cells: int, seed: int = 0) -> None:
        self.k, self.cells, self.seed = k, cells, seed

    def of(self, item: object) -> list[int]:
        import xxhash

        raw = str(item).encode()
        a, b = xxhash.xxh64_intdigest(raw, self.seed), xxhash.xxh64_intdigest(raw, self.seed + 1) | 1
        return list(dict.fromkeys((a + i * b) % self.cells for i in range(self.k)))


class CounterVector:
    """Counters of ``width`` bits that stop at both ends."""

    def __init__(self, cells: int, width: int) -> None:
        self.top, self.width, self.at = (1 << width) - 1, width, np.zeros(cells, dtype=np.int64)

    def increment(self, cell: int, by: int = 1) -> bool:
        """False, and the counter at its top, if it would go over."""
        fits = self.at[cell] + by <= self.top
        self.at[cell] = min(self.top, self.at[cell] + by)
        return bool(fits)

    def decrement(self, cell: int, by: int = 1) -> bool:
        fits = self.at[cell] >= by
        self.at[cell] = max(0, self.at[cell] - by)
        return bool(fits)

    def set(self, cell: int, value: int) -> bool:
        """False, and the counter at its top, if the value does not fit."""
        self.at[cell] = min(self.top, max(0, value))
        return 0 <= value <= self.top

    def count(self, cell: int) -> int:
        return int(self.at[cell])

    def merge(self, other: CounterVector) -> None:
        self.at = np.minimum(self.top, self.at + other.at)

    def text(self) -> str:
        """All counters' bits, least significant first."""
        return "".join(f"{v:0{self.width}b}"[::-1] for v in self.at.tolist())


class SpectralMinimum:
    """Adds to an item's least counters alone."""

    def __init__(self, hashes: Cells, width: int = 8) -> None:
        self.hashes, self.counters = hashes, CounterVector(hashes.cells, width)

    def add(self, item: object) -> None:
        cells = self.hashes.of(item)
        least = min(self.counters.at[c] for c in cells)
        for c in cells:
            if self.counters.at[c] == least:
                self.counters.increment(c)

    def lookup(self, item: object) -> int:
        return int(min(self.counters.at[c] for c in self.hashes.of(item)))


class SpectralRecurring:
    """Two tables: items whose least counter stands alone among their cells are kept in the second one too."""

    def __init__(self, hashes: Cells, second: Cells, width: int = 8) -> None:
        self.hashes, self.second = hashes, second
        self.one, self.two = CounterVector(hashes.cells, width), CounterVector(second.cells, width)

    def _single(self, cells: list[int]) -> bool:
        values = [self.one.at[c] for c in cells]
        return values.count(min(values)) == 1

    def add(self, item: object) -> None:
        cells = self.hashes.of(item)
        for c in cells:
            self.one.increment(c)
        if self._single(cells):
            other = self.second.of(item)
            least = min(self.two.at[c] for c in other)
            if least:
                for c in other:
                    self.two.increment(c)
            else:
                for c in other:
                    self.two.at[c] = max(self.two.at[c], min(self.one.at[x] for x in cells))

    def remove(self, item: object) -> None:
        """Takes one occurrence out of both tables: of the first, and of the second where the item is kept there."""
        cells, other = self.hashes.of(item), self.second.of(item)
        if self._single(cells) and min(self.two.at[c] for c in other):
            for c in other:
                self.two.decrement(c)
        for c in cells:
            self.one.decrement(c)

    def lookup(self, item: object) -> int:
        cells = self.hashes.of(item)
        least = int(min(self.one.at[c] for c in cells))
        if self._single(cells) and (second := int(min(self.two.at[c] for c in self.second.of(item)))):
            return min(second, least)
        return least


class Bitwise:
    """Counts in binary: level j is a Bloom filter of the items whose counts have had a carry into bit j. A carry out of
    the highest level adds one, so no count wraps."""

    def __init__(self, k: int, cells: int, levels: int = 1) -> None:
        self.k, self.cells = k, cells
        self.levels: list[tuple[Cells, np.ndarray]] = []
        for _ in range(levels):
            self._grow()

    def _grow(self) -> None:
        self.levels.append((Cells(self.k, self.cells, 10 * len(self.levels)), np.zeros(self.cells, dtype=bool)))

    def add(self, item: object) -> None:
        for hashes, bits in self.levels:
            cells = hashes.of(item)
            if not bits[cells].all():
                bits[cells] = True
                return
            bits[cells] = False
        self._grow()
        hashes, bits = self.levels[-1]
        bits[hashes.of(item)] = True

    def lookup(self, item: object) -> int:
        return sum(int(bits[hashes.of(item)].all()) << j for j, (hashes, bits) in enumerate(self.levels))


class AgingPair:
    """Two buffers: when the active one has taken its share of items it becomes the old one, and a new one is begun."""

    def __init__(self, k: int, cells: int, capacity: int) -> None:
        self.hashes, self.capacity, self.items = Cells(k, cells), capacity, 0
        self.now, self.old = np.zeros(cells, dtype=bool), np.zeros(cells, dtype=bool)

    def add(self, item: object) -> None:
        cells = self.hashes.of(item)
        if self.now[cells].all():
            return
        if self.items == self.capacity:
            self.old, self.now, self.items = self.now, np.zeros_like(self.now), 0
        self.now[cells] = True
        self.items += 1

    def lookup(self, item: object) -> int:
        cells = self.hashes.of(item)
        return int(self.now[cells].all() or self.old[cells].all())


class Stable:
    """Each insertion first lowers some cells at random, so old items fade."""

    def __init__(self, k: int, cells: int, width: int, lowered: int, seed: int = 1) -> None:
        self.hashes, self.counters, self.lowered, self.rng = Cells(k, cells), CounterVector(cells, width), lowered, np.random.default_rng(seed)

    def add(self, item: object) -> None:
        for c in self.rng.integers(0, self.hashes.cells, self.lowered):
            self.counters.decrement(int(c))
        for c in self.hashes.of(item):
            self.counters.at[c] = self.counters.top

    def lookup(self, item: object) -> int:
        return int(min(self.counters.at[c] for c in self.hashes.of(item)))


def fold(sketch, items: Iterable[object]):
    """The sketch after the items, in order."""
    for x in items:
        sketch.add(x)
    return sketch


def confusion(told: DataFrame, truth: DataFrame, column: str) -> DataFrame:
    """TP, FP, FN and TN of (column, found) against the members in ``truth``."""
    met = told.join(truth.select(column, F.lit(True).alias("member")).distinct(), column, "left")
    of = lambda found, member: F.sum(F.when((F.col("found") == found) & (F.coalesce("member", F.lit(False)) == member), 1).otherwise(0))
    return met.agg(of(True, True).alias("tp"), of(True, False).alias("fp"), of(False, True).alias("fn"), of(False, False).alias("tn"))


def static_lookup(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """A static key -> value table: the values of the keys asked for (a hash join; keys without a value have null)."""
    return asked.join(pairs, "key", "left")


class XorTable:
    """A static table of whole-number keys to values without the keys: a value is the exclusive or of three slots, and
    eight check bits tell nearly all keys that are not in it (Graf and Lemire 2020). Built by peeling."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        keys, first = np.unique(keys.astype(np.int64), return_index=True)
        values = values[first]
        self.third = max(2, int(np.ceil(1.23 * len(keys) / 3)) + 11)
        for self.seed in range(1000):
            if self._peel(keys, values):
                return
        raise ValueError("no seed lets the keys be peeled")

    def _slots(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            h = keys.astype(np.uint64) + np.uint64(self.seed) * np.uint64(0x9E3779B97F4A7C15)
            parts = []
            for mul in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD):
                h = (h ^ (h >> np.uint64(31))) * np.uint64(mul)
                parts.append(h ^ (h >> np.uint64(29)))
        at = np.stack([(p % np.uint64(self.third)).astype(np.int64) + k * self.third for k, p in enumerate(parts[:3])], axis=1)
        return at, (parts[3] >> np.uint64(56)).astype(np.int64)

    def _peel(self, keys: np.ndarray, values: np.ndarray) -> bool:
        at, check = self._slots(keys)
        n = np.bincount(at.ravel(), minlength=3 * self.third)
        whose = np.zeros(3 * self.third, dtype=np.int64)
        for k in range(3):
            np.bitwise_xor.at(whose, at[:, k], np.arange(len(keys)))
        order, todo, left = [], list(np.flatnonzero(n == 1)), n.copy()
        while todo:
            s = int(todo.pop())
            if left[s] != 1:
                continue
            i = int(whose[s])
            order.append((i, s))
            for t in at[i]:
                left[t] -= 1
                whose[t] ^= i
                if left[t] == 1:
                    todo.append(t)
        if len(order) < len(keys):
            return False
        self.values, self.checks = np.zeros(3 * self.third, dtype=np.int64), np.zeros(3 * self.third, dtype=np.int64)
        for i, s in reversed(order):
            self.values[s] = self.checks[s] = 0
            self.values[s] = values[i] ^ np.bitwise_xor.reduce(self.values[at[i]])
            self.checks[s] = check[i] ^ np.bitwise_xor.reduce(self.checks[at[i]])
        return True

    def lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the check bits agree (always, for keys that are in the table)."""
        at, check = self._slots(keys)
        return np.bitwise_xor.reduce(self.values[at], axis=1), np.bitwise_xor.reduce(self.checks[at], axis=1) == check


def xor_lookup(pairs: DataFrame, asked: DataFrame, block: int = 20_000) -> DataFrame:
    """(key, found, item) of the distinct keys asked for, of static (key, item) pairs: both are dealt by a hash of the key
    to blocks of about ``block`` pairs, and each block has a ``XorTable`` of its own. ``found`` errs for one absent key in
    256; of pairs with one key the least item counts."""
    known = pairs.where("key is not null").groupBy("key").agg(F.min("item").alias("item"))
    blocks = max(1, -(-known.count() // block))
    deal = lambda df: df.withColumn("b", F.pmod(F.xxhash64("key"), F.lit(blocks)))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = right["key"].to_numpy()
        if left.num_rows:
            values, found = XorTable(left["key"].to_numpy(), left["item"].to_numpy()).lookup(keys)
        else:
            values, found = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        return pa.table({"key": pa.array(keys, pa.int64()), "found": pa.array(found), "item": pa.array(values, pa.int64(), mask=~found)})

    wanted = deal(asked.select("key").where("key is not null").distinct())
    return deal(known).groupBy("b").cogroup(wanted.groupBy("b")).applyInArrow(answer, "key long, found boolean, item long")


def evaluate(members: DataFrame, counted: DataFrame, column: str, k: int, bits: int, partitioned: bool = False, family: Callable[..., Column] = positions) -> DataFrame:
    """TP, FP, FN and TN of a Bloom filter of ``members``, over (column, n) weighted by n."""
    told = bloom_contains(bloom(members, column, k, bits, partitioned, family), counted, column, k, bits, partitioned, family)
    met = told.join(counted.groupBy(column).agg(F.sum("n").alias("n")), column).join(members.select(column, F.lit(True).alias("member")).distinct(), column, "left")
    of = lambda found, member: F.coalesce(F.sum(F.when((F.col("found") == found) & (F.coalesce("member", F.lit(False)) == member), F.col("n"))), F.lit(0))
    return met.agg(of(True, True).alias("tp"), of(True, False).alias("fp"), of(False, True).alias("fn"), of(False, False).alias("tn"))


def trials(members: DataFrame, counted: DataFrame, column: str, n: int, rates: list[float], family: Callable[..., Column] = positions) -> DataFrame:
    """(fp_rate, bits, k, tp, fp, fn, tn) of filters sized for n members at each rate."""
    out = None
    for rate in rates:
        bits = bloom_size(rate, n)
        k = bloom_hashes(bits, n)
        one = evaluate(members, counted, column, k, bits, False, family).select(F.lit(rate).alias("fp_rate"), F.lit(bits).alias("bits"), F.lit(k).alias("k"), "tp", "fp", "fn", "tn")
        out = one if out is None else out.union(one)
    return out


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(item): the lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("item")).where("item <> ''")


def read_counted(spark: SparkSession, path: str) -> DataFrame:
    """(item, n) of lines 'n item', as ``uniq -c`` writes them; other lines are left out."""
    told = spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\d+)\s+(.+?)\s*$", 1).alias("n"), F.regexp_extract("value", r"^\s*(\d+)\s+(.+?)\s*$", 2).alias("item"))
    return told.where("n <> ''").select("item", F.col("n").cast("bigint").alias("n"))
