"""Queries of the filters and bit vectors. Their hashes are of the H3 family, which SQL can repeat, so the oracles hold
every bit: false positives and collisions are the same on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.functions import bits
from stratagrid.operators import sketches as K
from stratagrid.plans import registry as R
from stratagrid.sources import stores

RATE = 0.01
HASHES = K.bloom_hashes(K.bloom_size(RATE, 1000), 1000)
_EVEN = lambda s, d: R.events(s, d).where("user_id % 2 = 0")


def h3_sql(x: str, seed: int) -> str:
    words = ", ".join(map(str, K.random_words(64, seed)))
    return f"list_reduce(list_transform(range(64), lambda k: CASE WHEN (({x} >> (63 - k)) & 1) = 1 THEN ([{words}])[k + 1] ELSE CAST(0 AS BIGINT) END), lambda a, w: xor(a, w))"


def _cells_sql(items: str, size: str, k: int, partitioned: bool = False) -> str:
    """(item, cell) of the distinct items of a table under k hashes."""
    part = f"({size} // {k})" if partitioned else f"({size})"
    return " UNION ALL ".join(f"SELECT item, {h3_sql('item', 1 + i)} % {part} + {i * (1 if partitioned else 0)} * {part} AS cell FROM (SELECT DISTINCT item FROM {items})" for i in range(k))


def _size(members: DataFrame, column: str) -> tuple[int, int]:
    """Bits and hashes for as many members as there are."""
    n = max(1, members.select(column).distinct().count())
    return K.bloom_size(RATE, n), HASHES


_SIZE_SQL = f"CAST(greatest(1, ceil(-greatest(1, count(DISTINCT user_id)) * ln(CAST({RATE} AS DOUBLE)) / ln(CAST(2 AS DOUBLE)) ** 2)) AS BIGINT)"


def _bloom(spark: SparkSession, sf_dir: str, partitioned: bool) -> DataFrame:
    members = _EVEN(spark, sf_dir)
    size, k = _size(members, "user_id")
    filter_ = K.bloom(members, "user_id", k, size, partitioned, K.h3_positions)
    return K.confusion(K.bloom_contains(filter_, R.events(spark, sf_dir), "user_id", k, size, partitioned, K.h3_positions), members, "user_id")


def _bloom_sql(partitioned: bool) -> str:
    cells = _cells_sql("every", "(SELECT m FROM sized)", HASHES, partitioned)
    return f"""WITH every AS (SELECT DISTINCT user_id AS item FROM events), sized AS (SELECT {_SIZE_SQL} AS m FROM events WHERE user_id % 2 = 0),
        placed AS MATERIALIZED ({cells}), bits AS (SELECT DISTINCT cell FROM placed WHERE item % 2 = 0),
        told AS (SELECT item, bool_and(bits.cell IS NOT NULL) AS found FROM placed LEFT JOIN bits USING (cell) GROUP BY 1)
        SELECT count(*) FILTER (WHERE found AND item % 2 = 0) AS tp, count(*) FILTER (WHERE found AND item % 2 = 1) AS fp, count(*) FILTER (WHERE NOT found AND item % 2 = 0) AS fn, count(*) FILTER (WHERE NOT found AND item % 2 = 1) AS tn FROM told"""


R.add("bloom_members", "tp:l fp:l fn:l tn:l", lambda s, d: _bloom(s, d, False), _bloom_sql(False))
R.add("bloom_members_partitioned", "tp:l fp:l fn:l tn:l", lambda s, d: _bloom(s, d, True), _bloom_sql(True))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of the even users at several rates, weighed by how often each user is asked for."""
    members = _EVEN(spark, sf_dir)
    n = max(1, members.select("user_id").distinct().count())
    return K.trials(members, R.events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n")), "user_id", n, [0.3, 0.1, 0.01], K.h3_positions)


def _trial_sql(rate: float) -> str:
    k = K.bloom_hashes(K.bloom_size(rate, 10_000), 10_000)
    size = _SIZE_SQL.replace(str(RATE), str(rate))
    return f"""SELECT * FROM (WITH every AS (SELECT user_id AS item, count(*) AS n FROM events GROUP BY 1), sized AS (SELECT {size} AS m FROM events WHERE user_id % 2 = 0),
        placed AS MATERIALIZED ({_cells_sql("every", "(SELECT m FROM sized)", k)}), bits AS (SELECT DISTINCT cell FROM placed WHERE item % 2 = 0),
        told AS (SELECT item, bool_and(bits.cell IS NOT NULL) AS found FROM placed LEFT JOIN bits USING (cell) GROUP BY 1)
        SELECT CAST({rate} AS DOUBLE) AS fp_rate, (SELECT m FROM sized) AS bits, {k} AS k, coalesce(sum(n) FILTER (WHERE found AND item % 2 = 0), 0) AS tp, coalesce(sum(n) FILTER (WHERE found AND item % 2 = 1), 0) AS fp, coalesce(sum(n) FILTER (WHERE NOT found AND item % 2 = 0), 0) AS fn, coalesce(sum(n) FILTER (WHERE NOT found AND item % 2 = 1), 0) AS tn FROM told JOIN every USING (item))"""


R.add("bloom_trials", "fp_rate:d bits:l k:l tp:l fp:l fn:l tn:l", _trials, " UNION ALL ".join(map(_trial_sql, (0.3, 0.1, 0.01))))

#: Counters that a counting filter of the users has: few, so that estimates show collisions.
COUNTERS, COUNTING_HASHES = 211, 3


def _counting(spark: SparkSession, sf_dir: str, removed: bool) -> DataFrame:
    every = R.events(spark, sf_dir)
    made = K.counting(every, "user_id", COUNTING_HASHES, COUNTERS, 40, K.h3_positions)
    if removed:
        made = K.counting_remove(made, _EVEN(spark, sf_dir), "user_id", COUNTING_HASHES, COUNTERS, 40, K.h3_positions)
    return K.counting_lookup(made, every, "user_id", COUNTING_HASHES, COUNTERS, K.h3_positions)


def _counting_sql(removed: bool) -> str:
    return f"""WITH every AS (SELECT user_id AS item, count(*) AS n FROM events GROUP BY 1), placed AS MATERIALIZED (SELECT DISTINCT * FROM ({_cells_sql("every", str(COUNTERS), COUNTING_HASHES)})),
        counters AS (SELECT cell, sum(n) FILTER (WHERE {"item % 2 = 1" if removed else "true"}) AS c FROM placed JOIN every USING (item) GROUP BY 1)
        SELECT item AS user_id, min(coalesce(c, 0)) AS estimate FROM placed JOIN counters USING (cell) GROUP BY 1"""


R.add("counting_estimates", "user_id:l estimate:l", lambda s, d: _counting(s, d, False), _counting_sql(False))
R.add("counting_after_removal", "user_id:l estimate:l", lambda s, d: _counting(s, d, True), _counting_sql(True))
R.add("h3_hashes", "user_id:l h:l", lambda s, d: R.events(s, d).select("user_id").distinct().select("user_id", K.h3(F.col("user_id") * 1_000_003 - 77, 9).alias("h")), f"SELECT user_id, {h3_sql('(user_id * 1000003 - 77)', 9)} AS h FROM (SELECT DISTINCT user_id FROM events)")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit vectors of the event's and the user's numbers, and what the algebra makes of them."""
    v = R.events(spark, sf_dir).select("event_id", bits.from_number(F.col("event_id"), 20).alias("a"), bits.from_number(F.col("user_id") * 5, 20).alias("b"))
    a, b = F.col("a"), F.col("b")
    made = {
        "inverted": bits.inverted(a), "anded": bits.both(a, b), "ored": bits.either(a, b), "xored": bits.differing(a, b), "minus": bits.minus(a, b), "up": bits.shifted_up(a, 3), "down": bits.shifted_down(a, 4),
        "wider": bits.resized(a, 24), "narrower": bits.resized(a, 7), "appended": bits.appended(a, b), "with_bit": bits.with_bit(a, 11), "flipped": bits.flipped(a, 2),
    }
    return v.select("event_id", *(bits.text(c).alias(n) for n, c in made.items()), bits.count(a).alias("ones"), bits.find(a).alias("first"), bits.find(a, 4).alias("next"), bits.less(a, b).alias("less"), bits.to_number(a).alias("number"))


_BITS = lambda x, n=20: f"right(bin({x}), {n})" if n < 1 else f"lpad(right(bin({x}), {n}), {n}, '0')"
_ALL = (1 << 20) - 1
R.add("bit_vectors", "event_id:l inverted:s anded:s ored:s xored:s minus:s up:s down:s wider:s narrower:s appended:s with_bit:s flipped:s ones:l first:l next:l less:b number:l", _vectors, f"""
    SELECT event_id, {_BITS(f"({_ALL} - a)")} AS inverted, {_BITS("(a & b)")} AS anded, {_BITS("(a | b)")} AS ored, {_BITS("xor(a, b)")} AS xored, {_BITS(f"(a & ({_ALL} - b))")} AS minus, {_BITS(f"((a << 3) & {_ALL})")} AS up, {_BITS("(a >> 4)")} AS down,
    {_BITS("a", 24)} AS wider, {_BITS("(a & 127)", 7)} AS narrower, {_BITS("b")} || {_BITS("a")} AS appended, {_BITS("(a | 2048)")} AS with_bit, {_BITS("xor(a, CAST(4 AS BIGINT))")} AS flipped,
    bit_count(a) AS ones, CASE WHEN a = 0 THEN -1 ELSE bit_count(xor(a, a - 1)) - 1 END AS first, CASE WHEN a >> 5 = 0 THEN -1 ELSE bit_count(xor(a >> 5, (a >> 5) - 1)) + 4 END AS next, a < b AS less, a AS number
    FROM (SELECT event_id, event_id & {_ALL} AS a, (user_id * 5) & {_ALL} AS b FROM events)""")

# Key stores and static tables: keys that are there and keys that are not, from the whole table.
_ITEMS = lambda s, d: R.events(s, d).select(F.col("event_id").alias("key"), F.col("user_id").alias("item"))
_KEYS = lambda s, d: _ITEMS(s, d).select((F.col("key") * 7 + 3).alias("key"))
R.add("key_lookup", "key:l item:l", lambda s, d: stores.get(_ITEMS(s, d), _KEYS(s, d)), "SELECT event_id AS key, user_id AS item FROM events WHERE event_id IN (SELECT event_id * 7 + 3 FROM events)")
R.add("static_lookup", "key:l item:l", lambda s, d: K.static_lookup(_ITEMS(s, d), _KEYS(s, d)), "SELECT k AS key, user_id AS item FROM (SELECT event_id * 7 + 3 AS k FROM events) LEFT JOIN events ON event_id = k")
R.add("xor_table_members", "key:l item:l", lambda s, d: K.xor_lookup(_ITEMS(s, d), _ITEMS(s, d)).where("found").select("key", "item"), "SELECT event_id AS key, user_id AS item FROM events")


def _workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key store under mixed work: lookups that hit, lookups that miss, inserts, updates, deletes, and lookups of keys
    that few are asked for very often."""
    store = _ITEMS(spark, sf_dir).where("key % 4 <> 1")
    work = _ITEMS(spark, sf_dir)
    new, gone = work.where("key % 4 = 1 and key % 3 = 0"), work.where("key % 10 = 0")
    changed = stores.delete(stores.put(store, new), gone)
    asked = {"hit": work.where("key % 4 = 2").select("key"), "miss": work.select((F.col("key") * -1 - 1).alias("key")), "inserted": new.select("key"), "deleted": gone.select("key")}
    out = None
    for name, keys in asked.items():
        one = keys.join(changed, "key", "left").agg(F.lit(name).alias("work"), F.count("*").alias("asked"), F.count("item").alias("found"))
        out = one if out is None else out.union(one)
    often = R.events(spark, sf_dir).select((F.col("user_id") % 13).alias("key"))
    return out.union(often.groupBy("key").agg(F.count("*").alias("n")).join(changed, "key", "left").agg(F.lit("skewed"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("item").isNotNull(), F.col("n"))), F.lit(0))))


R.add("key_workload", "work:s asked:l found:l", _workload, """WITH c AS (SELECT event_id AS key FROM events WHERE (event_id % 4 <> 1 OR event_id % 3 = 0) AND event_id % 10 <> 0), a AS (
    SELECT 'hit' AS work, event_id AS key FROM events WHERE event_id % 4 = 2 UNION ALL SELECT 'miss', -event_id - 1 FROM events UNION ALL SELECT 'inserted', event_id FROM events WHERE event_id % 4 = 1 AND event_id % 3 = 0 UNION ALL SELECT 'deleted', event_id FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'skewed', user_id % 13 FROM events)
    SELECT work, count(*) AS asked, count(c.key) AS found FROM a LEFT JOIN c ON c.key = a.key GROUP BY 1""")

_MIX = lambda x, seed: f"(xor((({x} % {stores.PRIME}) * {stores.STEP} + {seed * 7919 + 1}) % {stores.PRIME}, ((({x} % {stores.PRIME}) * {stores.STEP} + {seed * 7919 + 1}) % {stores.PRIME}) >> 13) * {stores.STEP} % {stores.PRIME}) / CAST({stores.PRIME} AS DOUBLE)"
R.add("uniform_keys", "id:l key:l", lambda s, d: stores.uniform_keys(s, 20000, 1000, 3), f"SELECT i AS id, CAST(floor({_MIX('i', 3)} * 1000) AS BIGINT) AS key FROM range(20000) t(i)")
R.add("zipf_keys", "key:l n:l", lambda s, d: stores.zipf_keys(s, 20000, 1000).groupBy("key").agg(F.count("*").alias("n")), f"SELECT least(CAST(floor(pow({_MIX('i', 1)} * (pow(CAST(1001 AS DOUBLE), CAST({1.0 - 0.8} AS DOUBLE)) - 1) + 1, CAST({1.0 / (1.0 - 0.8)} AS DOUBLE))) AS BIGINT), 1000) AS key, count(*) AS n FROM range(20000) t(i) GROUP BY 1")
