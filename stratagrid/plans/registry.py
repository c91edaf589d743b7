"""The engine's queries by name, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.functions import cells, clock, cover, crypto, grid
from stratagrid.operators import buckets as B
from stratagrid.operators import emm, joins, metrics, schemes, sketches, truth
from stratagrid.plans import oracle as O
from stratagrid.plans import workload
from stratagrid.sources import stores
from stratagrid.sources.points import event_points, query_boxes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KINDS = {"l": ("bigint", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN")}


def add(name: str, columns: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    """Registers a query. ``columns``: 'name:kind ...' with kinds l, d, s, b, the types on both sides."""
    told = [c.split(":") for c in columns.split()]
    QUERIES[name] = lambda spark, sf_dir: run(spark, sf_dir).select(*(F.col(n).cast(KINDS[k][0]).alias(n) for n, k in told))
    if sql is not None:
        ORACLES[name] = f"{O.PRELUDE} SELECT {', '.join(f'CAST({n} AS {KINDS[k][1]}) AS {n}' for n, k in told)} FROM ({sql})"


def boxes(spark: SparkSession) -> DataFrame:
    return query_boxes(spark, O.BOXES)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, truth and false positives of every query box under the slot scheme."""
    return QUERIES["metrics_slot"](spark, sf_dir)


PAIR = "query_id:l record_id:l"
ONE = O.BOXES[0]

# Truth, bounds, windows.
add("box_truth", "record_id:l ts:l lat:d lon:d", lambda s, d: event_points(s, d, ONE[1], ONE[2]).where(truth.inside(ONE[1:])), "SELECT * FROM p WHERE ts BETWEEN 1704500000 AND 1705500000 AND lat BETWEEN -10 AND 60 AND lon BETWEEN -50 AND 100")
add("box_truth_batch", PAIR, lambda s, d: truth.batch_truth(event_points(s, d), boxes(s)), "SELECT * FROM truth")
add("point_bounds", "ts_min:l ts_max:l lat_min:d lat_max:d lon_min:d lon_max:d lat_pad:d lon_pad:d", lambda s, d: truth.bounds(event_points(s, d)), "SELECT t0 AS ts_min, t1 AS ts_max, a AS lat_min, b AS lat_max, c AS lon_min, d AS lon_max, greatest(1e-6, (b - a) * CAST(0.001 AS DOUBLE)) AS lat_pad, greatest(1e-6, (d - c) * CAST(0.001 AS DOUBLE)) AS lon_pad FROM b")
add("default_window", "record_id:l q_s:l q_e:l q_lat_min:d q_lat_max:d q_lon_min:d q_lon_max:d", lambda s, d: truth.default_window(event_points(s, d)), """
    SELECT record_id, CAST(floor(ts / CAST(86400 AS DOUBLE)) AS BIGINT) * 86400 AS q_s, CAST(floor(ts / CAST(86400 AS DOUBLE)) AS BIGINT) * 86400 + 86399 AS q_e,
    greatest(a, lat - (b - a) * CAST(0.02 AS DOUBLE)) AS q_lat_min, least(b, lat + (b - a) * CAST(0.02 AS DOUBLE)) AS q_lat_max, greatest(c, lon - (d - c) * CAST(0.02 AS DOUBLE)) AS q_lon_min, least(d, lon + (d - c) * CAST(0.02 AS DOUBLE)) AS q_lon_max
    FROM (SELECT *, row_number() OVER (ORDER BY record_id) AS k FROM p), b WHERE k = (SELECT count(*) // 2 + 1 FROM p)""")

# Time.
add("time_slots", "record_id:l day:l slot:l abs_slot:l attribute:l slot_key:s", lambda s, d: event_points(s, d).join(F.broadcast(truth.bounds(event_points(s, d)).select("ts_min"))).select(
    "record_id", clock.day_start(F.col("ts")).alias("day"), clock.slot_in_day(F.col("ts")).alias("slot"), clock.abs_slot(F.col("ts")).alias("abs_slot"), clock.interval_attribute(F.col("ts"), clock.day_start(F.col("ts_min"))).alias("attribute"),
    clock.day_slot_key(clock.day_start(F.col("ts")), clock.slot_in_day(F.col("ts"))).alias("slot_key")),
    "SELECT record_id, dp.day * 86400 AS day, slot, CAST(floor(ts / CAST(600 AS DOUBLE)) AS BIGINT) AS abs_slot, (dp.day - CAST(floor(t0 / CAST(86400 AS DOUBLE)) AS BIGINT)) * 144 + slot AS attribute, 'utctimestamp' || (dp.day * 86400) || '_' || slot AS slot_key FROM dp JOIN p USING (record_id), b")
add("time_texts", "record_id:l parsed:l midnight:l", lambda s, d: events(s, d).select(
    F.col("event_id").alias("record_id"), clock.text_seconds(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit("+00"))).alias("parsed"), clock.date_seconds(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")).alias("midnight")),
    "SELECT record_id, ts AS parsed, CAST(floor(ts / CAST(86400 AS DOUBLE)) AS BIGINT) * 86400 AS midnight FROM p")

# Grid, covers, cells.
add("grid_points", "record_id:l x:l y:l z:l", lambda s, d: schemes.grid_points(event_points(s, d)), "SELECT * FROM g")
add("grid_cell_groups", "x:l y:l z:l n:l", lambda s, d: schemes.grid_points(event_points(s, d)).groupBy("x", "y", "z").agg(F.count("*").alias("n")), "SELECT x, y, z, count(*) AS n FROM g GROUP BY 1, 2, 3")
add("grid_boxes", "query_id:l x0:l x1:l x2:l y0:l y1:l y2:l z0:l z1:l z2:l", lambda s, d: schemes.grid_boxes(event_points(s, d), boxes(s)), "SELECT * FROM gq")


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = schemes.grid_boxes(event_points(spark, sf_dir), boxes(spark))
    a, b = g.alias("a"), g.alias("b")
    box = lambda t: [(F.col(f"{t}.{c}0"), F.col(f"{t}.{c}2")) for c in "xyz"]
    met = a.join(F.broadcast(b), F.col("a.query_id") <= F.col("b.query_id"))
    return met.select(F.col("a.query_id").alias("one"), F.col("b.query_id").alias("two"), grid.contains_box(box("a"), box("b")).alias("holds"), grid.contains_box(box("a"), box("b"), 1).alias("holds_slack"), grid.intersects(box("a"), box("b")).alias("meets"), grid.contains_point(box("a"), [F.col(f"b.{c}0") for c in "xyz"]).alias("holds_start"), grid.contains_range(F.col("a.x0"), F.col("a.x1"), F.col("b.x0"), F.col("b.x1")).alias("holds_time"))


_AXES = lambda text, glue=" AND ": glue.join(text.replace("?", c) for c in "xyz")
add("box_relations", "one:l two:l holds:b holds_slack:b meets:b holds_start:b holds_time:b", _relations, f"""SELECT a.query_id AS one, b2.query_id AS two, {_AXES("a.?0 <= b2.?0 AND b2.?2 <= a.?2")} AS holds, {_AXES("a.?0 <= b2.?0 AND b2.?2 <= a.?2 + 1")} AS holds_slack,
    {_AXES("a.?0 < b2.?2 AND b2.?0 < a.?2 AND a.?0 < a.?2 AND b2.?0 < b2.?2")} AS meets, {_AXES("a.?0 <= b2.?0 AND b2.?0 < a.?2")} AS holds_start, a.x0 <= b2.x0 AND b2.x1 <= a.x1 AS holds_time FROM gq a JOIN gq b2 ON a.query_id <= b2.query_id""")
add("dyadic_paths", "v:l lo:l hi:l", lambda s, d: schemes.grid_points(event_points(s, d)).select(F.col("x").alias("v")).distinct().select("v", F.explode(cover.dyadic_path(F.col("v"), 7)).alias("r")).select("v", "r.*"), "SELECT v, lo, hi FROM path WHERE v IN (SELECT x FROM g)")
add("dyadic_covers", "a:l b:l lo:l hi:l", lambda s, d: s.range(128).select(F.col("id").alias("a")).select("a", F.explode(F.sequence("a", F.lit(127).cast("bigint"))).alias("b")).select("a", "b", cover.dyadic_cover(F.col("a"), F.col("b")).alias("c")).select("a", "b", "c.*"), f"SELECT a, b, {O.cover_lo('a', 'b')} AS lo, {O.cover_hi('a', 'b')} AS hi FROM (SELECT a, b FROM range(128) t(a), range(128) u(b) WHERE a <= b)")
add("dyadic_label_counts", "x:l y:l z:l n:l labels:l", lambda s, d: schemes.dyadic_label_counts(event_points(s, d)), "WITH c AS (SELECT v, count(*) AS n FROM path GROUP BY v) SELECT k.*, cx.n * cy.n * cz.n AS labels FROM (SELECT x, y, z, count(*) AS n FROM g GROUP BY 1, 2, 3) k JOIN c cx ON cx.v = x JOIN c cy ON cy.v = y JOIN c cz ON cz.v = z")
add("dyadic_postings", "query_id:l label:s record_id:l", lambda s, d: schemes.dyadic_postings(event_points(s, d), boxes(s)), "SELECT query_id, xl || ',' || xh || '|' || yl || ',' || yh || '|' || zl || ',' || zh AS label, record_id FROM dyadic_grid_cand JOIN gc USING (query_id)")
add("staggered_postings", "w:l x:l y:l z:l n:l", lambda s, d: schemes.staggered_postings(event_points(s, d)), """
    WITH axis AS (SELECT v, w, s FROM range(128) t(v), (SELECT w, unnest(CASE WHEN w = 1 THEN range(128) WHEN w = 128 THEN [0] ELSE range(0, 128 - w + 1, w // 2) END) AS s FROM (SELECT w FROM widths UNION ALL SELECT 128)) WHERE v >= s AND v < s + w)
    SELECT ax.w, ax.s AS x, ay.s AS y, az.s AS z, sum(n) AS n FROM (SELECT x AS px, y AS py, z AS pz, count(*) AS n FROM g GROUP BY 1, 2, 3) JOIN axis ax ON ax.v = px JOIN axis ay ON ay.v = py AND ay.w = ax.w JOIN axis az ON az.v = pz AND az.w = ax.w GROUP BY 1, 2, 3, 4""")
add("staggered_stats", "w:l cubes:l postings:l longest:l mean:d", lambda s, d: schemes.posting_stats(schemes.staggered_postings(event_points(s, d))), "SELECT w, count(*) AS cubes, sum(n) AS postings, max(n) AS longest, round(avg(n), 6) AS mean FROM (" + ORACLES["staggered_postings"].removeprefix(O.PRELUDE) + ") GROUP BY w")
add("staggered_covers", "query_id:l w:l x:l y:l z:l", lambda s, d: schemes.staggered_covers(event_points(s, d), boxes(s)), "SELECT * FROM stag")


def _bounds4(spark: SparkSession, sf_dir: str) -> tuple[float, float, float, float]:
    r = truth.bounds(event_points(spark, sf_dir)).first()
    return (r.lat_min, r.lat_max, r.lon_min, r.lon_max)


_CELL_LEVELS = " UNION ALL ".join(f"SELECT record_id, {k} AS level, {O.cell('lat', 'a', 'b', k)} AS ix, {O.cell('lon', 'c', 'd', k)} AS iy FROM p, b" for k in range(1, 9))
add("point_cells", "record_id:l level:l ix:l iy:l", lambda s, d: event_points(s, d).select("record_id", F.explode(cells.point_cells(F.col("lat"), F.col("lon"), _bounds4(s, d), 8)).alias("c")).select("record_id", "c.*"), _CELL_LEVELS)


def _query_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = _bounds4(spark, sf_dir)
    rows = [(b[0], *c) for b in O.BOXES for c in cells.query_cells(b[3:], bounds, 8)]
    return spark.createDataFrame(rows, "query_id int, level int, ix int, iy int")


add("query_cells", "query_id:l level:l ix:l iy:l", _query_cells, """
    WITH c AS (SELECT query_id, l AS level, ix, iy FROM q8, range(1, 9) t(l), LATERAL (SELECT unnest(generate_series(x0 >> (8 - l), x1 >> (8 - l))) AS ix), LATERAL (SELECT unnest(generate_series(y0 >> (8 - l), y1 >> (8 - l))) AS iy)),
    i AS (SELECT c.*, (ix << (8 - level)) >= x0 AND ((ix + 1) << (8 - level)) - 1 <= x1 AND (iy << (8 - level)) >= y0 AND ((iy + 1) << (8 - level)) - 1 <= y1 AS inside,
        level > 1 AND ((ix >> 1) << (9 - level)) >= x0 AND (((ix >> 1) + 1) << (9 - level)) - 1 <= x1 AND ((iy >> 1) << (9 - level)) >= y0 AND (((iy >> 1) + 1) << (9 - level)) - 1 <= y1 AS covered FROM c JOIN q8 USING (query_id))
    SELECT query_id, level, ix, iy FROM i WHERE inside AND NOT covered""")

# Buckets, slots, days.
_bucketed = lambda s, d: B.with_buckets(event_points(s, d))
add("adaptive_buckets", "bucket_id:l start_ts:l end_ts:l start_slot:l end_slot:l n:l n_slots:l next_bucket:l", lambda s, d: B.bucket_table(_bucketed(s, d)), "SELECT * FROM bt")
add("record_buckets", "record_id:l abs_slot:l bucket_id:l", _bucketed, "SELECT * FROM bp")
add("bucket_slots", "bucket_id:l abs_slot:l local_slot:l n:l key:s", lambda s, d: B.bucket_slots(_bucketed(s, d)).withColumn("key", clock.slot_key(F.col("bucket_id"), F.col("local_slot"))), "SELECT *, 'bucket_' || bucket_id || '_slot_' || local_slot AS key FROM bs")
add("bucket_local_ranges", "query_id:l bucket_id:l lo:l hi:l", lambda s, d: B.local_ranges(_bucketed(s, d), boxes(s)), "SELECT * FROM lr")
add("bucket_stats", "n_buckets:l n_records:l max_records:l avg_records:d max_slots:l avg_slots:d metadata_bytes:l", lambda s, d: B.bucket_stats(B.bucket_table(_bucketed(s, d))), "SELECT count(*) AS n_buckets, sum(n) AS n_records, max(n) AS max_records, round(avg(n), 6) AS avg_records, max(n_slots) AS max_slots, round(avg(n_slots), 6) AS avg_slots, sum(48 + n_slots * 16) AS metadata_bytes FROM bt")
add("bucket_touched", "query_id:l bucket_id:l", lambda s, d: B.touched(B.bucket_table(_bucketed(s, d)), boxes(s)), "SELECT query_id, bucket_id FROM tq")
add("bucket_located", "ts:l bucket_id:l", lambda s, d: B.locate(B.bucket_table(_bucketed(s, d)), boxes(s).select(F.col("s").alias("ts"))), "SELECT s AS ts, min(bucket_id) AS bucket_id FROM (SELECT DISTINCT s FROM q) LEFT JOIN bt ON end_ts >= CAST(floor(s / CAST(600 AS DOUBLE)) * 600 AS BIGINT) GROUP BY s")
add("bucket_edges", "pair:l side:s record_id:l", lambda s, d: workload.edge_records(event_points(s, d)), "SELECT bucket_id AS pair, 'left' AS side, record_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY ts DESC, record_id DESC) AS r FROM bp) WHERE r <= 100 AND bucket_id < (SELECT max(bucket_id) FROM bt) UNION ALL SELECT bucket_id - 1, 'right', record_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY ts, record_id) AS r FROM bp) WHERE r <= 100 AND bucket_id > 0")
add("day_index", "query_id:l first_day:l last_day:l n_days:l n_records:l", lambda s, d: event_points(s, d).groupBy(clock.floor_div(F.col("ts"), clock.DAY_SECONDS).alias("day")).agg(F.count("*").alias("n")).join(F.broadcast(boxes(s)), F.expr("day between floor(s / 86400.0) and floor(e / 86400.0)")).groupBy("query_id").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days"), F.sum("n").alias("n_records")), "SELECT query_id, min(dp.day) AS first_day, max(dp.day) AS last_day, count(DISTINCT dp.day) AS n_days, count(*) AS n_records FROM dp JOIN dq ON dq.day = dp.day GROUP BY query_id")

# Candidates of every scheme, and how exact they are.
for _name, _scheme in schemes.SCHEMES.items():
    add(f"candidates_{_name}", PAIR, lambda s, d, f=_scheme: f(event_points(s, d), boxes(s)), f"SELECT query_id, record_id FROM {_name}_cand")
    add(f"metrics_{_name}", "query_id:l n_candidates:l n_truth:l tp:l fp:l fn:l fp_rate:d superset:b", lambda s, d, f=_scheme: metrics.accuracy(f(event_points(s, d), boxes(s)), truth.batch_truth(event_points(s, d), boxes(s)), boxes(s)), f"""
        SELECT query_id, nc AS n_candidates, nt AS n_truth, tp, nc - tp AS fp, nt - tp AS fn, CASE WHEN nc > 0 THEN round((nc - tp) / CAST(nc AS DOUBLE), 9) ELSE 0 END AS fp_rate, nt = tp AS superset FROM (
        SELECT q.query_id, (SELECT count(DISTINCT record_id) FROM {_name}_cand c WHERE c.query_id = q.query_id) AS nc, (SELECT count(*) FROM truth t WHERE t.query_id = q.query_id) AS nt,
        (SELECT count(*) FROM truth t WHERE t.query_id = q.query_id AND t.record_id IN (SELECT record_id FROM {_name}_cand c WHERE c.query_id = q.query_id)) AS tp FROM q)""")
add("slot_refined", PAIR, lambda s, d: schemes.slot_candidates(event_points(s, d), boxes(s)).join(event_points(s, d), "record_id").join(F.broadcast(boxes(s)), "query_id").where(truth.in_box()), "SELECT * FROM truth")
add("slot_false_positives", PAIR, lambda s, d: metrics.false_positives(schemes.slot_candidates(event_points(s, d), boxes(s)), truth.batch_truth(event_points(s, d), boxes(s))), "SELECT * FROM slot_cand EXCEPT SELECT * FROM truth")
add("two_level_ranges", "query_id:l lo:l hi:l", lambda s, d: schemes.merged_position_ranges(schemes.position_index(schemes.grid_points(event_points(s, d)), F.col("x")), schemes.two_level_spans(event_points(s, d), boxes(s))), "SELECT * FROM tl_ranges")

# Encrypted multimap.


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records under the slot they lie in."""
    return event_points(spark, sf_dir).select(clock.day_slot_key(clock.day_start(F.col("ts")), clock.slot_in_day(F.col("ts"))).alias("label"), "record_id")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = schemes._days(boxes(spark))
    each = q.select("query_id", "day", F.explode(F.sequence("lo", "hi")).alias("slot"))
    return each.select("query_id", clock.day_slot_key(F.col("day") * clock.DAY_SECONDS, F.col("slot")).alias("label"))


_LABEL = "'utctimestamp' || (day * 86400) || '_' || slot"
add("emm_tokens", "token:s n:l", lambda s, d: emm.token_counts(_postings(s, d)), f"SELECT sha256('token-key' || label) AS token, n FROM (SELECT {_LABEL} AS label, count(*) AS n FROM dp GROUP BY 1)")
add("emm_labels", "ct_label:s", lambda s, d: emm.build(_postings(s, d)).select(F.lower(F.hex("ct_label")).alias("ct_label")), f"SELECT sha256(sha256('token-key' || label) || i) AS ct_label FROM (SELECT {_LABEL} AS label, row_number() OVER (PARTITION BY day, slot ORDER BY record_id) - 1 AS i FROM dp)")
add("emm_roundtrip", PAIR, lambda s, d: emm.EncryptedStore(_postings(s, d)).query(_asked(s, d)), "SELECT query_id, record_id FROM dp JOIN dq ON dq.day = dp.day AND slot BETWEEN lo AND hi")
add("emm_storage", "entries:l label_bytes:l value_bytes:l", lambda s, d: emm.EncryptedStore(_postings(s, d)).size(), "SELECT count(*) AS entries, count(*) * 32 AS label_bytes, sum((length(CAST(record_id AS VARCHAR)) // 16 + 1) * 16) AS value_bytes FROM dp")
add("emm_json_sink", "ct_label:s ct_value_bytes:l", lambda s, d: _json_roundtrip(s, d), f"SELECT sha256(sha256('token-key' || label) || i) AS ct_label, 16 AS ct_value_bytes FROM (SELECT {_LABEL} AS label, row_number() OVER (PARTITION BY day, slot ORDER BY record_id) - 1 AS i FROM dp)")


def _json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index through the JSON sink's text and back, without a file."""
    index = emm.build(_postings(spark, sf_dir)).select(F.to_json(F.struct(F.base64("ct_label").alias("ct_label"), F.base64("ct_value").alias("ct_value"))).alias("j"))
    back = index.select(F.from_json("j", "ct_label string, ct_value string").alias("r"))
    return back.select(F.lower(F.hex(F.unbase64("r.ct_label"))).alias("ct_label"), F.length(F.unbase64("r.ct_value")).alias("ct_value_bytes"))


# Keyword-restricted joins: table 1 is the events, table 2 says which users have an event of a type.
_KEYWORDS = [(b[0], *b[1:], ["click", "purchase", "view", "signup"][k % 4]) for k, b in enumerate(O.BOXES)]


def _keyword_boxes(spark: SparkSession) -> DataFrame:
    return boxes(spark).join(F.broadcast(spark.createDataFrame([(b[0], b[-1]) for b in _KEYWORDS], "query_id int, keyword string")), "query_id")


def _table2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("value > 50").select(F.col("user_id").alias("join_key"), F.col("event_type").alias("keyword"))


def _time_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The time side: records under the slot of their time, and the slots that the boxes ask for, as far as the records'
    times reach."""
    points = event_points(spark, sf_dir)
    rows = points.select(clock.abs_slot(F.col("ts")).alias("keyword"), "join_key", "record_id")
    q = _keyword_boxes(spark).join(F.broadcast(truth.bounds(points).select("ts_min", "ts_max"))).where("e >= ts_min and s <= ts_max")
    slots = F.sequence(clock.abs_slot(F.greatest("s", "ts_min")), clock.abs_slot(F.least("e", "ts_max")))
    return rows, q.select("query_id", F.col("keyword").alias("keyword2"), F.explode(slots).alias("keyword"))


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _time_rows(spark, sf_dir)
    return joins.masked_join(joins.build_masked(rows), joins.build_keys(_table2(spark, sf_dir)), asked)


_KW = ", ".join(f"({b[0]}, '{b[-1]}')" for b in _KEYWORDS)
_TIME_SIDE = f"SELECT DISTINCT q.query_id, record_id FROM p JOIN q ON CAST(floor(ts / CAST(600 AS DOUBLE)) AS BIGINT) BETWEEN CAST(floor(s / CAST(600 AS DOUBLE)) AS BIGINT) AND CAST(floor(e / CAST(600 AS DOUBLE)) AS BIGINT) JOIN (VALUES {_KW}) k(query_id, kw) ON k.query_id = q.query_id WHERE (join_key, kw) IN (SELECT (join_key, keyword) FROM p WHERE value > 50)"
add("keyword_semijoin", PAIR, lambda s, d: joins.keyword_semijoin(event_points(s, d), _table2(s, d), _keyword_boxes(s)), f"SELECT truth.query_id, record_id FROM truth JOIN p USING (record_id) JOIN (VALUES {_KW}) k(query_id, kw) ON k.query_id = truth.query_id WHERE (join_key, kw) IN (SELECT (join_key, keyword) FROM p WHERE value > 50)")
add("keyword_masked_join", PAIR, _masked, _TIME_SIDE)
add("keyword_token_counts", "keyword:s n:l", lambda s, d: joins.token_counts(_table2(s, d).distinct()), "SELECT keyword, count(*) AS n FROM (SELECT DISTINCT keyword, join_key FROM p WHERE value > 50) GROUP BY 1")
add("id_range", "record_id:l ts:l", lambda s, d: joins.id_range(event_points(s, d), 100, 899), "SELECT * FROM p WHERE record_id BETWEEN 100 AND 899")
add("stripped_values", "record_id:l value:s", lambda s, d: events(s, d).select(F.col("event_id").alias("record_id"), joins.strip_prefix(F.concat(F.lit("user="), F.col("user_id")), "user").alias("value")), "SELECT record_id, CAST(join_key AS VARCHAR) AS value FROM p")

# Workload.
add("cell_density", "cell_x:l cell_y:l n:l", lambda s, d: workload.density(event_points(s, d)).groupBy("cell_x", "cell_y").agg(F.count("*").alias("n")), "SELECT cell_x, cell_y, count(*) AS n FROM dens0 GROUP BY 1, 2")
_INSIDE = "SELECT dens.record_id, dens.ts, dens.lat, dens.lon, bt.bucket_id, cell_x, cell_y, cell_count, CAST(2 * least(dens.ts - start_ts, end_ts - dens.ts) AS DOUBLE) AS widest, least(CAST(3600 AS DOUBLE), CAST(2 * least(dens.ts - start_ts, end_ts - dens.ts) AS DOUBLE) / 16 * CAST(0.98 AS DOUBLE)) AS base_seconds, bt.n FROM dens JOIN bp USING (record_id) JOIN bt ON bt.bucket_id = bp.bucket_id"
_IN_ORDER = "cell_count DESC, widest DESC, n DESC, ts, record_id"
_INSIDE_SQL = f"SELECT * FROM (SELECT *, row_number() OVER (ORDER BY again, {_IN_ORDER}) AS pick FROM (SELECT * FROM (SELECT *, 0 AS again FROM (SELECT *, row_number() OVER (PARTITION BY cell_x, cell_y, bucket_id ORDER BY {_IN_ORDER}) AS k FROM ({_INSIDE}) WHERE widest > 0 AND base_seconds >= 60) WHERE k = 1 ORDER BY {_IN_ORDER} LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 1 AS k, 1 AS again FROM ({_INSIDE}) WHERE widest > 0 AND base_seconds >= 60 ORDER BY {_IN_ORDER} LIMIT 10))) WHERE pick <= 10"
add("inside_centres", "record_id:l bucket_id:l cell_count:l widest:d base_seconds:d", lambda s, d: workload.inside_centres(event_points(s, d)).withColumn("base_seconds", F.round("base_seconds", 6)), f"SELECT record_id, bucket_id, cell_count, widest, round(base_seconds, 6) AS base_seconds FROM ({_INSIDE_SQL})")
_ACROSS_SQL = """SELECT record_id, ts, lat, lon, pair AS bucket_id, cell_count, away, greatest(CAST(7200 AS DOUBLE), gap + CAST(1200 AS DOUBLE), away * 2 + CAST(1200 AS DOUBLE)) AS base_seconds FROM (
    SELECT *, row_number() OVER (PARTITION BY pair ORDER BY cell_count DESC, away, ts, record_id) AS k FROM (
    SELECT dens.record_id, dens.ts, dens.lat, dens.lon, cell_count, pair, gap, pair_n, abs(dens.ts - border) AS away FROM dens JOIN (
        SELECT bucket_id AS pair, record_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY ts DESC, record_id DESC) AS r FROM bp) WHERE r <= 100
        UNION ALL SELECT bucket_id - 1, record_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY ts, record_id) AS r FROM bp) WHERE r <= 100) near ON near.record_id = dens.record_id
    JOIN (SELECT bucket_id AS pair, (end_ts + lead(start_ts) OVER w) / CAST(2 AS DOUBLE) AS border, greatest(0, lead(start_ts) OVER w - end_ts) AS gap, n + lead(n) OVER w AS pair_n FROM bt WINDOW w AS (ORDER BY bucket_id)) pr USING (pair) WHERE border IS NOT NULL))
    WHERE k = 1 ORDER BY cell_count DESC, away, pair_n DESC, pair LIMIT 10"""
add("across_centres", "record_id:l bucket_id:l cell_count:l away:d base_seconds:d", lambda s, d: workload.across_centres(event_points(s, d)), _ACROSS_SQL)


def _window_sql(centres: str, kind: str) -> str:
    per_lon = "greatest(CAST(1 AS DOUBLE), CAST(111320 AS DOUBLE) * cos(radians(lat)))"
    plan = {"ts": "base_seconds * alpha / CAST(2 AS DOUBLE)", "lat": "alpha * CAST(1000 AS DOUBLE) / CAST(2 AS DOUBLE) / CAST(111320 AS DOUBLE)", "lon": f"alpha * CAST(1000 AS DOUBLE) / CAST(2 AS DOUBLE) / {per_lon}"}
    ends = {"ts": ("CAST(t0 AS DOUBLE)", "CAST(t1 AS DOUBLE)"), "lat": ("a", "b"), "lon": ("c", "d")}
    lo = lambda c: f"greatest({ends[c][0]}, least({ends[c][1]}, {c} - {plan[c]}))"
    hi = lambda c: f"greatest({ends[c][0]}, least({ends[c][1]}, {c} + {plan[c]}))"
    cut = lambda c: f"CAST({c} - {plan[c]} < {ends[c][0]} OR {c} - {plan[c]} > {ends[c][1]} OR {c} + {plan[c]} < {ends[c][0]} OR {c} + {plan[c]} > {ends[c][1]} AS INTEGER) AS {c}_clamped"
    return f"SELECT '{kind}' AS kind, record_id, alpha, round({lo('ts')}, 3) AS start, round({hi('ts')}, 3) AS \"end\", round({lo('lat')}, 6) AS lat_min, round({hi('lat')}, 6) AS lat_max, round({lo('lon')}, 6) AS lon_min, round({hi('lon')}, 6) AS lon_max, {cut('ts')}, {cut('lat')}, {cut('lon')}, CAST(floor({hi('ts')} / 86400) - floor({lo('ts')} / 86400) AS BIGINT) + 1 AS days FROM ({centres}), (VALUES (1), (2), (4), (8), (16)) s(alpha), b"


add("query_plan", "dataset:s kind:s record_id:l alpha:l start:d stop:d lat_min:d lat_max:d lon_min:d lon_max:d ts_clamped:l lat_clamped:l lon_clamped:l days:l", lambda s, d: workload.plan_table(event_points(s, d), "events").withColumnRenamed("end", "stop"), f"SELECT 'events' AS dataset, *, \"end\" AS stop FROM ({_window_sql(_INSIDE_SQL, 'inside')} UNION ALL {_window_sql(_ACROSS_SQL, 'across')})")
add("pending_plan", "record_id:l", lambda s, d: truth.pending(event_points(s, d), event_points(s, d).where(truth.inside(ONE[1:])), ["record_id"]), "SELECT record_id FROM p WHERE record_id NOT IN (SELECT record_id FROM truth WHERE query_id = 1)")
add("chosen_rows", "event_id:l", lambda s, d: truth.chosen(events(s, d), event_type="click, view", user_id=""), "SELECT event_id FROM events WHERE event_type IN ('click', 'view')")

# Metrics.
add("slot_density", "day:l slot:l n:l cells:l", lambda s, d: metrics.slot_density(schemes._cells(event_points(s, d), event_points(s, d), 8)), "SELECT day, slot, count(*) AS n, count(DISTINCT (cx, cy)) AS cells FROM dp8 GROUP BY 1, 2")
add("filter_capacity", "max_records:l max_cells:l capacity:l", lambda s, d: metrics.capacity(metrics.slot_density(schemes._cells(event_points(s, d), event_points(s, d), 8))), "SELECT max(n) AS max_records, max(cells) AS max_cells, ceil(max(cells) * CAST(1.5 AS DOUBLE)) AS capacity FROM (SELECT day, slot, count(*) AS n, count(DISTINCT (cx, cy)) AS cells FROM dp8 GROUP BY 1, 2)")


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = event_points(spark, sf_dir).select("record_id", clock.floor_div(F.col("ts"), clock.DAY_SECONDS).alias("day"), clock.slot_in_day(F.col("ts")).alias("slot"))
    of = lambda pairs: pairs.join(p, "record_id").select("query_id", "day", "slot")
    return metrics.interval_false_positives(of(schemes.day_slot_candidates(event_points(spark, sf_dir), boxes(spark))), of(truth.batch_truth(event_points(spark, sf_dir), boxes(spark))))


add("interval_false_positives", "query_id:l intervals:l true_intervals:l fp_intervals:l", _intervals, "WITH c AS (SELECT DISTINCT query_id, day, slot FROM day_slot_cand JOIN dp USING (record_id)), t AS (SELECT DISTINCT query_id, day, slot FROM truth JOIN dp USING (record_id)) SELECT c.query_id, count(*) AS intervals, count(t.day) AS true_intervals, count(*) - count(t.day) AS fp_intervals FROM c LEFT JOIN t ON t.query_id = c.query_id AND t.day = c.day AND t.slot = c.slot GROUP BY 1")
add("summary_stats", "event_type:s n:l mean:d std:d", lambda s, d: metrics.summary(events(s, d), ["event_type"], "value"), "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std FROM events GROUP BY 1")
add("success_counts", "event_type:s n:l", lambda s, d: events(s, d).where("value > 20").groupBy("event_type").agg(F.count("*").alias("n")), "SELECT event_type, count(*) AS n FROM events WHERE value > 20 GROUP BY 1")
add("cell_medians", "cell:l median_lat:d", lambda s, d: metrics.upper_median(schemes._cells(event_points(s, d), event_points(s, d), 3).withColumn("cell", F.col("cx") * 8 + F.col("cy")), ["cell"], "lat", "median_lat"), "SELECT cx * 8 + cy AS cell, lat AS median_lat FROM (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY lat) AS r, count(*) OVER (PARTITION BY cx, cy) AS n FROM p3) WHERE r = n // 2 + 1")
add("result_lines", "query_id:l n_truth:l", lambda s, d: metrics.accuracy(truth.batch_truth(event_points(s, d), boxes(s)), truth.batch_truth(event_points(s, d), boxes(s)), boxes(s)).select(stores.parse_result(stores.result_line(["query_id", "n_truth"])).alias("m")).select(F.col("m")["query_id"].alias("query_id"), F.col("m")["n_truth"].alias("n_truth")), "SELECT q.query_id, count(t.record_id) AS n_truth FROM q LEFT JOIN truth t ON t.query_id = q.query_id GROUP BY 1")

# Key stores, and filters that depend on the order of what is put in.
add("bit_algebra", "event_type:s all_and:l all_or:l all_xor:l ones:l", lambda s, d: events(s, d).groupBy("event_type").agg(F.bit_and("user_id").alias("all_and"), F.bit_or("user_id").alias("all_or"), F.bit_xor("user_id").alias("all_xor"), F.sum(F.bit_count("user_id")).alias("ones")), "SELECT event_type, bit_and(user_id) AS all_and, bit_or(user_id) AS all_or, bit_xor(user_id) AS all_xor, sum(bit_count(user_id)) AS ones FROM events GROUP BY 1")


#: Users that one set of order-dependent filters is sized for.
FOLDED_USERS = 150


def _ordered_filters() -> dict:
    return {"spectral_min": sketches.SpectralMinimum(sketches.Cells(4, 4096), 16), "spectral_rm": sketches.SpectralRecurring(sketches.Cells(4, 4096), sketches.Cells(3, 2048, 7), 16), "bitwise": sketches.Bitwise(4, 8192), "aging": sketches.AgingPair(4, 8192, 150), "stable": sketches.Stable(4, 8192, 3, 4)}


def _fold_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-dependent filters over all events, in id order: estimates of each user. Users are dealt by hash to parts
    of about FOLDED_USERS, each with filters of its own; a part's events are read one after the other, never gathered."""
    rows = events(spark, sf_dir).select("user_id", "event_id")
    parts = max(1, -(-rows.select("user_id").distinct().count() // FOLDED_USERS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(parts))).repartition("part").sortWithinPartitions("part", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, seen = None, {}, {}

        def told() -> pa.RecordBatch:
            users = pa.array(list(seen), pa.int64())
            return pa.RecordBatch.from_arrays([users, *(pa.array([int(m.lookup(u)) for u in seen], pa.int64()) for m in made.values())], names=["user_id", *made])

        for b in batches:
            for part, user in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if part != now:
                    if seen:
                        yield told()
                    now, made, seen = part, _ordered_filters(), {}
                seen[user] = None
                for m in made.values():
                    m.add(user)
        if seen:
            yield told()

    return dealt.select("part", "user_id").mapInArrow(run, "user_id bigint, " + ", ".join(f"{n} bigint" for n in _ordered_filters()))


add("ordered_sketches", "user_id:l spectral_min:l spectral_rm:l bitwise:l aging:l stable:l", _fold_sketches, None)
_ITEMS = lambda s, d: events(s, d).select(F.col("event_id").alias("key"), F.col("user_id").alias("item"))
add("key_store", "key:l item:l", lambda s, d: stores.delete(stores.put(_ITEMS(s, d), _ITEMS(s, d).where("key % 3 = 0").withColumn("item", F.col("item") + 1000000)), _ITEMS(s, d).where("key % 5 = 0")), "SELECT event_id AS key, CASE WHEN event_id % 3 = 0 THEN user_id + 1000000 ELSE user_id END AS item FROM events WHERE event_id % 5 <> 0")
add("range_keys", "id:l key:l", lambda s, d: stores.range_keys(s, 1000, 5), "SELECT i AS id, i + 5 AS key FROM range(1000) t(i)")
add("key_hashes", "record_id:l k64:l", lambda s, d: event_points(s, d).select("record_id", crypto.key64(F.col("record_id").cast("string")).alias("k64")), "SELECT record_id, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS k64 FROM (SELECT record_id, list_sum(list_transform(range(8), lambda k: CAST(CAST('0x' || substr(h, 2 * k + 1, 2) AS UTINYINT) AS HUGEINT) * (CAST(1 AS HUGEINT) << CAST(8 * k AS INTEGER)))) AS u FROM (SELECT record_id, sha256(CAST(record_id AS VARCHAR)) AS h FROM p))")

# The others register themselves with ``add`` when they are imported, which needs the names above.
from stratagrid.plans import filters, stored  # noqa: E402, F401
