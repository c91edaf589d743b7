"""Queries of stored and growing indexes, of both sides of the encrypted join, and of the statistics about them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.functions import cells, clock, cover, crypto
from stratagrid.operators import emm, index, joins, metrics, schemes, truth
from stratagrid.operators import buckets as B
from stratagrid.plans import oracle as O
from stratagrid.plans import registry as R
from stratagrid.plans import workload
from stratagrid.sources import stores
from stratagrid.sources.points import event_points
from stratagrid.sources.shared import new_path, written

PAIR = "query_id:l record_id:l"


def _grown(spark: SparkSession, sf_dir: str, level: int) -> index.DayIndex:
    """An index of two thirds of the events, to which the others are added."""
    points = event_points(spark, sf_dir)
    built = index.DayIndex.build(points.where("record_id % 3 > 0"), new_path(spark, "index"), level)
    return built.insert(points.where("record_id % 3 = 0"))


def _held(v: str, lo: str, hi: str, level: int) -> str:
    return O.cell(v, lo, hi, level)


def _grown_sql(level: int) -> str:
    """The cells of all points under the bounds of the first two thirds."""
    return f"""WITH gb AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM p WHERE record_id % 3 > 0),
        gp AS (SELECT dp.*, {_held("lat", "a", "b", level)} AS cx, {_held("lon", "c", "d", level)} AS cy FROM dp JOIN p USING (record_id), gb),
        gr AS (SELECT dq.*, {_held("lat_min", "a", "b", level)} AS x0, {_held("lat_max", "a", "b", level)} AS x1, {_held("lon_min", "c", "d", level)} AS y0, {_held("lon_max", "c", "d", level)} AS y1
            FROM dq JOIN q USING (query_id), gb WHERE lat_max >= a AND lat_min <= b AND lon_max >= c AND lon_min <= d),
        gh AS (SELECT DISTINCT query_id, gr.day, gp.slot, lo, hi FROM gr JOIN gp ON gp.day = gr.day AND gp.slot BETWEEN lo AND hi AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1)"""


_COVERED = f"SELECT DISTINCT query_id, day, {O.cover_lo('lo', 'hi')} AS cl, {O.cover_hi('lo', 'hi')} AS ch FROM"
R.add("index_grown", PAIR, lambda s, d: _grown(s, d, 8).slot_candidates(R.boxes(s)), f"{_grown_sql(8)} SELECT query_id, record_id FROM gp JOIN (SELECT DISTINCT query_id, day, slot FROM gh) h ON h.day = gp.day AND h.slot = gp.slot")
R.add("index_cover_grown", PAIR, lambda s, d: _grown(s, d, 3).cover_candidates(R.boxes(s)), f"{_grown_sql(3)} SELECT query_id, record_id FROM gp JOIN ({_COVERED} gh) h ON h.day = gp.day AND gp.slot BETWEEN cl AND ch")


def _with_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells added at the cover nodes that two boxes ask for: their covers count as hit on each day."""
    built = _grown(spark, sf_dir, 3)
    asked = built._asked(R.boxes(spark).where("query_id in (4, 6)"))
    c = cover.dyadic_cover(F.col("lo"), F.col("hi"))
    return built.add_to_cover(asked.select("day", c["lo"].alias("lo"), c["hi"].alias("hi"), F.col("x0").alias("cx"), F.col("y1").alias("cy"))).cover_candidates(R.boxes(spark))


R.add("index_cover_nodes", PAIR, _with_nodes, f"""{_grown_sql(3)}, gc2 AS (SELECT query_id, day, x0, x1, y0, y1, {O.cover_lo('lo', 'hi')} AS cl, {O.cover_hi('lo', 'hi')} AS ch FROM gr),
    gn AS (SELECT day, cl, ch, x0 AS cx, y1 AS cy FROM gc2 WHERE query_id IN (4, 6)),
    gw AS ({_COVERED} gh UNION SELECT query_id, gc2.day, gc2.cl, gc2.ch FROM gc2 JOIN gn ON gn.day = gc2.day AND gn.cl = gc2.cl AND gn.ch = gc2.ch AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1)
    SELECT query_id, record_id FROM gp JOIN gw ON gw.day = gp.day AND gp.slot BETWEEN cl AND ch""")
R.add("slot_roll_up", "level:l day:l blocks:l cells:l", lambda s, d: index.roll_up(schemes._day_points(event_points(s, d), 3)).groupBy("level", "day").agg(F.count_distinct("block").alias("blocks"), F.count("*").alias("cells")), "SELECT level, day, count(DISTINCT block) AS blocks, count(*) AS cells FROM (SELECT DISTINCT level, day, slot >> level AS block, cx, cy FROM dp3, range(9) t(level)) GROUP BY 1, 2")
R.add("slot_sharing", "day:l pair:l away:l shared:b", lambda s, d: index.sharing(schemes._day_points(event_points(s, d), 3), 442), """
    SELECT day, pair, CAST(count(*) FILTER (WHERE k = 1) AS BIGINT) AS away, max(late) = 1 AND min(early) = 0 AND count(*) FILTER (WHERE k = 1) / CAST(3536 AS DOUBLE) < 0.001 AS shared
    FROM (SELECT day, slot >> 1 AS pair, cx, cy, count(DISTINCT slot & 1) AS k, max(slot & 1) AS late, min(slot & 1) AS early FROM dp3 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2""")

# Days.
_DAYS = lambda s, d: event_points(s, d).select(clock.floor_div(F.col("ts"), clock.DAY_SECONDS).alias("day"))
R.add("first_days", "ts:l day:l", lambda s, d: index.first_days(_DAYS(s, d).where("day % 3 = 0"), R.boxes(s).select(F.col("s").alias("ts")).union(R.boxes(s).select("e"))), "SELECT t AS ts, (SELECT min(day) FROM dp WHERE day % 3 = 0 AND day >= CAST(floor(t / CAST(86400 AS DOUBLE)) AS BIGINT)) AS day FROM (SELECT s AS t FROM q UNION SELECT e FROM q)")
R.add("day_table_changed", "query_id:l key:l item:l", lambda s, d: stores.delete(stores.put(_DAYS(s, d).groupBy(F.col("day").alias("key")).agg(F.count("*").alias("item")), _DAYS(s, d).where("day % 4 = 1").select(F.col("day").alias("key"), F.lit(-1).cast("bigint").alias("item")).distinct()), _DAYS(s, d).where("day % 5 = 0").select(F.col("day").alias("key"))).join(F.broadcast(R.boxes(s)), F.expr("key between floor(s / 86400.0) and floor(e / 86400.0)")).select("query_id", "key", "item"), "SELECT query_id, key, item FROM (SELECT day AS key, CASE WHEN day % 4 = 1 THEN -1 ELSE count(*) END AS item FROM dp WHERE day % 5 <> 0 GROUP BY day) JOIN q ON key BETWEEN floor(s / CAST(86400 AS DOUBLE)) AND floor(e / CAST(86400 AS DOUBLE))")

# Keys as text.
R.add("cover_keys", "query_id:l key:s day_key:s", lambda s, d: B.local_ranges(B.with_buckets(event_points(s, d)), R.boxes(s)).where("lo >= 0").select("query_id", clock.cover_key(F.col("bucket_id"), F.col("lo"), F.col("hi")).alias("key"), clock.day_cover_key(F.col("bucket_id"), F.col("lo"), F.col("hi")).alias("day_key")), "SELECT query_id, 'cover_bucket_' || bucket_id || '_' || lo || '-' || hi AS key, 'cover_' || bucket_id || '_' || lo || '-' || hi AS day_key FROM lr WHERE lo >= 0")
R.add("staggered_cover_labels", "query_id:l label:s", lambda s, d: schemes.staggered_covers(event_points(s, d), R.boxes(s)).select("query_id", cover.cube_label(F.struct("w", "x", "y", "z")).alias("label")), "SELECT query_id, '(' || x || ',' || y || ',' || z || ')-(' || (x + w) || ',' || (y + w) || ',' || (z + w) || ')' AS label FROM stag")
R.add("aligned_covers", "query_id:l w:l x:l y:l z:l", lambda s, d: schemes.staggered_covers(event_points(s, d), R.boxes(s), aligned=True), """
    SELECT gq.query_id, coalesce(t.w, 128) AS w, coalesce(t.x, 0) AS x, coalesce(t.y, 0) AS y, coalesce(t.z, 0) AS z FROM gq LEFT JOIN (
        SELECT query_id, w, (x0 // w) * w AS x, (y0 // w) * w AS y, (z0 // w) * w AS z, row_number() OVER (PARTITION BY query_id ORDER BY w) AS k FROM gq, widths
        WHERE x1 + 1 <= (x0 // w) * w + w AND y1 + 1 <= (y0 // w) * w + w AND z1 + 1 <= (z0 // w) * w + w) t ON t.query_id = gq.query_id AND t.k = 1""")
_AXIS = "axis AS (SELECT v, w, count(*) AS c FROM (SELECT v, w, s FROM range(128) t(v), (SELECT w, unnest(CASE WHEN w = 1 THEN range(128) WHEN w = 128 THEN [0] ELSE range(0, 128 - w + 1, w // 2) END) AS s FROM (SELECT w FROM widths UNION ALL SELECT 128)) WHERE v >= s AND v < s + w) GROUP BY 1, 2)"
R.add("staggered_label_stats", "cells:l labels:l mean:d most:l", lambda s, d: schemes.label_stats(schemes.cube_labels(event_points(s, d))), f"WITH {_AXIS} SELECT count(*) AS cells, sum(n) AS labels, round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT k.x, k.y, k.z, sum(ax.c * ay.c * az.c) AS n FROM (SELECT DISTINCT x, y, z FROM g) k JOIN axis ax ON ax.v = k.x JOIN axis ay ON ay.v = k.y AND ay.w = ax.w JOIN axis az ON az.v = k.z AND az.w = ax.w GROUP BY 1, 2, 3)")

# Cells of the last level alone.
R.add("query_leaf_cells", "query_id:l ix:l iy:l", lambda s, d: schemes._query_cells(R.boxes(s), event_points(s, d), 6).select("query_id", F.explode(cells.leaf_cells(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"))).alias("c")).select("query_id", "c.*"), f"SELECT query_id, unnest(generate_series(x0, x1)) AS ix, iy FROM (SELECT query_id, x0, x1, unnest(generate_series(y0, y1)) AS iy FROM (SELECT q.query_id, {O.cell('lat_min', 'a', 'b', 6)} AS x0, {O.cell('lat_max', 'a', 'b', 6)} AS x1, {O.cell('lon_min', 'c', 'd', 6)} AS y0, {O.cell('lon_max', 'c', 'd', 6)} AS y1 FROM q, b WHERE lat_max >= a AND lat_min <= b AND lon_max >= c AND lon_min <= d))")
R.add("point_leaf_cells", "record_id:l level:l ix:l iy:l", lambda s, d: event_points(s, d).select("record_id", F.explode(cells.point_cells(F.col("lat"), F.col("lon"), R._bounds4(s, d), 6, leaf_only=True)).alias("c")).select("record_id", "c.*"), f"SELECT record_id, 6 AS level, {O.cell('lat', 'a', 'b', 6)} AS ix, {O.cell('lon', 'c', 'd', 6)} AS iy FROM p, b")

# Both sides of the keyword-restricted join.


def _space(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The space side: records under their cells of each level, and the cells that the boxes ask for."""
    bounds = R._bounds4(spark, sf_dir)
    rows = joins.cell_rows(event_points(spark, sf_dir), bounds, 8)
    told = [(b[0], b[-1], *c) for b in R._KEYWORDS for c in cells.query_cells(b[3:7], bounds, 8)]
    asked = spark.createDataFrame(told, "query_id int, keyword2 string, level int, ix int, iy int")
    return rows, asked.select("query_id", "keyword2", joins.cell_keyword(F.col("level"), F.col("ix"), F.col("iy")).alias("keyword"))


def _masked_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _space(spark, sf_dir)
    return joins.masked_join(joins.build_masked(rows), joins.build_keys(R._table2(spark, sf_dir)), asked)


_SPACE_SIDE = f"SELECT DISTINCT q8.query_id, record_id FROM p8 JOIN q8 ON cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 JOIN (VALUES {R._KW}) k(query_id, kw) ON k.query_id = q8.query_id WHERE (join_key, kw) IN (SELECT (join_key, keyword) FROM p WHERE value > 50)"
R.add("keyword_masked_space", PAIR, _masked_space, _SPACE_SIDE)
R.add("keyword_join_intersection", PAIR, lambda s, d: joins.both(R._masked(s, d), _masked_space(s, d)), f"({R._TIME_SIDE}) INTERSECT ({_SPACE_SIDE})")


def _stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values behind the hits of both tables: the record of table 1 and the (keyword, value) of table 2, both stored
    under AES and read back."""
    key = emm.Keys().aes()
    rows, asked = R._time_rows(spark, sf_dir)
    entries = joins.build_masked(rows.withColumn("value", crypto.encrypt(F.col("record_id"), key)), "value")
    right = R._table2(spark, sf_dir).distinct()
    x = joins.mask(F.col("keyword"), F.lit(0)).bitwiseXOR(joins.value_key(F.col("join_key")))
    keys2 = right.select(x.alias("x"), crypto.encrypt(F.concat_ws(":", "keyword", "join_key"), key).alias("value2"))
    found = joins.masked_values(entries, keys2, asked)
    return found.select("query_id", crypto.decrypt(F.col("value"), key).cast("bigint").alias("record_id"), crypto.decrypt(F.col("value2"), key).alias("partner"))


R.add("keyword_masked_values", "query_id:l record_id:l partner:s", _stored_values, f"SELECT t.query_id, record_id, kw || ':' || join_key AS partner FROM ({R._TIME_SIDE}) t JOIN p USING (record_id) JOIN (VALUES {R._KW}) k(query_id, kw) ON k.query_id = t.query_id")


def _id_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join on a range of record ids, a keyword for each id."""
    rows = event_points(spark, sf_dir).select(F.col("record_id").alias("keyword"), "join_key", "record_id")
    asked = R._keyword_boxes(spark).select("query_id", F.col("keyword").alias("keyword2"), F.explode(F.sequence(F.col("query_id").cast("bigint") * 100, F.col("query_id").cast("bigint") * 100 + 149)).alias("keyword"))
    return joins.masked_join(joins.build_masked(rows), joins.build_keys(R._table2(spark, sf_dir)), asked)


R.add("id_token_join", PAIR, _id_tokens, f"SELECT k.query_id, record_id FROM p JOIN (VALUES {R._KW}) k(query_id, kw) ON record_id BETWEEN k.query_id * 100 AND k.query_id * 100 + 149 WHERE (join_key, kw) IN (SELECT (join_key, keyword) FROM p WHERE value > 50)")


def _join_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = R._time_rows(spark, sf_dir)
    entries = joins.build_masked(rows.withColumn("value", crypto.encrypt(F.col("record_id"), emm.Keys().aes())), "value")
    return joins.masked_storage(entries, joins.build_keys(R._table2(spark, sf_dir)))


R.add("join_index_storage", "entries:l entry_bytes:l value_bytes:l keys:l key_bytes:l", _join_sizes, "SELECT count(*) AS entries, count(*) * 8 AS entry_bytes, sum((length(CAST(record_id AS VARCHAR)) // 16 + 1) * 16) AS value_bytes, (SELECT count(*) FROM (SELECT DISTINCT keyword, join_key FROM p WHERE value > 50)) AS keys, (SELECT count(*) * 8 FROM (SELECT DISTINCT keyword, join_key FROM p WHERE value > 50)) AS key_bytes FROM p")


def _json_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index through files of the JSON sink, in the shared folder, and back."""
    path = new_path(spark, "json")
    stores.write_json_index(emm.build(R._postings(spark, sf_dir)), path)
    back = stores.read_json_index(spark, path, "ct_label binary, ct_value binary")
    return back.select(F.lower(F.hex("ct_label")).alias("ct_label"), crypto.decrypt(F.col("ct_value"), emm.Keys().aes()).cast("bigint").alias("record_id"))


R.add("emm_json_files", "ct_label:s record_id:l", _json_file, f"SELECT sha256(sha256('token-key' || label) || i) AS ct_label, record_id FROM (SELECT {R._LABEL} AS label, record_id, row_number() OVER (PARTITION BY day, slot ORDER BY record_id) - 1 AS i FROM dp)")
R.add("emm_saved", PAIR, lambda s, d: emm.EncryptedStore(R._postings(s, d)).save(new_path(s, "emm")).query(R._asked(s, d)), R.ORACLES["emm_roundtrip"].removeprefix(O.PRELUDE))

# The whole query plan, and what is looked up in it.
_TEXT = lambda x: f"strftime(make_timestamp(CAST(floor({x}) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') || '+00'"
_PER_LON = "greatest(CAST(1 AS DOUBLE), CAST(111320 AS DOUBLE) * cos(radians(lat)))"
_ACROSS_RANKED = R._ACROSS_SQL.replace("SELECT record_id, ts, lat, lon, pair AS bucket_id,", "SELECT row_number() OVER (ORDER BY cell_count DESC, away, pair_n DESC, pair) AS pick, record_id, ts, lat, lon, pair AS bucket_id,")
_INSIDE_RANKED = f"SELECT *, row_number() OVER (ORDER BY {R._IN_ORDER}) AS pick2 FROM ({R._INSIDE_SQL})"


def _plan_sql() -> str:
    lo, hi = ({c: f"greatest({a}, least({b}, {c}_{s}_0))" for c, a, b in (("ts", "CAST(t0 AS DOUBLE)", "CAST(t1 AS DOUBLE)"), ("lat", "a", "b"), ("lon", "c", "d"))} for s in ("lo", "hi"))
    held = ", ".join(f"{lo[c]} AS {c}_lo, {hi[c]} AS {c}_hi" for c in ("ts", "lat", "lon"))
    centres = f"SELECT 'intra_tree' AS baseline_type, pick2 AS repeat, ts, lat, lon, cell_count, base_seconds AS base, CAST(floor(widest / base_seconds) AS BIGINT) AS reach FROM ({_INSIDE_RANKED}) UNION ALL SELECT 'cross_tree', pick, ts, lat, lon, cell_count, base_seconds, NULL FROM ({_ACROSS_RANKED})"
    half = {"ts": "base * alpha / CAST(2 AS DOUBLE)", "lat": "alpha * CAST(1000 AS DOUBLE) / CAST(2 AS DOUBLE) / CAST(111320 AS DOUBLE)", "lon": f"alpha * CAST(1000 AS DOUBLE) / CAST(2 AS DOUBLE) / {_PER_LON}"}
    planned = ", ".join(f"{c} - {h} AS {c}_lo_0, {c} + {h} AS {c}_hi_0" for c, h in half.items())
    clamped = lambda c: f"CAST({c}_lo <> {c}_lo_0 OR {c}_hi <> {c}_hi_0 AS BIGINT)"
    flags = f"greatest({clamped('ts')}, {clamped('lat')}, {clamped('lon')})"
    days = "CAST(floor(ts_hi / 86400) - floor(ts_lo / 86400) AS BIGINT) + 1"
    return f"""WITH w0 AS (SELECT *, {planned} FROM ({centres}), (VALUES (1), (2), (4), (8), (16)) s(alpha)), w AS (SELECT w0.*, {held} FROM w0, b),
    wt AS (SELECT baseline_type, repeat, alpha, count(*) AS n FROM w JOIN p ON p.ts BETWEEN ts_lo AND ts_hi AND p.lat BETWEEN lat_lo AND lat_hi AND p.lon BETWEEN lon_lo AND lon_hi GROUP BY 1, 2, 3),
    wb AS (SELECT baseline_type, repeat, alpha, count(*) AS trees, string_agg(CAST(bucket_id AS VARCHAR), ';' ORDER BY bucket_id) AS ids FROM w JOIN bt ON start_ts <= ts_hi AND end_ts >= ts_lo GROUP BY 1, 2, 3)
    SELECT 'events' AS dataset, baseline_type, alpha, repeat, {_TEXT('ts_lo_0')} AS planned_query_start, {_TEXT('ts_hi_0')} AS planned_query_end, {_TEXT('ts_lo')} AS actual_query_start, {_TEXT('ts_hi')} AS actual_query_end,
    round(lat_lo, 8) AS query_lat_min, round(lat_hi, 8) AS query_lat_max, round(lon_lo, 8) AS query_lon_min, round(lon_hi, 8) AS query_lon_max, round(base, 6) AS baseline_temporal_window_seconds, round(CAST(1000 AS DOUBLE) / CAST(111320 AS DOUBLE), 10) AS baseline_lat_window, round(CAST(1000 AS DOUBLE) / {_PER_LON}, 8) AS baseline_lon_window,
    round(base * alpha, 6) AS scaled_temporal_window_seconds, round(lat_hi - lat_lo, 8) AS scaled_lat_window, round(lon_hi - lon_lo, 8) AS scaled_lon_window, round((ts_hi - ts_lo) / CAST(3600 AS DOUBLE), 6) AS temporal_window_hours, round(lat_hi - lat_lo, 8) AS lat_window_size, round(lon_hi - lon_lo, 8) AS lon_window_size,
    {clamped('ts')} AS time_clamped, {clamped('lat')} AS lat_clamped, {clamped('lon')} AS lon_clamped, {flags} AS was_clamped, {_TEXT('ts_lo_0')} AS unclamped_query_start, {_TEXT('ts_hi_0')} AS unclamped_query_end,
    round(lat_lo_0, 8) AS unclamped_query_lat_min, round(lat_hi_0, 8) AS unclamped_query_lat_max, round(lon_lo_0, 8) AS unclamped_query_lon_min, round(lon_hi_0, 8) AS unclamped_query_lon_max, round((ts_hi - ts_lo) / base, 6) AS actual_temporal_scaling_factor,
    coalesce(wt.n, 0) AS true_result_size, round(coalesce(wt.n, 0) / CAST((SELECT count(*) FROM p) AS DOUBLE), 10) AS selectivity, round(lat, 8) AS query_center_lat, round(lon, 8) AS query_center_lon, {_TEXT('ts')} AS query_center_ts, cell_count AS center_cell_count,
    coalesce(trees, 0) AS tree_count_touched, coalesce(ids, '') AS bucket_ids, {days} AS day_count_spanned, CAST(coalesce(trees, 0) = 1 AS BIGINT) AS is_intra_tree, CAST(coalesce(trees, 0) > 1 AS BIGINT) AS is_cross_tree, CAST({days} = 1 AS BIGINT) AS is_intra_day, CAST({days} > 1 AS BIGINT) AS is_cross_day,
    16 AS requested_max_alpha, reach AS actual_max_intra_tree_alpha, CAST(baseline_type = 'intra_tree' AND alpha = 16 AND coalesce(trees, 0) > 1 AS BIGINT) AS intra_tree_alpha16_crossed, CASE WHEN baseline_type = 'intra_tree' THEN '{workload.POLICY["intra_tree"]}' ELSE '{workload.POLICY["cross_tree"]}' END AS selection_policy
    FROM w LEFT JOIN wt USING (baseline_type, repeat, alpha) LEFT JOIN wb USING (baseline_type, repeat, alpha)"""


PLAN = """dataset:s baseline_type:s alpha:l repeat:l planned_query_start:s planned_query_end:s actual_query_start:s actual_query_end:s query_lat_min:d query_lat_max:d query_lon_min:d query_lon_max:d
    baseline_temporal_window_seconds:d baseline_lat_window:d baseline_lon_window:d scaled_temporal_window_seconds:d scaled_lat_window:d scaled_lon_window:d temporal_window_hours:d lat_window_size:d lon_window_size:d
    time_clamped:l lat_clamped:l lon_clamped:l was_clamped:l unclamped_query_start:s unclamped_query_end:s unclamped_query_lat_min:d unclamped_query_lat_max:d unclamped_query_lon_min:d unclamped_query_lon_max:d
    actual_temporal_scaling_factor:d true_result_size:l selectivity:d query_center_lat:d query_center_lon:d query_center_ts:s center_cell_count:l tree_count_touched:l bucket_ids:s day_count_spanned:l
    is_intra_tree:l is_cross_tree:l is_intra_day:l is_cross_day:l requested_max_alpha:l actual_max_intra_tree_alpha:l intra_tree_alpha16_crossed:l selection_policy:s"""
R.add("query_plan_full", PLAN, lambda s, d: workload.full_plan(event_points(s, d), "events"), _plan_sql())


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with what the plan says about their query, by the plan's four keys."""
    plan = written(workload.full_plan(event_points(spark, sf_dir), "events"))
    results = plan.where("alpha <> 8").select("dataset", "baseline_type", "alpha", "repeat", (F.col("true_result_size") + F.col("alpha")).alias("returned"))
    return results.join(plan.select("dataset", "baseline_type", "alpha", "repeat", "true_result_size", "bucket_ids"), ["dataset", "baseline_type", "alpha", "repeat"], "left")


R.add("plan_metadata", "dataset:s baseline_type:s alpha:l repeat:l returned:l true_result_size:l bucket_ids:s", _metadata, f"SELECT dataset, baseline_type, alpha, repeat, true_result_size + alpha AS returned, true_result_size, bucket_ids FROM ({_plan_sql()}) WHERE alpha <> 8")
R.add("throughput", "event_type:s per_second:d per_record:d", lambda s, d: R.events(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("size"), F.floor(F.sum("value") / 1000).alias("seconds")).select("event_type", *(F.round(c, 6).alias(n) for c, n in zip(metrics.rates(F.col("n"), F.col("size"), F.col("seconds")), ("per_second", "per_record"), strict=True))), "SELECT event_type, CASE WHEN t > 0 THEN round(n / CAST(t AS DOUBLE), 6) ELSE 0 END AS per_second, round(size / CAST(n AS DOUBLE), 6) AS per_record FROM (SELECT event_type, count(*) AS n, sum(length(props)) AS size, floor(sum(value) / 1000) AS t FROM events GROUP BY 1)")
