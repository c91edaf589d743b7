"""Common table expressions for DuckDB that the oracles share: the same definitions, written again in plain SQL."""

from __future__ import annotations

#: Closed boxes (query_id, s, e, lat_min, lat_max, lon_min, lon_max): some large, some small, one over midnight, one
#: whose edges lie on points' coordinates, and two that reach beyond the data.
BOXES = [
    (1, 1704500000, 1705500000, -10.0, 60.0, -50.0, 100.0),
    (2, 1704153600, 1704175199, -45.0, 45.0, -90.0, 90.0),
    (3, 1704153600, 1704239999, -90.0, 90.0, -180.0, 180.0),
    (4, 1704600000, 1704603599, 0.0, 20.0, 0.0, 40.0),
    (5, 1704066200, 1704327177, 10.5, 30.25, -120.75, -60.5),
    (6, 1704671700, 1704672300, -30.0, 30.0, -30.0, 30.0),
    (7, 1705800000, 1740000000, 80.0, 95.0, 150.0, 200.0),
    (8, 1704400000, 1704900000, 12.34, 45.67, -11.11, 55.55),
]


def cell(v: str, lo: str, hi: str, level: int) -> str:
    n = 1 << level
    return f"least(greatest(CAST(floor(({v} - {lo}) / ({hi} - {lo}) * CAST({n} AS DOUBLE)) AS BIGINT), 0), {n - 1})"


def share(v: str, lo: str, hi: str) -> str:
    return f"(CASE WHEN CAST({hi} AS DOUBLE) = CAST({lo} AS DOUBLE) THEN CAST(0 AS DOUBLE) ELSE CAST({v} - {lo} AS DOUBLE) / CAST({hi} - {lo} AS DOUBLE) END * CAST(127 AS DOUBLE))"


def grid(v: str, lo: str, hi: str) -> str:
    return f"least(greatest(CAST(trunc({share(v, lo, hi)}) AS BIGINT), 0), 127)"


def size(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = {b} THEN CAST(1 AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(floor(log2(xor({a}, {b}))) + 1 AS INTEGER) END)"


def low(a: str, b: str) -> str:
    return f"(({a} // {size(a, b)}) * {size(a, b)})"


def middle(a: str, b: str) -> str:
    return f"({size(a, b)} >= 4 AND {low(a, b)} + {size(a, b)} // 4 <= {a} AND {b} <= {low(a, b)} + 3 * ({size(a, b)} // 4) - 1)"


def cover_lo(a: str, b: str) -> str:
    return f"(CASE WHEN {middle(a, b)} THEN {low(a, b)} + {size(a, b)} // 4 ELSE {low(a, b)} END)"


def cover_hi(a: str, b: str) -> str:
    return f"(CASE WHEN {middle(a, b)} THEN {low(a, b)} + 3 * ({size(a, b)} // 4) - 1 ELSE {low(a, b)} + {size(a, b)} - 1 END)"


_VALUES = ", ".join(f"({i}, {s}, {e}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE), CAST({c} AS DOUBLE), CAST({d} AS DOUBLE))" for i, s, e, a, b, c, d in BOXES)
_PATH_LEVELS = ", ".join(f"({j})" for j in range(8))

PRELUDE = f"""
WITH RECURSIVE
q(query_id, s, e, lat_min, lat_max, lon_min, lon_max) AS (VALUES {_VALUES}),
p AS (SELECT event_id AS record_id, user_id AS join_key, event_type AS keyword, value, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
    CAST((user_id * 7919 + event_id * 31) % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE) AS lat,
    CAST((user_id * 104729 + event_id * 17) % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon FROM events),
b AS (SELECT min(ts) AS t0, max(ts) AS t1, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM p),
truth AS (SELECT query_id, record_id FROM p JOIN q ON ts BETWEEN s AND e AND lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max),
p8 AS (SELECT p.*, {cell("lat", "a", "b", 8)} AS cx, {cell("lon", "c", "d", 8)} AS cy FROM p, b),
p3 AS (SELECT p.*, {cell("lat", "a", "b", 3)} AS cx, {cell("lon", "c", "d", 3)} AS cy FROM p, b),
q8 AS (SELECT q.*, {cell("lat_min", "a", "b", 8)} AS x0, {cell("lat_max", "a", "b", 8)} AS x1, {cell("lon_min", "c", "d", 8)} AS y0, {cell("lon_max", "c", "d", 8)} AS y1 FROM q, b WHERE lat_max >= a AND lat_min <= b AND lon_max >= c AND lon_min <= d),
q3 AS (SELECT q.*, {cell("lat_min", "a", "b", 3)} AS x0, {cell("lat_max", "a", "b", 3)} AS x1, {cell("lon_min", "c", "d", 3)} AS y0, {cell("lon_max", "c", "d", 3)} AS y1 FROM q, b WHERE lat_max >= a AND lat_min <= b AND lon_max >= c AND lon_min <= d),
g AS (SELECT record_id, {grid("ts", "t0", "t1")} AS x, {grid("lat", "(-90)", "90")} AS y, {grid("lon", "(-180)", "180")} AS z FROM p, b),
gq AS (SELECT query_id, {grid("s", "t0", "t1")} AS x0, {grid("e", "t0", "t1")} AS x1, least(greatest(CAST(ceil({share("e", "t0", "t1")}) AS BIGINT), 0), 128) AS x2,
    {grid("lat_min", "(-90)", "90")} AS y0, {grid("lat_max", "(-90)", "90")} AS y1, least(greatest(CAST(ceil({share("lat_max", "(-90)", "90")}) AS BIGINT), 0), 128) AS y2,
    {grid("lon_min", "(-180)", "180")} AS z0, {grid("lon_max", "(-180)", "180")} AS z1, least(greatest(CAST(ceil({share("lon_max", "(-180)", "180")}) AS BIGINT), 0), 128) AS z2
    FROM q, b WHERE e >= t0 AND s <= t1),
path AS (SELECT v, (v // (1 << j)) * (1 << j) AS lo, (v // (1 << j)) * (1 << j) + (1 << j) - 1 AS hi FROM range(128) r(v), (VALUES {_PATH_LEVELS}) l(j)
    UNION ALL SELECT v, lo, hi FROM (SELECT v, (v // (1 << j)) * (1 << j) + (1 << j) // 4 AS lo, (v // (1 << j)) * (1 << j) + 3 * (1 << j) // 4 - 1 AS hi FROM range(128) r(v), (VALUES {_PATH_LEVELS}) l(j) WHERE j >= 2) WHERE v BETWEEN lo AND hi),
gc AS (SELECT query_id, {cover_lo("x0", "x1")} AS xl, {cover_hi("x0", "x1")} AS xh, {cover_lo("y0", "y1")} AS yl, {cover_hi("y0", "y1")} AS yh, {cover_lo("z0", "z1")} AS zl, {cover_hi("z0", "z1")} AS zh FROM gq),
widths(w) AS (VALUES (1), (2), (4), (8), (16), (32), (64)),
stag_try AS (SELECT query_id, w, list_transform([[x0, x1 + 1], [y0, y1 + 1], [z0, z1 + 1]], lambda r: CASE WHEN r[2] <= (r[1] // w) * w + w THEN (r[1] // w) * w
        WHEN w > 1 AND r[2] <= (r[1] // greatest(w // 2, 1)) * greatest(w // 2, 1) + w AND (r[1] // greatest(w // 2, 1)) * greatest(w // 2, 1) <= 128 - w THEN (r[1] // greatest(w // 2, 1)) * greatest(w // 2, 1) END) AS st,
        greatest(x1 + 1 - x0, y1 + 1 - y0, z1 + 1 - z0, 1) AS side FROM gq, widths),
stag AS (SELECT gq.query_id, coalesce(t.w, 128) AS w, coalesce(t.st[1], 0) AS x, coalesce(t.st[2], 0) AS y, coalesce(t.st[3], 0) AS z FROM gq LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w) AS k FROM stag_try WHERE side <= w AND st[1] IS NOT NULL AND st[2] IS NOT NULL AND st[3] IS NOT NULL) t ON t.query_id = gq.query_id AND t.k = 1),
sl AS (SELECT slot, k, row_number() OVER (ORDER BY slot) AS i, CAST(sum(k) OVER (ORDER BY slot) - k AS BIGINT) AS bef FROM (SELECT CAST(floor(ts / CAST(600 AS DOUBLE)) AS BIGINT) AS slot, count(*) AS k FROM p GROUP BY 1)),
st(i, n, o) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
    UNION ALL SELECT st.i + 1,
        CASE WHEN st.n + k >= 3000 THEN CASE WHEN (k - (3000 - st.n)) % 3000 >= 2000 THEN 0 ELSE (k - (3000 - st.n)) % 3000 END
             WHEN st.o + 1 >= 256 OR st.n + k >= 2000 THEN 0 ELSE st.n + k END,
        CASE WHEN st.n + k >= 3000 THEN CASE WHEN (k - (3000 - st.n)) % 3000 >= 2000 OR (k - (3000 - st.n)) % 3000 = 0 THEN 0 ELSE 1 END
             WHEN st.o + 1 >= 256 OR st.n + k >= 2000 THEN 0 ELSE st.o + 1 END
    FROM st JOIN sl ON sl.i = st.i + 1),
cut AS (SELECT DISTINCT c FROM (
    SELECT unnest(generate_series(CAST(bef + 3000 - n AS BIGINT), CAST(bef + k AS BIGINT), 3000)) AS c FROM st JOIN sl ON sl.i = st.i + 1 WHERE n + k >= 3000
    UNION ALL SELECT bef + k FROM st JOIN sl ON sl.i = st.i + 1 WHERE (n + k >= 3000 AND (k - (3000 - n)) % 3000 >= 2000) OR (n + k < 3000 AND (o + 1 >= 256 OR n + k >= 2000))
    UNION ALL SELECT count(*) FROM p)),
ranked AS (SELECT p.*, CAST(floor(ts / CAST(600 AS DOUBLE)) AS BIGINT) AS abs_slot, row_number() OVER (ORDER BY ts, record_id) - 1 AS rk FROM p),
bp AS (SELECT ranked.*, (SELECT count(*) FROM cut WHERE c <= rk) AS bucket_id FROM ranked),
bt0 AS (SELECT bucket_id, min(ts) AS start_ts, max(ts) AS end_ts, min(abs_slot) AS start_slot, max(abs_slot) AS end_slot, count(*) AS n, count(DISTINCT abs_slot) AS n_slots FROM bp GROUP BY 1),
bt AS (SELECT *, lead(bucket_id) OVER (ORDER BY bucket_id) AS next_bucket FROM bt0),
bs AS (SELECT bucket_id, abs_slot, count(*) AS n, row_number() OVER (PARTITION BY bucket_id ORDER BY abs_slot) - 1 AS local_slot FROM bp GROUP BY 1, 2),
tq AS (SELECT q.query_id, bucket_id, CAST(floor(greatest(s, start_ts) / CAST(600 AS DOUBLE)) AS BIGINT) AS a, CAST(floor(least(e, end_ts) / CAST(600 AS DOUBLE)) AS BIGINT) AS b FROM bt JOIN q ON start_ts <= e AND end_ts >= s),
lr AS (SELECT query_id, tq.bucket_id, coalesce(min(local_slot) FILTER (abs_slot BETWEEN a AND b), -1) AS lo, coalesce(max(local_slot) FILTER (abs_slot BETWEEN a AND b), -1) AS hi FROM tq JOIN bs USING (bucket_id) GROUP BY 1, 2),
bp8 AS (SELECT bp.*, cx, cy FROM bp JOIN p8 USING (record_id)),
bp3 AS (SELECT bp.*, local_slot, cx, cy FROM bp JOIN p3 USING (record_id) JOIN bs ON bs.bucket_id = bp.bucket_id AND bs.abs_slot = bp.abs_slot),
slot_hit AS (SELECT DISTINCT tq.query_id, tq.bucket_id, abs_slot FROM tq JOIN q8 USING (query_id) JOIN bp8 ON bp8.bucket_id = tq.bucket_id AND abs_slot BETWEEN tq.a AND tq.b AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1),
slot_cand AS (SELECT query_id, record_id FROM bp JOIN slot_hit ON slot_hit.bucket_id = bp.bucket_id AND slot_hit.abs_slot = bp.abs_slot),
cover_hit AS (SELECT DISTINCT lr.query_id, lr.bucket_id, lo, hi FROM lr JOIN q3 USING (query_id) JOIN bp3 ON bp3.bucket_id = lr.bucket_id AND local_slot BETWEEN lo AND hi AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 WHERE lo >= 0),
slot_cover_cand AS (SELECT query_id, record_id FROM bp3 JOIN (SELECT query_id, bucket_id, {cover_lo("lo", "hi")} AS cl, {cover_hi("lo", "hi")} AS ch FROM cover_hit) h ON h.bucket_id = bp3.bucket_id AND local_slot BETWEEN cl AND ch),
dq AS (SELECT query_id, day, CASE WHEN CAST(floor(s / CAST(86400 AS DOUBLE)) AS BIGINT) = day THEN (s - day * 86400) // 600 ELSE 0 END AS lo, CASE WHEN CAST(floor(e / CAST(86400 AS DOUBLE)) AS BIGINT) = day THEN (e - day * 86400) // 600 ELSE 143 END AS hi
    FROM (SELECT q.*, unnest(generate_series(CAST(floor(s / CAST(86400 AS DOUBLE)) AS BIGINT), CAST(floor(e / CAST(86400 AS DOUBLE)) AS BIGINT))) AS day FROM q)),
dp AS (SELECT record_id, CAST(floor(ts / CAST(86400 AS DOUBLE)) AS BIGINT) AS day, (ts - CAST(floor(ts / CAST(86400 AS DOUBLE)) AS BIGINT) * 86400) // 600 AS slot FROM p),
dp8 AS (SELECT dp.*, cx, cy FROM dp JOIN p8 USING (record_id)), dp3 AS (SELECT dp.*, cx, cy FROM dp JOIN p3 USING (record_id)),
day_slot_cand AS (SELECT query_id, record_id FROM dp JOIN (SELECT DISTINCT dq.query_id, dq.day, slot FROM dq JOIN q8 USING (query_id) JOIN dp8 ON dp8.day = dq.day AND slot BETWEEN lo AND hi AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1) h ON h.day = dp.day AND h.slot = dp.slot),
day_cover_cand AS (SELECT query_id, record_id FROM dp JOIN (SELECT DISTINCT dq.query_id, dq.day, {cover_lo("lo", "hi")} AS cl, {cover_hi("lo", "hi")} AS ch FROM dq JOIN q3 USING (query_id) JOIN dp3 ON dp3.day = dq.day AND slot BETWEEN lo AND hi AND cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1) h ON h.day = dp.day AND slot BETWEEN cl AND ch),
dyadic_grid_cand AS (SELECT query_id, record_id FROM g JOIN gc ON x BETWEEN xl AND xh AND y BETWEEN yl AND yh AND z BETWEEN zl AND zh),
staggered_grid_cand AS (SELECT query_id, record_id FROM g JOIN stag ON g.x >= stag.x AND g.x < stag.x + w AND g.y >= stag.y AND g.y < stag.y + w AND g.z >= stag.z AND g.z < stag.z + w),
pos AS (SELECT record_id, x, row_number() OVER (ORDER BY x, record_id) - 1 AS i FROM g),
tl AS (SELECT query_id, i FROM pos JOIN gq ON x BETWEEN x0 AND x1),
tl_ranges AS (SELECT query_id, min(i) AS lo, max(i) AS hi FROM (SELECT query_id, i, i - row_number() OVER (PARTITION BY query_id ORDER BY i) AS island FROM tl) GROUP BY query_id, island),
two_level_cand AS (SELECT DISTINCT query_id, record_id FROM pos JOIN (SELECT query_id, {cover_lo("lo", "hi")} AS cl, {cover_hi("lo", "hi")} AS ch FROM tl_ranges) ON i BETWEEN cl AND ch),
dpos AS (SELECT record_id, day, slot, row_number() OVER (PARTITION BY day ORDER BY slot, record_id) - 1 AS i FROM dp),
dtl AS (SELECT query_id, dq.day, i FROM dpos JOIN dq ON dq.day = dpos.day AND slot BETWEEN lo AND hi),
dtl_ranges AS (SELECT query_id, day, min(i) AS lo, max(i) AS hi FROM (SELECT query_id, day, i, i - row_number() OVER (PARTITION BY query_id, day ORDER BY i) AS island FROM dtl) GROUP BY query_id, day, island),
two_level_day_cand AS (SELECT DISTINCT query_id, record_id FROM dpos JOIN (SELECT query_id, day, {cover_lo("lo", "hi")} AS cl, {cover_hi("lo", "hi")} AS ch FROM dtl_ranges) h ON h.day = dpos.day AND i BETWEEN cl AND ch),
dens0 AS (SELECT p.*, CAST(floor((lon - c) * greatest(1.0, 111320.0 * cos(radians((SELECT lat FROM p ORDER BY lat LIMIT 1 OFFSET (SELECT count(*) // 2 FROM p))))) / 1000.0) AS BIGINT) AS cell_x, CAST(floor((lat - a) * CAST(111320 AS DOUBLE) / CAST(1000 AS DOUBLE)) AS BIGINT) AS cell_y FROM p, b),
dens AS (SELECT *, count(*) OVER (PARTITION BY cell_x, cell_y) AS cell_count FROM dens0)
"""
