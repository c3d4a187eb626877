"""DuckDB twins of the registered queries, over the same Parquet tables."""

from __future__ import annotations

import re

# name -> SQL; a view may use the driver's tables and any other view here.
VIEWS = {
    "fx_line_stops": """
SELECT CASE WHEN c_nationkey % 8 = 7 THEN 'N' || c_nationkey ELSE CAST(c_nationkey + 1 AS VARCHAR) END AS lineid,
       CASE WHEN c_custkey % 2 = 0 THEN 'City' ELSE 'Suburb' END AS direction,
       CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey % 2 ORDER BY c_custkey) AS INTEGER) AS sequence_idx,
       CAST(c_custkey AS VARCHAR) AS pointid,
       CASE WHEN c_nationkey % 10 = 9 THEN NULL ELSE n_name || CASE WHEN c_custkey % 2 = 0 THEN ' C' ELSE ' S' END END AS destination,
       c_nationkey AS nk, CAST(c_custkey % 2 AS INTEGER) AS par, c_name, c_custkey
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "fx_stop": """
SELECT pointid, c_name AS stop_name_fr,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'NL ' || c_name END AS stop_name_nl,
       4.3e0 + nk * 0.004e0 + sequence_idx * 0.003e0 AS lon,
       50.8e0 + par * 0.02e0 + (sequence_idx % 3) * 0.001e0 AS lat
FROM fx_line_stops""",
    "fx_shape_point": """
SELECT lineid, direction, sequence_idx AS seq,
       4.3e0 + nk * 0.004e0 + sequence_idx * 0.003e0 AS lon,
       50.8001e0 + par * 0.02e0 + (sequence_idx % 3) * 0.001e0 AS lat
FROM fx_line_stops""",
    "fx_line_shape": """
SELECT DISTINCT lineid, direction, par AS variant,
       CASE nk % 4 WHEN 0 THEN 'metro' WHEN 1 THEN 'tram' WHEN 2 THEN 'bus' ELSE NULL END AS mode,
       '#' || lpad(CAST(100000 + nk * 1111 AS VARCHAR), 6, '0') AS route_color, '#FFFFFF' AS route_text_color
FROM fx_line_stops""",
    "fx_line_terminus": """
SELECT lineid, max_by(pointid, sequence_idx) AS terminus_pointid, direction, max_by(destination, sequence_idx) AS destination
FROM fx_line_stops GROUP BY lineid, direction""",
    "fx_feed": """
SELECT ls.lineid, t.terminus_pointid AS "directionId", ls.pointid AS "pointId",
       CAST(v.along % 200 AS DOUBLE) AS "distanceFromPoint",
       make_timestamp(1704067200000000 + (v.poll * 20 + (v.poll // 40) * 3600) * 1000000) AS poll_ts
FROM (SELECT *, slot % 5 AS nk, (slot // 5) % 2 AS par, poll * 60 + (slot // 10) * 700 AS along
      FROM (SELECT event_id // 30 AS poll, event_id % 30 AS slot FROM events) e) v
JOIN (SELECT *, count(*) OVER (PARTITION BY nk, par) AS n FROM fx_line_stops) ls
  ON ls.nk = v.nk AND ls.par = v.par AND ls.sequence_idx = (v.along // 200) % ls.n + 1
JOIN fx_line_terminus t ON t.lineid = ls.lineid AND t.direction = ls.direction""",
    "fx_trip_instant": """
SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, c.lineid, CAST(t.terminus_pointid AS INTEGER) AS direction,
       make_timestamp(1704067200000000 + o_orderkey * 47000000 + l_linenumber * 240000000) AS ts,
       4.3e0 + (pk % 100) * 0.001e0 AS lon, 50.8e0 + (pk % 37) * 0.001e0 AS lat
FROM orders
JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk FROM lineitem GROUP BY 1, 2) i ON l_orderkey = o_orderkey
JOIN fx_line_stops c ON c.c_custkey = o_custkey
JOIN fx_line_terminus t ON t.lineid = c.lineid AND t.direction = c.direction""",
    "fx_trip": """
SELECT trip_id, lineid, direction, min(ts) AS start_ts, max(ts) AS end_ts, CAST(count(*) AS INTEGER) AS point_count
FROM fx_trip_instant GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    "fx_waiting_time": """
SELECT ts AS poll_ts, CAST(user_id AS VARCHAR) AS pointid, event_type AS lineid,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE make_timestamp(epoch_us(ts) + CAST(floor(value) AS BIGINT) * 1000000) END AS expected,
       CASE WHEN event_id % 2 = 0 THEN 'City' END AS destination, props AS message
FROM events""",
    "fx_numbered_trip": """
SELECT t.*, CAST(date_trunc('day', CASE WHEN lineid LIKE 'N%' THEN (start_ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Brussels'
         ELSE ((start_ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Brussels') - INTERVAL 210 MINUTE END) AS DATE) AS service_day
FROM fx_trip t""",
    # Pings: one row per id.
    "fx_ping": """
SELECT DISTINCT substr(sha256(lineid || '|' || "directionId" || '|' || "pointId" || '|' || poll_text || '|' ||
                              CAST("distanceFromPoint" AS VARCHAR)), 1, 32) AS position_id,
       lineid, CAST("directionId" AS INTEGER) AS direction, "pointId" AS pointid, "distanceFromPoint" AS dist, poll_ts
FROM (SELECT *, strftime(poll_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS poll_text FROM fx_feed) f""",
    "fx_segment": """
SELECT *, sqrt((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1)) AS planar,
       sqrt(pow(6378137e0 * (1 - 0.0066943799901413165e0) / ((1 - 0.0066943799901413165e0 * pow(sin(mid), 2)) * sqrt(1 - 0.0066943799901413165e0 * pow(sin(mid), 2))) * radians(lat2 - lat1), 2)
          + pow(6378137e0 / sqrt(1 - 0.0066943799901413165e0 * pow(sin(mid), 2)) * cos(mid) * radians(lon2 - lon1), 2)) AS metres
FROM (SELECT *, radians((lat1 + lat2) / 2) AS mid
      FROM (SELECT lineid, direction, seq, lon AS lon1, lat AS lat1, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2
            FROM fx_shape_point WINDOW w AS (PARTITION BY lineid, direction ORDER BY seq)) a
      WHERE lon2 IS NOT NULL) b""",
    "fx_measured": """
SELECT *, before / total AS f0, lead(before) OVER (PARTITION BY lineid, direction ORDER BY seq) / total AS f1
FROM (SELECT *, coalesce(sum(planar) OVER (PARTITION BY lineid, direction ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(planar) OVER (PARTITION BY lineid, direction) AS total,
             sum(metres) OVER (PARTITION BY lineid, direction) AS length_m
      FROM fx_segment WHERE planar > 0) s""",
    # Every stop of a line against every segment of its shape.
    "fx_stop_fraction": """
SELECT lineid, direction, pointid, arg_min((before + t * planar) / total, {'d2': d2, 'seq': seq}) AS fraction
FROM (SELECT *, pow(lon - (lon1 + (lon2 - lon1) * t), 2) + pow(lat - (lat1 + (lat2 - lat1) * t), 2) AS d2
      FROM (SELECT l.lineid, l.direction, l.pointid, s.lon, s.lat, m.* EXCLUDE (lineid, direction),
                   greatest(0, least(1, ((s.lon - lon1) * (lon2 - lon1) + (s.lat - lat1) * (lat2 - lat1))
                     / ((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1)))) AS t
            FROM fx_line_stops l JOIN fx_stop s ON s.pointid = l.pointid
            JOIN fx_measured m ON m.lineid = l.lineid AND m.direction = l.direction) a) b
GROUP BY lineid, direction, pointid""",
    "fx_position": """
SELECT p.position_id, p.lineid, p.direction, p.pointid, p.poll_ts,
       CASE WHEN f IS NULL THEN p.slon ELSE m.lon1 + (m.lon2 - m.lon1) * least(1, (f - m.f0) * m.total / m.planar) END AS lon,
       CASE WHEN f IS NULL THEN p.slat ELSE m.lat1 + (m.lat2 - m.lat1) * least(1, (f - m.f0) * m.total / m.planar) END AS lat
FROM (SELECT p.*, t.direction AS label, s.lon AS slon, s.lat AS slat,
             CASE WHEN sf.fraction IS NOT NULL THEN least(1, greatest(0, sf.fraction + coalesce(p.dist, 0) / g.length_m)) END AS f
      FROM fx_ping p
      LEFT JOIN fx_line_terminus t ON t.lineid = p.lineid AND t.terminus_pointid = CAST(p.direction AS VARCHAR)
      LEFT JOIN fx_stop s ON s.pointid = p.pointid
      LEFT JOIN (SELECT lineid, direction, max(length_m) AS length_m FROM fx_measured GROUP BY ALL) g
        ON g.lineid = p.lineid AND g.direction = t.direction
      LEFT JOIN fx_stop_fraction sf ON sf.lineid = p.lineid AND sf.direction = t.direction AND sf.pointid = p.pointid
      WHERE s.lon IS NOT NULL OR g.length_m IS NOT NULL) p
LEFT JOIN fx_measured m ON f IS NOT NULL AND m.lineid = p.lineid AND m.direction = p.label
     AND f >= m.f0 AND (m.f1 IS NULL OR f < m.f1)""",
    "fx_meta": """
SELECT lineid, max(mode) AS mode, max(route_color) AS route_color, max(route_text_color) AS route_text_color
FROM fx_line_shape GROUP BY lineid""",
    "fx_label": """
SELECT lineid, pointid, arg_max(direction, {'s': sequence_idx, 'd': direction}) AS dir_label
FROM fx_line_stops GROUP BY lineid, pointid""",
    "fx_geojson": """
SELECT lineid, direction, '{"type":"LineString","coordinates":[' ||
       string_agg('[' || CAST(round(lon, 9) AS VARCHAR) || ',' || CAST(round(lat, 9) AS VARCHAR) || ']', ',' ORDER BY seq) || ']}' AS geometry
FROM fx_shape_point GROUP BY lineid, direction HAVING count(*) >= 2""",
    "fx_per_terminus": """
SELECT t.lineid, t.direction, coalesce(lt.destination, sp.stop_name_fr) AS destination, count(*) AS trips
FROM fx_trip t
LEFT JOIN fx_line_terminus lt ON lt.lineid = t.lineid AND lt.terminus_pointid = CAST(t.direction AS VARCHAR)
LEFT JOIN fx_stop sp ON sp.pointid = CAST(t.direction AS VARCHAR)
WHERE t.start_ts > (SELECT greatest(max(end_ts) - INTERVAL 7 DAY, min(start_ts)) FROM fx_trip)
GROUP BY t.lineid, t.direction, lt.destination, sp.stop_name_fr""",
    "fx_ranking": """
SELECT *, row_number() OVER (PARTITION BY lineid ORDER BY trips DESC, destination NULLS LAST, direction) AS rn
FROM (SELECT lineid, destination, CAST(sum(trips) AS BIGINT) AS trips,
             arg_max(direction, {'t': trips, 'd': -direction}) AS direction
      FROM fx_per_terminus GROUP BY lineid, coalesce(destination, 'dir_' || direction), destination) a""",
    "fx_gtfs_trip": """
SELECT 'R' || lineid AS route_id, CAST(o_orderkey % 2 AS INTEGER) AS direction_id,
       lineid || CASE WHEN (o_orderkey + CASE WHEN (o_orderkey // 2 + o_custkey) % 3 = 0 THEN 1 ELSE 0 END) % 2 = 0 THEN '_City' ELSE '_Suburb' END AS shape_id,
       o_orderkey AS row_no
FROM orders JOIN fx_line_stops ON c_custkey = o_custkey""",
    "fx_gtfs_vertex": """
SELECT lineid || '_' || direction AS shape_id,
       CASE WHEN nk % 3 = 1 THEN -sequence_idx ELSE sequence_idx * 10 END AS seq,
       4.3e0 + nk * 0.004e0 + sequence_idx * 0.003e0 AS lon,
       50.8001e0 + par * 0.02e0 + (sequence_idx % 3) * 0.001e0 + CASE WHEN nk % 7 = 2 THEN 1e0 ELSE 0e0 END AS lat
FROM fx_line_stops""",
    "fx_canonical": """
SELECT route_id, direction_id, shape_id, trips
FROM (SELECT *, row_number() OVER (PARTITION BY route_id, direction_id ORDER BY trips DESC, seen) AS rn
      FROM (SELECT route_id, direction_id, shape_id, count(*) AS trips, min(row_no) AS seen
            FROM fx_gtfs_trip GROUP BY ALL) a) b WHERE rn = 1""",
    "fx_polyline": """
SELECT * FROM (SELECT shape_id, row_number() OVER (PARTITION BY shape_id ORDER BY seq, lon, lat) AS idx, lon, lat,
                      count(*) OVER (PARTITION BY shape_id) AS n_points
               FROM fx_gtfs_vertex WHERE shape_id IN (SELECT shape_id FROM fx_canonical)) a WHERE n_points >= 2""",
}

# Stops and vertices that lack coordinates, for the positions of pings only.
VIEWS["fx_patchy_stop"] = """
SELECT pointid, CASE WHEN CAST(pointid AS BIGINT) % 11 <> 10 THEN lon END AS lon, CASE WHEN CAST(pointid AS BIGINT) % 11 <> 10 THEN lat END AS lat
FROM fx_stop"""
VIEWS["fx_patchy_shape_point"] = """
SELECT p.lineid, p.direction, p.seq, CASE WHEN l.nk % 6 <> 4 THEN lon END AS lon, CASE WHEN l.nk % 6 <> 4 THEN lat END AS lat
FROM fx_shape_point p JOIN (SELECT DISTINCT lineid, nk FROM fx_line_stops) l ON l.lineid = p.lineid"""
PATCHY = ("stop", "shape_point", "segment", "measured", "stop_fraction", "position")
for _view in PATCHY[2:]:
    VIEWS[f"fx_patchy_{_view}"] = re.sub(rf"\bfx_({'|'.join(PATCHY)})\b", r"fx_patchy_\1", VIEWS[f"fx_{_view}"])
VIEWS["fx_patchy_stop_fraction"] = VIEWS["fx_patchy_stop_fraction"].replace("JOIN fx_patchy_stop s ON s.pointid = l.pointid", "JOIN fx_patchy_stop s ON s.pointid = l.pointid AND s.lon IS NOT NULL")

AT = "(SELECT max(end_ts) - INTERVAL 2 HOUR FROM fx_trip)"
HAVERSINE = ("2 * 6371000e0 * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * "
             "cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))")
VALUE_AT = f"""
SELECT s.trip_id, s.lineid, s.direction,
       s.lon + coalesce((s.lon2 - s.lon) * f, 0) AS lon, s.lat + coalesce((s.lat2 - s.lat) * f, 0) AS lat
FROM (SELECT *, (epoch_us(AT_TS) - epoch_us(ts)) / CAST(epoch_us(ts2) - epoch_us(ts) AS DOUBLE) AS f
      FROM (SELECT *, lead(ts) OVER p AS ts2, lead(lon) OVER p AS lon2, lead(lat) OVER p AS lat2
            FROM fx_trip_instant WINDOW p AS (PARTITION BY trip_id ORDER BY ts)) a) s
WHERE s.ts <= AT_TS AND (AT_TS < s.ts2 OR (s.ts2 IS NULL AND s.ts = AT_TS))"""


def _value_at(at: str) -> str:
    return VALUE_AT.replace("AT_TS", at)


def _before_end(hours: int) -> str:
    return f"(SELECT max(end_ts) - INTERVAL {hours} HOUR FROM fx_trip)"


LINE_NUMBER = ("lineid || '_' || lpad(CAST(row_number() OVER (PARTITION BY lineid, service_day ORDER BY start_ts, trip_id) "
               "AS VARCHAR), 3, '0')")
ACTIVE = f"start_ts < {AT} + INTERVAL 30 MINUTE AND end_ts >= {AT} - INTERVAL 30 MINUTE"
SAMPLES_INSIDE = f"ts >= {_before_end(30)} AND ts < {_before_end(6)}"

MICRO = "CAST(CAST(round({} * 1e6) AS BIGINT) AS VARCHAR)"

SHAPE_DIRECTION = f"""
SELECT route_id, direction_id, shape_id, lineid, CASE WHEN em <= 500 THEN el WHEN sm <= 500 THEN sl END AS dir_label,
       round(CASE WHEN em <= 500 THEN em WHEN sm <= 500 THEN sm END, 3) AS metres,
       CASE WHEN em <= 500 THEN false WHEN sm <= 500 THEN true END AS reverse,
       CASE WHEN n IS NULL THEN 'short' WHEN k = 0 THEN 'no_terminus' WHEN em <= 500 OR sm <= 500 THEN NULL ELSE 'far' END AS skipped
FROM (SELECT route_id, direction_id, shape_id, lineid, max(n) AS n, count(pid) AS k,
             min(em) AS em, arg_min(lab, {{'m': em, 'p': pid, 'l': lab}}) AS el, min(sm) AS sm, arg_min(lab, {{'m': sm, 'p': pid, 'l': lab}}) AS sl
      FROM (SELECT c.*, substr(c.route_id, 2) AS lineid, e.n_points AS n, t.terminus_pointid AS pid, t.direction AS lab,
                   {HAVERSINE.format(a='e.', b='t.')} AS em, {HAVERSINE.format(a='s.', b='t.')} AS sm
            FROM fx_canonical c
            LEFT JOIN fx_polyline e ON e.shape_id = c.shape_id AND e.idx = e.n_points
            LEFT JOIN fx_polyline s ON s.shape_id = c.shape_id AND s.idx = 1
            LEFT JOIN (SELECT t.lineid, t.direction, t.terminus_pointid, s.lon, s.lat FROM fx_line_terminus t
                       JOIN fx_stop s ON s.pointid = t.terminus_pointid) t ON t.lineid = substr(c.route_id, 2)) a
      GROUP BY route_id, direction_id, shape_id, lineid) b"""

LINKING = f"""
WITH_RECURSIVE p AS MATERIALIZED (SELECT position_id, lineid, direction AS dir, epoch_us(poll_ts) AS us, lon, lat FROM fx_position WHERE lon IS NOT NULL),
g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY lineid, dir ORDER BY us, lon, lat, position_id) <= 300000000 THEN 0 ELSE 1 END AS brk FROM p),
i AS (SELECT *, sum(brk) OVER (PARTITION BY lineid, dir ORDER BY us, lon, lat, position_id ROWS UNBOUNDED PRECEDING) AS isl FROM g),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lineid, dir, isl ORDER BY us, lon, lat, position_id) AS rn FROM i),
w AS (
 SELECT lineid, dir, isl, rn, 1 AS trip, us, position_id, [{{'k': 1, 'us': us, 'lon': lon, 'lat': lat}}] AS st FROM n WHERE rn = 1
 UNION ALL
 SELECT lineid, dir, isl, rn, trip, us, position_id,
  CASE WHEN trip > len(st) THEN list_append(st, {{'k': trip, 'us': us, 'lon': lon, 'lat': lat}})
       ELSE list_transform(st, lambda s: CASE WHEN s.k = trip THEN {{'k': trip, 'us': us, 'lon': lon, 'lat': lat}} ELSE s END) END AS st
 FROM (SELECT n.lineid, n.dir, n.isl, n.rn, n.us, n.lon, n.lat, n.position_id, w.st,
   coalesce(list_sort(list_filter(list_transform(w.st, lambda s: {{'d': CASE WHEN n.us > s.us AND n.us - s.us <= 300000000 THEN
     {HAVERSINE.format(a='s.', b='n.')} ELSE 1e9 END, 'k': s.k}}), lambda z: z.d <= 500))[1].k, len(w.st) + 1) AS trip
   FROM w JOIN n ON n.lineid = w.lineid AND n.dir = w.dir AND n.isl = w.isl AND n.rn = w.rn + 1) u),
t AS (SELECT lineid, dir, isl, trip, arg_min(position_id, us) AS head, min(us) AS start_ts, max(us) AS end_ts,
             CAST(count(*) AS INTEGER) AS point_count FROM w GROUP BY lineid, dir, isl, trip HAVING count(*) >= 2)
SELECT substr(sha256('local|' || head), 1, 32) AS trip_id, substr(sha256('vehicle|' || head), 1, 32) AS vehicle_uuid,
       lineid, dir AS direction, start_ts, end_ts, point_count FROM t"""

PATCHY_LINKING = LINKING.replace("fx_position", "fx_patchy_position")

ETA_ORDER = "poll_ts DESC, expected NULLS LAST, lineid NULLS LAST, destination NULLS LAST, message NULLS LAST"
ETA = "epoch_us(poll_ts) AS poll_ts, lineid, epoch_us(expected) AS expected, destination, message"
TILE = ("SELECT z, pointid, stop_name_fr, stop_name_nl, (lon / 360e0 + 0.5e0) * pow(2e0, z) AS ux, "
        "(0.5e0 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi())) * pow(2e0, z) AS uy FROM fx_stop, (VALUES (10), (12), (14)) v(z)")

# Clip bounds of a segment along one axis, as shares of its length.
ENTER = "CASE WHEN {d} > 0 THEN (-64e0 - {a}) / {d} WHEN {d} < 0 THEN (4160e0 - {a}) / {d} ELSE 0e0 END"
LEAVE = "CASE WHEN {d} > 0 THEN (4160e0 - {a}) / {d} WHEN {d} < 0 THEN (-64e0 - {a}) / {d} ELSE 1e0 END"
TILE_LINES = f"""
WITH_VIEWS v AS (SELECT lineid, direction, seq, lon / 360e0 + 0.5e0 AS ux, 0.5e0 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi()) AS uy FROM fx_shape_point),
box AS (SELECT lineid, direction, min(ux) AS w, max(ux) AS e, min(uy) AS n, max(uy) AS s FROM v GROUP BY ALL),
s AS (SELECT lineid, direction, seq - 1 AS seq, z, round_even(ux * pow(2e0, z) * 4096, 0) AS xa, round_even(uy * pow(2e0, z) * 4096, 0) AS ya,
             round_even(ux2 * pow(2e0, z) * 4096, 0) AS xb, round_even(uy2 * pow(2e0, z) * 4096, 0) AS yb
      FROM (SELECT *, lead(ux) OVER w AS ux2, lead(uy) OVER w AS uy2 FROM v WINDOW w AS (PARTITION BY lineid, direction ORDER BY seq)) a,
           (VALUES (11), (13)) zooms(z) WHERE ux2 IS NOT NULL),
x AS (SELECT *, unnest(range(CAST(floor((least(xa, xb) - 64) / 4096) AS BIGINT), CAST(floor((greatest(xa, xb) + 64) / 4096) AS BIGINT) + 1)) AS x
      FROM s WHERE xa <> xb OR ya <> yb),
y AS (SELECT *, unnest(range(CAST(floor((least(ya, yb) - 64) / 4096) AS BIGINT), CAST(floor((greatest(ya, yb) + 64) / 4096) AS BIGINT) + 1)) AS y FROM x),
p AS (SELECT y.* EXCLUDE (xa, ya, xb, yb), xa - x * 4096 AS xa, ya - y * 4096 AS ya, xb - x * 4096 AS xb, yb - y * 4096 AS yb, xb - xa AS dx, yb - ya AS dy
      FROM y JOIN box b ON b.lineid = y.lineid AND b.direction = y.direction AND b.w * pow(2e0, z) <= x + 1 AND b.e * pow(2e0, z) >= x
       AND b.n * pow(2e0, z) <= y + 1 AND b.s * pow(2e0, z) >= y),
c AS (SELECT *, greatest(0e0, {ENTER.format(a='xa', d='dx')}, {ENTER.format(a='ya', d='dy')}) AS t0,
             least(1e0, {LEAVE.format(a='xa', d='dx')}, {LEAVE.format(a='ya', d='dy')}) AS t1
      FROM p WHERE (dx <> 0 OR xa BETWEEN -64 AND 4160) AND (dy <> 0 OR ya BETWEEN -64 AND 4160)),
r AS (SELECT *, CAST(round_even(xa + dx * t0, 0) AS INTEGER) AS xa_, CAST(round_even(ya + dy * t0, 0) AS INTEGER) AS ya_,
             CAST(round_even(xa + dx * t1, 0) AS INTEGER) AS xb_, CAST(round_even(ya + dy * t1, 0) AS INTEGER) AS yb_ FROM c WHERE t0 < t1)
SELECT r.z, r.x, r.y, r.lineid, r.direction, coalesce(h.mode, 'other') AS mode, h.route_color, h.route_text_color, h.variant,
       CAST(r.seq AS BIGINT) AS seq, xa_ AS x0, ya_ AS y0, xb_ AS x1, yb_ AS y1
FROM r LEFT JOIN fx_line_shape h ON h.lineid = r.lineid AND h.direction = r.direction WHERE xa_ <> xb_ OR ya_ <> yb_"""

# Simplification one vertex at a time: the state is the list of vertices left, each
# with the size of its triangle (lv) and the steps since a triangle set it (dp).
TRIANGLE = "abs(({b}.mx - {a}.mx) * ({c}.my - {a}.my) - ({c}.mx - {a}.mx) * ({b}.my - {a}.my)) / 2"
SIMPLIFIED = f"""
v0 AS MATERIALIZED (SELECT lineid, direction, seq, lon / 360e0 + 0.5e0 AS ux, 0.5e0 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi()) AS uy FROM fx_shape_point),
m0 AS (SELECT lineid, direction, seq, {{'i': seq, 'mx': ux * 40075016.685578488e0, 'my': uy * 40075016.685578488e0}} AS q FROM v0),
n0 AS (SELECT *, lag(q) OVER o AS a, lead(q) OVER o AS c FROM m0 WINDOW o AS (PARTITION BY lineid, direction ORDER BY seq)),
w AS (
 SELECT lineid, direction, 0 AS step,
        list({{'lv': CASE WHEN a IS NULL OR c IS NULL THEN 1e300 ELSE {TRIANGLE.format(a='a', b='q', c='c')} END, 'dp': 0, 'i': q.i, 'mx': q.mx, 'my': q.my}} ORDER BY seq) AS st
 FROM n0 GROUP BY lineid, direction
 UNION ALL
 SELECT lineid, direction, step + 1,
        list_transform(r, lambda p, i: CASE
          WHEN (i = m - 1 OR i = m) AND i > 1 AND i < len(r) AND {TRIANGLE.format(a='r[i - 1]', b='p', c='r[i + 1]')} > out.lv
            THEN {{'lv': {TRIANGLE.format(a='r[i - 1]', b='p', c='r[i + 1]')}, 'dp': 0, 'i': p.i, 'mx': p.mx, 'my': p.my}}
          WHEN (i = m - 1 OR i = m) AND i > 1 AND i < len(r) THEN {{'lv': out.lv, 'dp': out.dp + 1, 'i': p.i, 'mx': p.mx, 'my': p.my}}
          ELSE p END)
 FROM (SELECT *, st[m] AS out, list_filter(st, lambda p, i: i <> m) AS r
       FROM (SELECT *, list_sort(list_transform(st, lambda p, i: {{'lv': p.lv, 'dp': p.dp, 'i': p.i, 'pos': i}}))[1].pos AS m FROM w) a) b
 WHERE out.lv < 4),
kept AS (SELECT lineid, direction, unnest(arg_max(list_transform(st, lambda p: p.i), step)) AS seq FROM w GROUP BY lineid, direction),
v AS (SELECT v0.* FROM v0 JOIN kept USING (lineid, direction, seq)),
"""

# Clipped segments stitched along the line: gaps and islands by seq.
STITCHED = """,
marked AS (SELECT *, CASE WHEN lag(x1) OVER w = x0 AND lag(y1) OVER w = y0 THEN 0 ELSE 1 END AS fresh
           FROM flat WINDOW w AS (PARTITION BY z, x, y, lineid, direction ORDER BY seq)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY z, x, y, lineid, direction ORDER BY seq) AS part FROM marked),
parts AS (SELECT z, x, y, lineid, direction, mode, route_color, route_text_color, variant, part,
                 arg_min(x0 || ' ' || y0, seq) || ',' || string_agg(x1 || ' ' || y1, ',' ORDER BY seq) AS points FROM islands GROUP BY ALL),
feature AS (SELECT * EXCLUDE (part, points), count(*) AS n_parts, string_agg(points, ';' ORDER BY part) AS geometry FROM parts GROUP BY ALL)"""


def _stitched(segments: str) -> str:
    head, _, tail = segments.rpartition("\nSELECT r.z")
    return f"{head},\nflat AS (SELECT r.z{tail}){STITCHED}"


SQL = {
    "tile_lines": "WITH_RECURSIVE" + SIMPLIFIED + TILE_LINES[TILE_LINES.index("box AS ("):].replace("FROM v GROUP BY ALL", "FROM v0 GROUP BY ALL"),
    "tile_lines_unsimplified": TILE_LINES,
    "ping_coercion": """
SELECT substr(sha256(lineid || '|' || "directionId" || '|' || "pointId" || '|' || t || '|' ||
              CASE WHEN "distanceFromPoint" = 0 THEN 'None' ELSE CAST("distanceFromPoint" AS VARCHAR) END), 1, 32) AS position_id,
       lineid, "directionId" AS direction, "pointId" AS pointid, nullif("distanceFromPoint", 0) AS distance_from_point,
       t AS fetched_at_text
FROM (SELECT *, strftime(poll_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS t FROM fx_feed) a""",
    "ping_id": """
SELECT lineid, "directionId", "pointId", t AS poll_ts,
       substr(sha256(lineid || '|' || "directionId" || '|' || "pointId" || '|' || t || '|' || CAST("distanceFromPoint" AS VARCHAR)), 1, 32) AS position_id
FROM (SELECT *, strftime(poll_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS t FROM fx_feed) a""",
    "ping_dedup": "SELECT position_id, lineid, pointid FROM fx_ping",
    "line_direction_counts": """
SELECT lineid, CAST("directionId" AS INTEGER) AS direction, count(*) AS pings FROM fx_feed GROUP BY ALL""",
    "ping_geometry": """
SELECT position_id, lineid, direction, pointid, epoch_us(poll_ts) AS fetched_at, round(lon, 6) AS lon, round(lat, 6) AS lat
FROM fx_patchy_position""",
    "trip_linking": PATCHY_LINKING,
    "trip_linking_in_chunks": PATCHY_LINKING,
    "trip_linking_online": PATCHY_LINKING,
    "position_stream": """
SELECT position_id, lineid, direction, pointid, epoch_us(poll_ts) AS fetched_at, round(lon, 6) AS lon, round(lat, 6) AS lat
FROM fx_position""",
    "replay_counts": LINKING[:LINKING.index("SELECT substr(sha256('local|'")] + "SELECT 'trips' AS table_name, count(*) AS n FROM t " + " ".join(
        f"UNION ALL SELECT '{name}', count(*) FROM {view}" for name, view in (
            ("positions", "fx_position"), ("stops", "fx_stop"), ("line_shapes", "fx_line_shape"),
            ("waiting_times", "(SELECT DISTINCT * FROM fx_waiting_time) d"))),
    "mirror_round_trip": """
SELECT substr(sha256(lineid || '|' || "directionId" || '|' || "pointId" || '|' || t || '|' || CAST("distanceFromPoint" AS VARCHAR)), 1, 32) AS position_id,
       lineid, "directionId" AS direction, "pointId" AS pointid, "distanceFromPoint" AS distance_from_point, t AS fetched_at_text
FROM (SELECT *, strftime(poll_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS t FROM fx_feed) a""",
    "waiting_times_appended": """
SELECT pointid, lineid, 2 * count(*) AS n, epoch_us(max(poll_ts)) AS latest FROM fx_waiting_time GROUP BY pointid, lineid""",
    "replay_contents": f"""
SELECT 'stops' AS table_name, pointid || '|' || stop_name_fr || '|' || coalesce(stop_name_nl, '-') || '|' || {MICRO.format('lon')} || '|' || {MICRO.format('lat')} AS content FROM fx_stop
UNION ALL SELECT 'line_stops', lineid || '|' || direction || '|' || sequence_idx || '|' || pointid || '|' || coalesce(destination, '-') FROM fx_line_stops
UNION ALL SELECT 'line_terminus', lineid || '|' || terminus_pointid || '|' || direction || '|' || coalesce(destination, '-') FROM fx_line_terminus
UNION ALL SELECT 'line_shapes', lineid || '|' || direction || '|' || variant || '|' || coalesce(mode, '-') || '|' || route_color FROM fx_line_shape
UNION ALL SELECT 'shape_points', lineid || '|' || direction || '|' || seq || '|' || {MICRO.format('lon')} || '|' || {MICRO.format('lat')} FROM fx_shape_point
UNION ALL SELECT 'positions', position_id || '|' || lineid || '|' || pointid || '|' || epoch_us(poll_ts) || '|' || coalesce({MICRO.format('lon')}, '-') || '|' || coalesce({MICRO.format('lat')}, '-') FROM fx_position
UNION ALL SELECT 'positions', 'given-' || pointid || '|1|' || pointid || '|1704067200000000|4500000|50500000' FROM fx_stop
UNION ALL SELECT 'waiting_times', epoch_us(poll_ts) || '|' || pointid || '|' || lineid || '|' || coalesce(CAST(epoch_us(expected) AS VARCHAR), '-') || '|' || coalesce(destination, '-') || '|' || coalesce(message, '-') FROM fx_waiting_time""",
    "gtfs_load": f"""
SELECT w.lineid, w.direction, w.direction_id AS variant,
       CASE nk % 9 WHEN 0 THEN 'tram' WHEN 1 THEN 'metro' WHEN 2 THEN 'rail' WHEN 3 THEN 'bus' WHEN 7 THEN 'funicular' ELSE 'other' END AS mode,
       p.n_points, round(p.lon, 6) AS lon, round(p.lat, 6) AS lat
FROM (SELECT d.lineid, d.dir_label AS direction, arg_max({{'d': d.direction_id, 's': d.shape_id, 'r': d.reverse}}, f.first_row) AS pick
      FROM ({SHAPE_DIRECTION}) d
      JOIN (SELECT route_id, direction_id, min(row_no) AS first_row FROM fx_gtfs_trip GROUP BY ALL) f
        ON f.route_id = d.route_id AND f.direction_id = d.direction_id
      WHERE d.skipped IS NULL GROUP BY ALL) q,
     LATERAL (SELECT q.lineid, q.direction, q.pick.d AS direction_id, q.pick.s AS shape_id, q.pick.r AS reverse) w
JOIN fx_polyline p ON p.shape_id = w.shape_id AND p.idx = CASE WHEN w.reverse THEN p.n_points ELSE 1 END
JOIN (SELECT DISTINCT lineid, nk FROM fx_line_stops) l ON l.lineid = w.lineid""",
    "live_payload": """
SELECT substr(sha256(lineid || '|' || "directionId" || '|' || "pointId" || '|' || t || '|' || CAST("distanceFromPoint" AS VARCHAR)), 1, 32) AS position_id,
       lineid, "directionId" AS direction, "pointId" AS pointid, "distanceFromPoint" AS distance_from_point, t AS fetched_at_text
FROM (SELECT *, strftime(poll_ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS t FROM fx_feed) a""",
    "observed_stops": """
SELECT "pointId" AS pointid, arg_max("distanceFromPoint", k) AS lon, arg_max(CAST(length(lineid) AS DOUBLE), k) AS lat
FROM (SELECT *, {'t': poll_ts, 'i': lineid || '|' || "directionId" || '|' || CAST("distanceFromPoint" AS VARCHAR)} AS k FROM fx_feed) a GROUP BY "pointId" """,
    "insert_ignore": """
SELECT CAST(s_suppkey * 29 AS VARCHAR) AS pointid, s_name || ' v1' AS stop_name_fr, CAST(NULL AS VARCHAR) AS stop_name_nl,
       CAST(s_nationkey AS DOUBLE) AS lon, 1e0 AS lat FROM supplier WHERE CAST(s_suppkey * 29 AS VARCHAR) NOT IN (SELECT pointid FROM fx_stop)""",
    "upsert_last_wins": """
SELECT pointid, stop_name_fr, stop_name_nl, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_stop
WHERE pointid NOT IN (SELECT CAST(s_suppkey * 29 AS VARCHAR) FROM supplier)
UNION ALL SELECT CAST(s_suppkey * 29 AS VARCHAR), s_name || ' v2', NULL, CAST(s_nationkey AS DOUBLE), 2e0 FROM supplier""",
    "upsert_coordinates": """
SELECT coalesce(s.pointid, u.pointid) AS pointid, s.stop_name_fr, s.stop_name_nl,
       round(CASE WHEN u.pointid IS NOT NULL THEN u.lon ELSE s.lon END, 6) AS lon, round(CASE WHEN u.pointid IS NOT NULL THEN 2e0 ELSE s.lat END, 6) AS lat
FROM fx_stop s FULL JOIN (SELECT CAST(s_suppkey * 29 AS VARCHAR) AS pointid, CAST(s_nationkey AS DOUBLE) AS lon FROM supplier) u ON u.pointid = s.pointid""",
    "ping_outcomes": """
SELECT CASE lineid WHEN '1' THEN 'direction' WHEN '2' THEN 'no direction' WHEN '3' THEN 'fetched_at' ELSE 'kept' END AS outcome, count(*) AS pings
FROM fx_feed GROUP BY 1""",
    "stop_documents": """
SELECT CAST(c_custkey AS VARCHAR) AS pointid, c_name AS stop_name_fr, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS stop_name_nl,
       CAST(c_custkey % 180 AS DOUBLE) AS lon, CAST(c_custkey % 90 AS DOUBLE) AS lat
FROM customer WHERE CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 90 <> 0 ELSE c_custkey % 9 <> 0 END""",
    "line_documents": """
SELECT lineid, direction || '-' || block AS direction,
       CAST(CASE WHEN block % 2 = 0 THEN sequence_idx ELSE (sequence_idx - 1) % 100 + 1 END AS INTEGER) AS sequence_idx, pointid, destination
FROM (SELECT *, (sequence_idx - 1) // 100 AS block FROM fx_line_stops) a""",
    "document_termini": "SELECT * FROM fx_line_terminus",
    "segment_lengths": f"""
SELECT lineid, direction, seq, round({HAVERSINE.format(a='', b='').replace("lon - lon", "lon2 - lon1").replace("lat - lat", "lat2 - lat1").replace("cos(radians(lat)) * cos(radians(lat))", "cos(radians(lat1)) * cos(radians(lat2))")}, 4) AS haversine,
       round(metres, 4) AS metres FROM fx_segment""",
    "point_at_fraction": """
SELECT l.lineid, l.direction AS dir_label, l.pointid, l.f AS fraction,
       round(m.lon1 + (m.lon2 - m.lon1) * least(1, (f - m.f0) * m.total / m.planar), 6) AS on_lon,
       round(m.lat1 + (m.lat2 - m.lat1) * least(1, (f - m.f0) * m.total / m.planar), 6) AS on_lat
FROM (SELECT *, (c_custkey % 101) / 100e0 AS f FROM fx_line_stops) l
JOIN fx_measured m ON m.lineid = l.lineid AND m.direction = l.direction AND f >= m.f0 AND (m.f1 IS NULL OR f < m.f1)""",
    "trip_extent": "SELECT trip_id, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, point_count FROM fx_trip",
    "trips_direction_filter": """
SELECT trip_id, lineid, direction FROM fx_trip WHERE direction = (SELECT max(direction) FROM fx_trip)""",
    "trips_between": f"""
SELECT trip_id, lineid, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts FROM fx_trip
WHERE start_ts < {_before_end(3)} AND end_ts > {_before_end(9)}""",
    "recent_cutoff": """
SELECT epoch_us(greatest(max(end_ts) - INTERVAL 3 DAY, min(start_ts))) AS cutoff FROM fx_trip""",
    "line_order": """
SELECT lineid, mode, CASE coalesce(mode, 'other') WHEN 'metro' THEN 1 WHEN 'tram' THEN 2 WHEN 'bus' THEN 3 ELSE 6 END AS mode_rank,
       TRY_CAST(lineid AS BIGINT) IS NULL AS is_text, TRY_CAST(lineid AS BIGINT) AS number FROM fx_meta""",
    "shape_length": """
SELECT lineid, direction, round(sum(metres), 3) AS length_m, round(sum(planar), 6) AS planar_total,
       count(*) FILTER (WHERE planar > 0) AS n_segments FROM fx_segment GROUP BY lineid, direction""",
    "stop_fraction": "SELECT lineid, direction, pointid, round(fraction, 6) AS fraction FROM fx_stop_fraction",
    "line_centroid": """
SELECT lineid, direction, round(sum(planar * (lon1 + lon2) / 2) / sum(planar), 6) AS lon,
       round(sum(planar * (lat1 + lat2) / 2) / sum(planar), 6) AS lat FROM fx_segment GROUP BY lineid, direction""",
    "shape_geojson": "SELECT lineid, direction, CAST(0 AS BIGINT) AS part, geometry FROM fx_geojson",
    "shape_lookup": """
SELECT t.lineid, t.direction, s.mode, s.route_color, s.route_text_color, s.lineid || '_' || s.direction AS shape_id, g.geometry
FROM (SELECT lineid, direction FROM fx_line_terminus UNION SELECT lineid, 'Depot' FROM fx_line_terminus) t
LEFT JOIN fx_line_shape s ON s.lineid = t.lineid AND s.direction = t.direction
LEFT JOIN fx_geojson g ON g.lineid = t.lineid AND g.direction = t.direction""",
    "trip_assembly": """
SELECT trip_id, lineid, direction, part, start_ts, end_ts, point_count,
       string_agg(epoch_us(ts) || ' ' || CAST(round(lon, 6) AS VARCHAR) || ' ' || CAST(round(lat, 6) AS VARCHAR), ';' ORDER BY ts) AS samples
FROM (SELECT *, epoch_us(ts) // 3600000000 AS part, epoch_us(min(ts) OVER t) AS start_ts, epoch_us(max(ts) OVER t) AS end_ts,
             CAST(count(*) OVER t AS INTEGER) AS point_count
      FROM fx_trip_instant WINDOW t AS (PARTITION BY trip_id, lineid, direction)) s
GROUP BY ALL""",
    "value_at_instant": f"""
SELECT trip_id, lineid, direction, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ({_value_at(AT)}) v""",
    "value_at_many_instants": """
SELECT ask_id, trip_id, at_us AS at_ts, round(lon + coalesce((lon2 - lon) * ((at_us - us) / CAST(us2 - us AS DOUBLE)), 0), 6) AS lon,
       round(lat + coalesce((lat2 - lat) * ((at_us - us) / CAST(us2 - us AS DOUBLE)), 0), 6) AS lat
FROM (SELECT event_id AS ask_id, CAST(event_id AS VARCHAR) AS trip_id,
             event_id * 47000000 + 1704067200000000 + (event_id * 37 % 2000) * 1000000 AS at_us FROM events) e
JOIN (SELECT trip_id, epoch_us(ts) AS us, lon, lat, lead(epoch_us(ts)) OVER p AS us2, lead(lon) OVER p AS lon2, lead(lat) OVER p AS lat2
      FROM fx_trip_instant WINDOW p AS (PARTITION BY trip_id ORDER BY ts)) s USING (trip_id)
WHERE us <= at_us AND (at_us < us2 OR (us2 IS NULL AND us = at_us))""",
    "trip_samples_in_window": f"""
SELECT trip_id, lineid, direction, epoch_us(ts) AS ts, round(lon, 6) AS lon, round(lat, 6) AS lat
FROM fx_trip_instant WHERE {SAMPLES_INSIDE}""",
    "trip_samples_clipped": f"""
SELECT trip_id, lineid, direction, epoch_us(ts) AS ts, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_trip_instant WHERE {SAMPLES_INSIDE}
UNION SELECT trip_id, lineid, direction, epoch_us({_before_end(30)}), round(lon, 6), round(lat, 6) FROM ({_value_at(_before_end(30))}) a
UNION SELECT trip_id, lineid, direction, epoch_us({_before_end(6)}), round(lon, 6), round(lat, 6) FROM ({_value_at(_before_end(6))}) b""",
    "trips_line_filter": """
SELECT trip_id, lineid, direction, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, point_count
FROM fx_trip WHERE lineid IN ('1', '10', 'N7')""",
    "trips_active_window": f"""
SELECT trip_id, lineid, direction, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts FROM fx_trip WHERE {ACTIVE}""",
    "resolve_window": """
SELECT epoch_us(max(end_ts) - INTERVAL 90 MINUTE) AS w_start, epoch_us(max(end_ts)) AS w_end FROM fx_trip""",
    "trips_all": f"""
SELECT trip_id, lineid, direction, epoch_us(start_ts) AS start_ts, epoch_us(end_ts) AS end_ts, point_count,
       NULL AS line_trip_id, CAST(NULL AS BIGINT) AS daily_trip_seq
FROM fx_trip WHERE end_ts > {_before_end(1)}
UNION ALL
SELECT trip_id, lineid, direction, epoch_us(start_ts), epoch_us(end_ts), point_count, {LINE_NUMBER},
       row_number() OVER (PARTITION BY lineid, service_day ORDER BY start_ts, trip_id)
FROM fx_numbered_trip WHERE end_ts <= {_before_end(1)}""",
    "service_day_trip_number": f"""
SELECT trip_id, lineid, strftime(service_day, '%Y-%m-%d') AS service_day,
       row_number() OVER (PARTITION BY lineid, service_day ORDER BY start_ts, trip_id) AS daily_trip_seq,
       {LINE_NUMBER} AS line_trip_id FROM fx_numbered_trip""",
    "line_metadata": "SELECT * FROM fx_meta",
    "line_destinations": """
SELECT lineid, string_agg(destination, '|' ORDER BY destination) AS destinations
FROM (SELECT DISTINCT lineid, destination FROM fx_line_stops WHERE destination IS NOT NULL) a GROUP BY lineid""",
    "trips_per_terminus": "SELECT * FROM fx_per_terminus",
    "direction_ranking": "SELECT * FROM fx_ranking",
    "line_catalogue": """
SELECT m.lineid, coalesce(m.mode, 'other') AS mode, m.route_color, m.route_text_color,
       coalesce(d.destinations, '') AS destinations, coalesce(r.directions_detail, '') AS directions_detail
FROM fx_meta m
LEFT JOIN (SELECT lineid, string_agg(destination, '|' ORDER BY destination) AS destinations
           FROM (SELECT DISTINCT lineid, destination FROM fx_line_stops WHERE destination IS NOT NULL) a GROUP BY lineid) d ON d.lineid = m.lineid
LEFT JOIN (SELECT lineid, string_agg(direction || ':' || coalesce(destination, '-') || ':' || trips, '|' ORDER BY rn) AS directions_detail
           FROM fx_ranking WHERE rn <= 4 GROUP BY lineid) r ON r.lineid = m.lineid""",
    "direction_label": "SELECT * FROM fx_label",
    "terminus_locations": """
SELECT t.lineid, t.direction, t.terminus_pointid, round(s.lon, 6) AS lon, round(s.lat, 6) AS lat
FROM fx_line_terminus t JOIN fx_stop s ON s.pointid = t.terminus_pointid""",
    "stops_serving_lines": """
SELECT pointid, stop_name_fr, stop_name_nl, round(lon, 6) AS lon, round(lat, 6) AS lat FROM fx_stop s
WHERE EXISTS (SELECT 1 FROM fx_line_stops l WHERE l.pointid = s.pointid AND l.lineid IN ('1', '2', 'N7'))""",
    "stop_details": """
SELECT s.pointid, s.stop_name_fr, s.stop_name_nl, round(s.lon, 6) AS lon, round(s.lat, 6) AS lat, coalesce(l.lines, '') AS lines
FROM fx_stop s
LEFT JOIN (SELECT pointid, string_agg(a.lineid || ':' || coalesce(mode, '-') || ':' || coalesce(route_color, '-') || ':' || coalesce(dests, '-') || ':' || dirs, '|'
                             ORDER BY TRY_CAST(a.lineid AS BIGINT) NULLS LAST, a.lineid) AS lines
           FROM (SELECT pointid, lineid, string_agg(DISTINCT destination, ',' ORDER BY destination) AS dests,
                        string_agg(DISTINCT direction, ',' ORDER BY direction) AS dirs
                 FROM fx_line_stops GROUP BY pointid, lineid) a LEFT JOIN fx_meta m ON m.lineid = a.lineid GROUP BY pointid) l
  ON l.pointid = s.pointid""",
    "positions_at": f"""
SELECT v.trip_id, v.lineid, v.direction, a.line_trip_id, round(v.lon, 6) AS lon, round(v.lat, 6) AS lat,
       m.mode, m.route_color, m.route_text_color
FROM (SELECT trip_id, {LINE_NUMBER} AS line_trip_id FROM fx_numbered_trip WHERE {ACTIVE}) a
JOIN ({_value_at(AT)}) v ON v.trip_id = a.trip_id LEFT JOIN fx_meta m ON m.lineid = v.lineid""",
    "positions_at_limited": f"""
SELECT v.trip_id, v.lineid, v.direction, a.line_trip_id, round(v.lon, 6) AS lon, round(v.lat, 6) AS lat,
       m.mode, m.route_color, m.route_text_color
FROM (SELECT trip_id, {LINE_NUMBER} AS line_trip_id FROM fx_numbered_trip WHERE {ACTIVE}) a
JOIN ({_value_at(AT)}) v ON v.trip_id = a.trip_id LEFT JOIN fx_meta m ON m.lineid = v.lineid
ORDER BY v.lineid, a.line_trip_id, v.trip_id LIMIT 7""",
    "positions_at_service_day": f"""
SELECT v.trip_id, a.line_trip_id, round(v.lon, 6) AS lon, round(v.lat, 6) AS lat
FROM (SELECT trip_id, start_ts, end_ts, {LINE_NUMBER} AS line_trip_id FROM fx_numbered_trip) a
JOIN ({_value_at(AT)}) v ON v.trip_id = a.trip_id WHERE {ACTIVE}""",
    "trajectories": f"""
SELECT s.trip_id, s.lineid, l.dir_label, t.line_trip_id, 'local:' || s.lineid || ':' || l.dir_label AS shape_id,
       m.mode, m.route_color, CAST(epoch_us(s.ts) // 1000 AS BIGINT) AS t_ms, round(s.lon, 6) AS lon, round(s.lat, 6) AS lat
FROM (SELECT trip_id, {LINE_NUMBER} AS line_trip_id FROM fx_numbered_trip
      WHERE start_ts < {_before_end(2)} AND end_ts > {_before_end(26)}) t
JOIN fx_trip_instant s ON s.trip_id = t.trip_id AND s.ts >= {_before_end(26)} AND s.ts < {_before_end(2)}
LEFT JOIN fx_label l ON l.lineid = s.lineid AND l.pointid = CAST(s.direction AS VARCHAR)
LEFT JOIN fx_meta m ON m.lineid = s.lineid""",
    "trajectories_packed": f"""
SELECT s.trip_id, s.lineid, l.dir_label, t.line_trip_id, 'local:' || s.lineid || ':' || l.dir_label AS shape_id, m.mode,
       string_agg(CAST(epoch_us(s.ts) // 1000 AS VARCHAR) || ' ' || CAST(round(s.lon, 6) AS VARCHAR) || ' ' || CAST(round(s.lat, 6) AS VARCHAR), ';' ORDER BY s.ts) AS samples
FROM (SELECT trip_id, {LINE_NUMBER} AS line_trip_id FROM fx_numbered_trip
      WHERE start_ts < {_before_end(4)} AND end_ts > {_before_end(5)}) t
JOIN fx_trip_instant s ON s.trip_id = t.trip_id AND s.ts >= {_before_end(5)} AND s.ts < {_before_end(4)}
LEFT JOIN fx_label l ON l.lineid = s.lineid AND l.pointid = CAST(s.direction AS VARCHAR)
LEFT JOIN fx_meta m ON m.lineid = s.lineid GROUP BY ALL""",
    "waiting_times_for_stop": f"""
SELECT {ETA} FROM (SELECT * FROM fx_waiting_time WHERE pointid = '42' ORDER BY {ETA_ORDER} LIMIT 200) a""",
    "waiting_times_stored": f"""
SELECT {ETA} FROM (SELECT * FROM fx_waiting_time WHERE pointid = '42' ORDER BY {ETA_ORDER} LIMIT 200) a""",
    "waiting_times_per_stop": f"""
SELECT pointid, CAST(rn AS INTEGER) AS rn, {ETA}
FROM (SELECT *, row_number() OVER (PARTITION BY pointid ORDER BY {ETA_ORDER}) AS rn FROM fx_waiting_time) a WHERE rn <= 200""",
    "search": """
SELECT type, category, id, label, sub, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (
 SELECT * FROM (SELECT 'stop' AS type, 'Arrêt' AS category, pointid AS id, coalesce(stop_name_fr, stop_name_nl, pointid) AS label, pointid AS sub, lat, lon
  FROM fx_stop WHERE stop_name_fr ILIKE '%15%' OR stop_name_nl ILIKE '%15%' OR pointid ILIKE '%15%' ORDER BY label, id LIMIT 5) a
 UNION ALL
 SELECT 'line', 'Ligne', s.lineid, 'Ligne ' || s.lineid, coalesce(s.mode, ''), c.lat, c.lon
 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lineid ORDER BY direction) AS rn FROM fx_line_shape WHERE lineid ILIKE '%15%') b
       WHERE rn = 1 ORDER BY lineid LIMIT 5) s
 JOIN (SELECT lineid, direction, sum(planar * (lon1 + lon2) / 2) / sum(planar) AS lon, sum(planar * (lat1 + lat2) / 2) / sum(planar) AS lat
       FROM fx_segment GROUP BY lineid, direction) c ON c.lineid = s.lineid AND c.direction = s.direction) u""",
    "table_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS n FROM {view}" for name, view in (
            ("stops", "fx_stop"), ("line_stops", "fx_line_stops"), ("line_terminus", "fx_line_terminus"),
            ("line_shapes", "fx_line_shape"), ("trips", "fx_trip"), ("trip_samples", "fx_trip_instant"),
            ("waiting_times", "fx_waiting_time"), ("feed", "fx_feed"))),
    "canonical_shape": "SELECT * FROM fx_canonical",
    "polyline_assembly": "SELECT shape_id, idx, round(lon, 6) AS lon, round(lat, 6) AS lat, n_points FROM fx_polyline",
    "route_attributes": """
SELECT 'R' || lineid AS route_id, lineid,
       CASE nk % 9 WHEN 0 THEN 'tram' WHEN 1 THEN 'metro' WHEN 2 THEN 'rail' WHEN 3 THEN 'bus' WHEN 7 THEN 'funicular' ELSE 'other' END AS mode,
       CASE WHEN nk % 4 = 0 THEN '#AB12' || lpad(CAST(nk AS VARCHAR), 2, '0') END AS route_color,
       CASE WHEN nk % 2 = 1 THEN '#FFFFFF' END AS route_text_color
FROM (SELECT DISTINCT lineid, nk FROM fx_line_stops) a""",
    "shape_direction": SHAPE_DIRECTION,
    "tile_stops": f"""
SELECT z, x, y, pointid, stop_name_fr, stop_name_nl,
       CAST(round_even((ux - x) * 4096, 0) AS INTEGER) AS px, CAST(round_even((uy - y) * 4096, 0) AS INTEGER) AS py
FROM (SELECT *, unnest(range(CAST(ceil(uy) AS BIGINT) - 1, CAST(floor(uy) AS BIGINT) + 1)) AS y
      FROM (SELECT *, unnest(range(CAST(ceil(ux) AS BIGINT) - 1, CAST(floor(ux) AS BIGINT) + 1)) AS x FROM ({TILE}) t) a) b""",
}

SQL["tile_features"] = _stitched(SQL["tile_lines"]) + "\nSELECT * FROM feature"
# Quadkeys digit by digit, from the coarsest.
QUADKEY = "array_to_string(list_transform(range(CAST(z AS BIGINT) - 1, -1, -1), lambda k: CAST((x >> k) & 1 AS BIGINT) + 2 * CAST((y >> k) & 1 AS BIGINT)), '')"
SQL["tile_table"] = _stitched(TILE_LINES) + f"""
SELECT 'lines' AS layer, z, x, y, {QUADKEY} AS quadkey, lineid || '_' || direction AS feature_id, NULL AS stop_name_nl, mode, geometry FROM feature
UNION ALL
SELECT 'stops', z, x, y, {QUADKEY}, pointid, stop_name_nl, NULL, px || ' ' || py FROM ({SQL["tile_stops"].replace("(10), (12), (14)", "(11), (13)")}) s"""

# Pings before the watermark, linked; trips that may still be extended count with one ping.
WATERMARK = "(SELECT epoch_us(max(poll_ts)) - 120000000 FROM fx_patchy_position)"
_head, _, _ = PATCHY_LINKING.partition("\nt AS (")
SQL["positions_at_live"] = _head.replace("WHERE lon IS NOT NULL", f"WHERE lon IS NOT NULL AND epoch_us(poll_ts) < {WATERMARK}", 1) + f"""
m AS (SELECT *, {WATERMARK} AS wm FROM (SELECT w.lineid, w.dir, w.isl, w.trip, w.us, n.lon, n.lat, w.position_id FROM w JOIN n USING (lineid, dir, isl, rn)) a),
s AS (SELECT *, lead(us) OVER o AS us2, lead(lon) OVER o AS lon2, lead(lat) OVER o AS lat2, first_value(position_id) OVER o AS head,
             count(*) OVER g AS points, max(us) OVER g >= wm - 300000000 AS running
      FROM m WINDOW g AS (PARTITION BY lineid, dir, isl, trip), o AS (PARTITION BY lineid, dir, isl, trip ORDER BY us))
SELECT substr(sha256('local|' || head), 1, 32) AS trip_id, lineid, dir AS direction,
       round(lon + coalesce((lon2 - lon) * ((wm - 60000000 - us) / CAST(us2 - us AS DOUBLE)), 0), 6) AS lon,
       round(lat + coalesce((lat2 - lat) * ((wm - 60000000 - us) / CAST(us2 - us AS DOUBLE)), 0), 6) AS lat, running
FROM s WHERE (running OR points >= 2) AND us <= wm - 60000000 AND (wm - 60000000 < us2 OR (us2 IS NULL AND us = wm - 60000000))"""
SQL["positions_at_stored"], SQL["trajectories_stored"] = SQL["positions_at"], SQL["trajectories"]


def _needed(sql: str) -> list[str]:
    """Views the text uses, each after those it builds on."""
    found: list[str] = []
    for name, body in VIEWS.items():
        if re.search(rf"\b{name}\b", sql):
            found += [n for n in [*_needed(body), name] if n not in found]
    return found


def with_views(sql: str) -> str:
    if not _needed(sql):
        return sql.strip()
    views = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name].strip()})" for name in _needed(sql))
    for mark, start in (("WITH_RECURSIVE", "WITH RECURSIVE"), ("WITH_VIEWS", "WITH")):
        if sql.strip().startswith(mark):
            return f"{start} {views},\n{sql.strip().removeprefix(mark).strip()}"
    return f"WITH {views}\n{sql.strip()}"


# Every segment of every trip against the box and the window.
SQL["trips_in_box_and_window"] = f"""
SELECT trip_id, lineid, direction, min(CAST(round((t0 + s0 * dt) / 1000) AS BIGINT)) AS entered_ms, max(CAST(round((t0 + s1 * dt) / 1000) AS BIGINT)) AS left_ms
FROM (SELECT *, greatest(0e0, CASE WHEN dx <> 0 THEN least(w / dx, e / dx) END, CASE WHEN dy <> 0 THEN least(s / dy, n / dy) END, CASE WHEN dt <> 0 THEN least(a / dt, b / dt) END) AS s0,
             least(1e0, CASE WHEN dx <> 0 THEN greatest(w / dx, e / dx) END, CASE WHEN dy <> 0 THEN greatest(s / dy, n / dy) END, CASE WHEN dt <> 0 THEN greatest(a / dt, b / dt) END) AS s1
      FROM (SELECT *, 4.3205e0 - lon AS w, 4.3445e0 - lon AS e, 50.8085e0 - lat AS s, 50.8195e0 - lat AS n,
                   CAST(epoch_us({_before_end(30)}) - t0 AS DOUBLE) AS a, CAST(epoch_us({_before_end(6)}) - t0 AS DOUBLE) AS b,
                   coalesce(lon2 - lon, 0e0) AS dx, coalesce(lat2 - lat, 0e0) AS dy, CAST(coalesce(epoch_us(ts2) - t0, 0) AS DOUBLE) AS dt
            FROM (SELECT *, epoch_us(ts) AS t0, lead(ts) OVER p AS ts2, lead(lon) OVER p AS lon2, lead(lat) OVER p AS lat2
                  FROM fx_trip_instant WINDOW p AS (PARTITION BY trip_id ORDER BY ts)) f) g
      WHERE (dx <> 0 OR (w <= 0 AND e >= 0)) AND (dy <> 0 OR (s <= 0 AND n >= 0)) AND (dt <> 0 OR (a <= 0 AND b > 0))) h
WHERE s0 <= s1 AND (dt = 0 OR s0 * dt < b) GROUP BY trip_id, lineid, direction"""


SQL["load_report"] = """
SELECT * FROM (WITH bad AS (SELECT CASE lineid WHEN '1' THEN 'direction' WHEN '2' THEN 'no direction' ELSE 'fetched_at' END AS reason, count(*) AS n
             FROM fx_feed WHERE lineid IN ('1', '2', '3') GROUP BY 1),
good AS (SELECT CAST("pointId" AS BIGINT) % 11 = 10 AS unknown, f.* FROM fx_feed f WHERE lineid NOT IN ('1', '2', '3')),
tally AS (SELECT count(*) FILTER (WHERE unknown) AS unlocated, count(*) FILTER (WHERE NOT unknown) AS located FROM good),
ids AS (SELECT count(*) AS n FROM (SELECT DISTINCT lineid, "directionId", "pointId", "distanceFromPoint", poll_ts FROM good WHERE NOT unknown) d),
told AS (SELECT r.run, 'positions' AS step, 'rejected: ' || reason AS outcome, n FROM bad, (VALUES (1), (2)) r(run)
   UNION ALL SELECT r.run, 'dead_letters', reason, n FROM bad, (VALUES (1), (2)) r(run)
   UNION ALL SELECT r.run, 'positions', 'unlocated', unlocated FROM tally, (VALUES (1), (2)) r(run)
   UNION ALL SELECT 1, 'positions', 'inserted', n FROM ids
   UNION ALL SELECT 1, 'positions', 'known', located - n FROM tally, ids
   UNION ALL SELECT 2, 'positions', 'known', located FROM tally
   UNION ALL SELECT r.run, 'waiting_times', 'appended', (SELECT count(*) FROM fx_waiting_time) FROM (VALUES (1), (2)) r(run))
SELECT CAST(run AS INTEGER) AS run, step, outcome, n FROM told WHERE n > 0) q"""


def all_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in SQL.items()}
