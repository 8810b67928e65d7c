"""SQL counterparts of the registered queries, for DuckDB on the same tables.

Spatial searches are written as plain comparisons of all pairs, without any grid.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# ---- expressions ------------------------------------------------------------------


def _h(phi1: str, phi2: str, d_phi: str, d_lam: str) -> str:
    return (f"(pow(sin(({d_phi})/2), 2) + cos({phi1})*cos({phi2})*pow(sin(({d_lam})/2), 2))")


def hav(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    h = _h(f"radians({lat1})", f"radians({lat2})", f"radians(({lat2})-({lat1}))",
           f"radians(({lng2})-({lng1}))")
    return f"(2*6371000.0e0*asin(sqrt(least(1.0e0, {h}))))"


def geodesic_cte(name: str, source: str, lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """CTEs that end in ``name``: ``source`` with the spheroid distance ``d``."""
    f = "(1.0e0/298.257223563e0)"
    b = lambda lat: f"atan((1.0e0-{f})*tan(radians({lat})))"
    h = _h("b1", "b2", "b2-b1", f"radians(({lng2})-({lng1}))")
    x = "(s - sin(s)) * pow(sin((b1+b2)/2)*cos((b2-b1)/2)/cos(s/2), 2)"
    y = "(s + sin(s)) * pow(cos((b1+b2)/2)*sin((b2-b1)/2)/sin(s/2), 2)"
    return f"""
      {name}_b AS (SELECT *, {b(lat1)} AS b1, {b(lat2)} AS b2 FROM {source}),
      {name}_s AS (SELECT *, 2*asin(sqrt(least(1.0e0, {h}))) AS s FROM {name}_b),
      {name} AS (SELECT * EXCLUDE (b1, b2, s),
        CASE WHEN s = 0 THEN 0.0e0
             ELSE 6378137.0e0*(s - {f}/2*({x} + {y})) END AS d FROM {name}_s)"""


def hex_sql(lat: str, lng: str) -> str:
    """Scalar subquery for the hexagon cell."""
    x = f"(6371000.0e0*radians({lng})*cos(radians({lat})))"
    y = f"(6371000.0e0*radians({lat}))"
    return f"""(SELECT CAST(CAST(CASE WHEN dq>dr AND dq>ds THEN -rr-rs ELSE rq END AS BIGINT) AS VARCHAR)
        || ':' || CAST(CAST(CASE WHEN NOT (dq>dr AND dq>ds) AND dr>ds THEN -rq-rs ELSE rr END AS BIGINT) AS VARCHAR)
      FROM (SELECT rq, rr, rs, abs(rq-q) AS dq, abs(rr-r) AS dr, abs(rs-s) AS ds
      FROM (SELECT q, r, s, floor(q+0.5e0) AS rq, floor(r+0.5e0) AS rr, floor(s+0.5e0) AS rs
      FROM (SELECT q, r, -q-r AS s
      FROM (SELECT (sqrt(3.0e0)/3*{x} - {y}/3)/201.0e0 AS q, 2.0e0/3*{y}/201.0e0 AS r)))))"""


# ---- inputs -----------------------------------------------------------------------

SECONDS = "(epoch_us(ts)//1000000)"
MS = "(epoch_us(ts)//1000)"

CTES = {
    "trace": f"""SELECT event_id AS seq, 'trj-' || CAST(user_id AS VARCHAR) AS trj_id,
      CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'Motorcycle'
        WHEN 'error' THEN NULL ELSE event_type END AS driving_mode,
      CASE WHEN event_id%2=0 THEN 'android' ELSE 'ios' END AS osname,
      {SECONDS} AS pingtimestamp,
      CASE WHEN event_id%101=0 THEN 95.0e0 WHEN event_id%103=0 THEN NULL
        ELSE (120000+(event_id*7919)%27000)/100000.0e0 END AS rawlat,
      (10360000+(event_id*104729)%45000)/100000.0e0 AS rawlng,
      ((event_id*13)%350)/10.0e0 AS speed, CAST((event_id*17)%372 AS DOUBLE) AS bearing,
      CASE WHEN event_id%97=0 THEN NULL WHEN event_id%89=0 THEN -1.0e0
        ELSE ((event_id*31)%700)/10.0e0 END AS accuracy,
      {SECONDS}*1000 + (event_id*37)%3000 - 50 AS ingest_ms FROM events""",
    "pings": """SELECT seq, trj_id AS user_id,
      CASE lower(driving_mode) WHEN 'car' THEN 'TAXI' WHEN 'motorcycle' THEN 'BIKE'
        ELSE 'UNKNOWN' END AS service_type,
      rawlat AS latitude, rawlng AS longitude, bearing AS heading, speed*3.6e0 AS speed,
      accuracy, 'ON_TASK' AS status, pingtimestamp*1000 AS ts_ms, ingest_ms FROM trace""",
    "valid": """SELECT * FROM pings WHERE latitude BETWEEN -90 AND 90
      AND longitude BETWEEN -180 AND 180 AND heading BETWEEN 0 AND 360 AND speed >= 0""",
    "broken": """SELECT * REPLACE (
      CASE WHEN seq%19=0 THEN chr(9) || ' ' WHEN seq%23=0 THEN NULL ELSE user_id END AS user_id,
      CASE WHEN seq%29=0 THEN ' ' || chr(10) ELSE service_type END AS service_type,
      CASE WHEN seq%31=0 THEN NULL WHEN seq%37=0 THEN -180.5e0 ELSE longitude END AS longitude,
      CASE WHEN seq%41=0 THEN -0.5e0 ELSE speed END AS speed) FROM pings""",
    "typed": """SELECT * REPLACE (CASE WHEN seq%5=0 THEN 'RDBMS' WHEN seq%7=0 THEN 'KAFKA'
      WHEN seq%11=0 THEN 'night bus' ELSE service_type END AS service_type) FROM valid""",
    "pos": """SELECT user_id, latitude AS lat, longitude AS lng, speed, accuracy, ts_ms,
      ingest_ms AS updated_ms, seq FROM valid
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1""",
    "q": """SELECT seq AS qid, latitude AS lat, longitude AS lng,
      CAST(500 + (seq*97)%4501 AS DOUBLE) AS radius_m, 10 + seq%41 AS k FROM valid""",
    "req": f"""SELECT ts_ms, application, '/api/' || application || '/' ||
        CASE WHEN i%10 < 9 THEN 'update' ELSE 'search/' || (['range','knn','pip'])[i%7%3+1] END AS uri,
      CASE WHEN i%41=0 THEN 503 WHEN i%59=0 THEN 400 ELSE 200 END AS status,
      CASE WHEN i%41=0 THEN 'SERVER_ERROR' WHEN i%59=0 THEN 'CLIENT_ERROR' ELSE 'SUCCESS' END AS outcome,
      (i*37)%3000 AS duration_ms
      FROM (SELECT event_id AS i, {MS} AS ts_ms, (['table','log','stream'])[event_id%3+1] AS application
            FROM events)""",
    "cls": """SELECT * FROM (SELECT *, CASE
        WHEN regexp_full_match(uri, '/api/[a-z]+/update') THEN 'write'
        WHEN regexp_full_match(uri, '/api/[a-z]+/search/.*') THEN 'read' END AS class FROM req)
      WHERE class IS NOT NULL""",
    "samples": f"""SELECT event_id AS seq, {MS} AS ts_ms,
      (['table','log','stream'])[user_id%3+1] AS application,
      CASE WHEN event_id%2=0 AND user_id%3<>2 THEN 'process' ELSE 'system' END AS metric,
      'user_' || CAST(user_id AS VARCHAR) AS series,
      CASE WHEN event_id%83=0 THEN NULL ELSE CAST(event_id%1009 AS DOUBLE) END AS value
      FROM events""",
    "maps": f"""SELECT seq, ingest_ms, user_id AS trj_id, service_type AS driving_mode,
      CASE WHEN seq%61=0 THEN NULL ELSE ts_ms END AS pingtimestamp, latitude, longitude,
      CASE WHEN seq%53=0 THEN NULL ELSE speed END AS speed,
      CASE WHEN seq%59=0 THEN NULL ELSE CAST(heading AS INTEGER) END AS bearing, accuracy,
      concat_ws(',', CASE WHEN seq%53=0 THEN 'speed' END, CASE WHEN seq%59=0 THEN 'bearing' END,
        CASE WHEN accuracy IS NULL THEN 'accuracy' END) AS parse_errors,
      {hex_sql('latitude', 'longitude')} AS cell
      FROM pings WHERE latitude IS NOT NULL""",
    "docs": """SELECT * FROM maps
      QUALIFY row_number() OVER (PARTITION BY trj_id ORDER BY seq DESC) = 1""",
    "squares": """SELECT qid AS pid, y/100000.0e0 AS y0, (y+d)/100000.0e0 AS y1,
      x/100000.0e0 AS x0, (x+d)/100000.0e0 AS x1,
      (y+d//4)/100000.0e0 AS hy0, (y+d//4*3)/100000.0e0 AS hy1,
      (x+d//4)/100000.0e0 AS hx0, (x+d//4*3)/100000.0e0 AS hx1
      FROM (SELECT qid, CAST(round(lat*100000) AS BIGINT) AS y, CAST(round(lng*100000) AS BIGINT) AS x,
            CASE WHEN qid%2=0 THEN 2000 ELSE 5000 END AS d FROM q)""",
    "hits": f"""SELECT * FROM (SELECT q.qid, q.radius_m, pos.user_id, pos.lat AS latitude,
        pos.lng AS longitude, {hav('q.lat', 'q.lng', 'pos.lat', 'pos.lng')} AS d
      FROM q, pos) WHERE d <= radius_m""",
}
# Which inputs each input is made of, in order of definition.
NEEDS = {
    "pings": ["trace"], "valid": ["pings"], "broken": ["pings"], "typed": ["valid"], "pos": ["valid"], "q": ["valid"],
    "cls": ["req"], "maps": ["pings"], "docs": ["maps"], "squares": ["q"], "hits": ["q", "pos"],
}


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_closure(NEEDS.get(n, [])), n]:
            if m not in out:
                out.append(m)
    return out


def add(name: str, needs: str, sql: str, extra: str = "") -> None:
    """Register ``sql`` over the named inputs and the further CTEs in ``extra``."""
    ctes = [f"{n} AS ({CTES[n]})" for n in _closure(needs.split())]
    if extra:
        ctes.append(extra.strip())
    ORACLE[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql


# ---- traces and pings ---------------------------------------------------------------

add("trace_csv_scan", "trace", """SELECT trj_id, driving_mode, osname, pingtimestamp, rawlat,
  rawlng, speed, bearing, accuracy FROM trace WHERE rawlat IS NOT NULL""")
add("trace_csv_reordered", "trace", """SELECT trj_id, driving_mode, CAST(NULL AS VARCHAR) AS osname,
  pingtimestamp, rawlat, rawlng, speed, bearing, accuracy FROM trace WHERE rawlat IS NOT NULL""")
add("normalize_trace", "pings", "SELECT * FROM pings")
add("service_type_binary", "trace", """SELECT CASE WHEN driving_mode = 'car' THEN 'TAXI' ELSE 'BIKE' END
  AS service_type, count(*) AS pings FROM trace GROUP BY 1""")
add("parse_with_defaults", "trace", """SELECT seq, coalesce(rawlat, 0.0e0) AS rawlat,
  coalesce(rawlng, 0.0e0) AS rawlng, speed, CASE WHEN seq%7=0 THEN 0.0e0 ELSE bearing END AS bearing,
  coalesce(accuracy, 1.0e0) AS accuracy FROM trace""")
_CODES = """concat_ws(',', CASE WHEN user_id IS NULL OR NOT regexp_matches(user_id, '[^\\s]') THEN 'user_id_blank' END,
  CASE WHEN service_type IS NULL OR NOT regexp_matches(service_type, '[^\\s]') THEN 'service_type_blank' END,
  CASE WHEN latitude IS NULL THEN 'latitude_missing' END,
  CASE WHEN latitude NOT BETWEEN -90 AND 90 THEN 'latitude_range' END,
  CASE WHEN longitude IS NULL THEN 'longitude_missing' END,
  CASE WHEN longitude NOT BETWEEN -180 AND 180 THEN 'longitude_range' END,
  CASE WHEN heading NOT BETWEEN 0 AND 360 THEN 'heading_range' END,
  CASE WHEN speed < 0 THEN 'speed_negative' END)"""
add("validate_pings", "broken", f"SELECT seq, {_CODES} AS violations FROM broken")
add("validation_summary", "broken", f"""SELECT violation, count(*) AS pings FROM (
  SELECT unnest(string_split({_CODES}, ',')) AS violation FROM broken) WHERE violation <> '' GROUP BY 1""")
add("consumer_filter", "pings", "SELECT seq, user_id, ts_ms FROM pings WHERE latitude IS NOT NULL")
add("sanitize_ids", "pings",
    "SELECT seq, regexp_replace(user_id, '[^a-zA-Z0-9_]', '', 'g') AS user_id FROM pings")
add("gps_quality", "pings", """SELECT seq, CAST(CAST(floor(CASE WHEN accuracy IS NULL THEN 0.0e0
  WHEN accuracy < 0 THEN 100.0e0 WHEN accuracy <= 5 THEN 100 - accuracy*2
  WHEN accuracy <= 20 THEN 90 - (accuracy-5)*2.67e0 WHEN accuracy <= 50 THEN 50 - (accuracy-20)*1.67e0
  ELSE 0.0e0 END + 0.5e0) AS INTEGER) AS VARCHAR) || '%' AS quality FROM pings""")
add("freshness_lag", "pings", "SELECT seq, ingest_ms - ts_ms AS lag_ms FROM pings WHERE ts_ms > 0")

# ---- topics -------------------------------------------------------------------------

add("ping_encode_kv", "pings", """SELECT seq, user_id AS key, service_type, latitude, speed, ts_ms
  FROM pings""")
_TEXT = "coalesce(CAST({0} AS VARCHAR), 'null') AS {1}"
add("ping_encode_map", "pings", f"""SELECT seq, user_id AS trj_id, service_type AS driving_mode,
  {_TEXT.format('ts_ms', 'pingtimestamp')}, {_TEXT.format('latitude', 'rawlat')},
  {_TEXT.format('longitude', 'rawlng')}, {_TEXT.format('heading', 'bearing')},
  {_TEXT.format('accuracy', 'accuracy')},
  CAST(longitude AS VARCHAR) || ',' || CAST(latitude AS VARCHAR) AS location,
  {hex_sql('latitude', 'longitude')} AS cell FROM pings WHERE latitude IS NOT NULL""")
add("decode_default_time", "pings", """SELECT seq, user_id, CASE WHEN seq%3 <> 0 THEN ts_ms ELSE ingest_ms END AS ts_ms
  FROM pings""")
_DECODED = "seq, pingtimestamp, speed, bearing, accuracy, parse_errors"
add("decode_numeric", "maps", f"SELECT {_DECODED} FROM maps")
add("rider_documents", "docs", """SELECT 'rider:' || trj_id AS doc_key, driving_mode, pingtimestamp,
  speed, bearing, accuracy, cell FROM docs""")
_CENTRE = ("1.335e0", "103.825e0")
add("hits_from_documents", "docs", f"""SELECT trj_id AS user_id, latitude, longitude,
  CASE WHEN {hav(*_CENTRE, 'latitude', 'longitude')} <= 10000
    THEN round({hav(*_CENTRE, 'latitude', 'longitude')}, 3) ELSE 0.0e0 END AS distance_meter,
  cell, driving_mode AS status FROM docs""")

# ---- geometry -----------------------------------------------------------------------

add("haversine_pairs", "valid", f"""SELECT seq,
  round({hav(*_CENTRE, 'latitude', 'longitude')}, 3) AS distance_meter FROM valid""")
add("geodesic_pairs", "valid", "SELECT seq, round(d, 3) AS distance_meter FROM g",
    geodesic_cte("g", "valid", *_CENTRE, "latitude", "longitude"))
add("cell_assign", "valid", f"SELECT seq, {hex_sql('latitude', 'longitude')} AS cell FROM valid")
_CORNERS = [("x0", "y0"), ("x0", "y1"), ("x1", "y1"), ("x1", "y0")]


def _vertex_rows(ring: int, corners: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT pid, {ring} AS ring, {i} AS pos, {x} AS x, {y} AS y FROM squares"
        for i, (x, y) in enumerate(corners)
    )


_HOLE = [(f"h{x}", f"h{y}") for x, y in _CORNERS]
add("polygon_from_arrays", "squares", _vertex_rows(0, _CORNERS))
add("polygon_from_wkt", "squares", _vertex_rows(0, _CORNERS + _CORNERS[:1]) + " UNION ALL "
    + _vertex_rows(1, _HOLE + _HOLE[:1]))
add("polygon_bbox", "squares", f"""SELECT pid, y0 AS min_lat, y1 AS max_lat, x0 AS min_lng, x1 AS max_lng,
  round((y0+y1)/2, 7) AS center_lat, round((x0+x1)/2, 7) AS center_lng,
  round({hav('y0', 'x0', 'y1', 'x1')}*1.1e0/2, 3) AS radius_m FROM squares""")
add("polygon_validate", "squares", """SELECT pid, NOT (pid%5=0 OR pid%7=0) AS valid
  FROM squares""")

# ---- searches -----------------------------------------------------------------------

_NEAR = f"near AS (SELECT *, {hav(*_CENTRE, 'lat', 'lng')} AS d FROM pos)"
_HIT = "user_id, lat AS latitude, lng AS longitude, round(d, 3) AS distance_meter"
add("range_sphere", "pos", f"SELECT {_HIT} FROM near WHERE d <= 8000", _NEAR)
add("position_snapshot", "valid", f"""SELECT user_id, latitude, longitude, round(d, 3) AS distance_meter
  FROM (SELECT *, {hav(*_CENTRE, 'latitude', 'longitude')} AS d FROM valid) WHERE d <= 3000""")
_NEAR_G = geodesic_cte("g", "pos", *_CENTRE, "lat", "lng")
add("snapshot_range_join", "hits", """SELECT qid, user_id, latitude, longitude, round(d, 3) AS distance_meter
  FROM hits""")
add("range_spheroid", "pos", """SELECT user_id, lat, lng, speed, accuracy, ts_ms, updated_ms
  FROM g WHERE d <= 8000""", _NEAR_G)
add("range_km_paged", "pos", f"""SELECT {_HIT} FROM near WHERE d <= 12500
  ORDER BY round(d, 3), user_id LIMIT 10""", _NEAR)
_RANK = ("CAST(row_number() OVER (PARTITION BY qid ORDER BY round(d, 3), user_id) AS INTEGER) "
         "AS rank")
_PAIR = "qid, user_id, latitude, longitude, round(d, 3) AS distance_meter"
add("range_join", "hits", f"SELECT {_PAIR} FROM hits")
add("range_join_paged", "hits", f"SELECT * FROM (SELECT {_PAIR}, {_RANK} FROM hits) WHERE rank <= 10")
_ALL_HITS = f"""allhits AS (SELECT * FROM (SELECT q.qid, {hav('q.lat', 'q.lng', 'latitude', 'longitude')} AS d, radius_m
  FROM q, valid) WHERE d <= radius_m)"""
add("range_join_shuffled", "q valid", """SELECT q.qid, count(allhits.qid) AS hits
  FROM q LEFT JOIN allhits ON q.qid = allhits.qid GROUP BY q.qid""", _ALL_HITS)
add("knn_join_shuffled", "q valid", """SELECT qid, count(*) AS hits, round(sum(round(d, 3)), 3) AS metres FROM (
  SELECT qid, k, d, row_number() OVER (PARTITION BY qid ORDER BY round(d, 3), user_id) AS r FROM pairs)
  WHERE r <= k GROUP BY qid""", f"""pairs AS (SELECT qid, k, user_id,
  {hav('q.lat', 'q.lng', 'latitude', 'longitude')} AS d FROM q, valid)""")
add("knn_uncapped", "pos", f"SELECT {_HIT} FROM g ORDER BY round(d, 3), user_id LIMIT 10", _NEAR_G)
_ALL = """SELECT q.qid, q.k, q.lat AS qlat, q.lng AS qlng, pos.user_id, pos.lat AS latitude,
  pos.lng AS longitude FROM q, pos"""
add("knn_join", "q pos", f"SELECT * EXCLUDE (k) FROM (SELECT {_PAIR}, {_RANK}, k FROM g) WHERE rank <= k",
    f"pairs AS ({_ALL})," + geodesic_cte("g", "pairs", "qlat", "qlng", "latitude", "longitude"))
for _name, _cap in (("knn_within_5km", 5000), ("knn_within_50km", 50000)):
    add(_name, "q pos", f"""SELECT * EXCLUDE (k) FROM (SELECT {_PAIR}, {_RANK}, k FROM (
      SELECT *, {hav('qlat', 'qlng', 'latitude', 'longitude')} AS d FROM pairs)
      WHERE d <= {_cap}) WHERE rank <= k""", f"pairs AS ({_ALL})")

ORACLE["snapshot_knn_join"] = ORACLE["knn_within_5km"]


def _crossing(px: str, py: str, x0: str, y0: str, x1: str, y1: str) -> str:
    return f"""(CASE WHEN ({py} < {y0}) = ({py} < {y1}) THEN 0
      WHEN {px} >= {x0} + ({py}-{y0})*({x1}-{x0})/({y1}-{y0}) THEN 0
      WHEN {y0} < {y1} THEN 1 ELSE -1 END)"""


_CONCAVE = [(103.70, 1.25), (103.72, 1.40), (103.80, 1.35), (103.90, 1.42), (103.88, 1.27)]
_WINDING = " + ".join(
    _crossing("lng", "lat", f"{a[0]!r}e0", f"{a[1]!r}e0", f"{b[0]!r}e0", f"{b[1]!r}e0")
    for a, b in zip(_CONCAVE, _CONCAVE[1:] + _CONCAVE[:1])
)
add("pip_winding", "pos", f"""SELECT user_id, lat AS latitude, lng AS longitude,
  round({hav('(1.25e0+1.42e0)/2', '(103.7e0+103.9e0)/2', 'lat', 'lng')}, 3) AS distance_meter
  FROM pos WHERE {_WINDING} <> 0""")
add("pip_join", "squares pos", f"""SELECT pid, user_id, lat AS latitude, lng AS longitude,
  round({hav('(y0+y1)/2', '(x0+x1)/2', 'lat', 'lng')}, 3) AS distance_meter
  FROM squares, pos WHERE lat >= y0 AND lat < y1 AND lng >= x0 AND lng < x1""")
_NOTCHED = [("x", "y"), ("x", "(y+d)"), ("(x+d//3)", "(y+d//2)"), ("(x+d//2)", "(y+d)"), ("(x+d)", "(y+d)"),
            ("(x+d)", "y"), ("(x+d//2)", "(y+d//3)")]
_NOTCHED = [(f"({x}/100000.0e0)", f"({y}/100000.0e0)") for x, y in _NOTCHED]
_TURNS = " + ".join(_crossing("longitude", "latitude", *a, *b) for a, b in zip(_NOTCHED, _NOTCHED[1:] + _NOTCHED[:1]))
add("pip_join_shuffled", "q valid", f"""SELECT pid, 2*count(*) AS hits FROM lattice, valid
  WHERE latitude BETWEEN y/100000.0e0 AND (y+d)/100000.0e0 AND longitude BETWEEN x/100000.0e0 AND (x+d)/100000.0e0
  AND {_TURNS} <> 0 GROUP BY pid""", """lattice AS (SELECT qid AS pid, CAST(round(lat*100000) AS BIGINT) AS y,
  CAST(round(lng*100000) AS BIGINT) AS x, CASE WHEN qid%2=0 THEN 2000 ELSE 5000 END AS d FROM q)""")
add("pip_wkt", "squares pos", """SELECT pid, user_id, lat AS latitude, lng AS longitude
  FROM squares, pos WHERE lat > y0 AND lat < y1 AND lng > x0 AND lng < x1
  AND NOT (lat >= hy0 AND lat <= hy1 AND lng >= hx0 AND lng <= hx1)""")
add("pip_wkt_parts", "squares pos", """SELECT pid, user_id, lat AS latitude, lng AS longitude
  FROM squares JOIN lattice USING (pid), pos
  WHERE pid%13 <> 0 AND (lat > y0 AND lat < y1 AND lng > x0 AND lng < x1
    AND NOT (lat >= hy0 AND lat <= hy1 AND lng >= hx0 AND lng <= hx1)
    OR lat > y0 AND lat < hy0 AND lng > (x-2*d)/100000.0e0 AND lng < (x-2*d+d//4)/100000.0e0)""",
    """lattice AS (SELECT qid AS pid, CAST(round(lng*100000) AS BIGINT) AS x,
  CASE WHEN qid%2=0 THEN 2000 ELSE 5000 END AS d FROM q)""")
add("rejected_areas", "squares", "SELECT pid FROM squares WHERE pid%13 = 0")
add("same_cell", "q pos", """SELECT qid, user_id, latitude, longitude, cell FROM qc JOIN pc USING (cell)""",
    f"""qc AS (SELECT qid, {hex_sql('lat', 'lng')} AS cell FROM q),
    pc AS (SELECT user_id, lat AS latitude, lng AS longitude, {hex_sql('lat', 'lng')} AS cell FROM pos)""")
add("hit_counts", "q hits", """SELECT q.qid, count(hits.qid) AS hits
  FROM q LEFT JOIN hits ON q.qid = hits.qid GROUP BY q.qid""")
add("hit_counts_dense", "q valid", "SELECT qid, count(*) FILTER (d <= radius_m) AS hits FROM g GROUP BY qid",
    "pairs AS (SELECT qid, radius_m, q.lat AS qlat, q.lng AS qlng, latitude, longitude FROM q, valid),"
    + geodesic_cte("g", "pairs", "qlat", "qlng", "latitude", "longitude"))
add("queries_without_hits", "q hits", """SELECT qid, radius_m FROM q
  WHERE qid NOT IN (SELECT qid FROM hits)""")

# ---- state --------------------------------------------------------------------------

add("latest_positions", "pos", "SELECT * FROM pos")
_UPSERT = """SELECT pos.*, first.service_type FROM pos JOIN (SELECT user_id, service_type FROM typed
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1) AS first USING (user_id)"""
for _name in ("upsert_positions", "upsert_merge", "upsert_merge_replay", "stream_upsert_positions"):
    add(_name, "pos typed", _UPSERT)
add("positions_as_of", "typed", """SELECT user_id, latitude AS lat, longitude AS lng, speed, accuracy, ts_ms,
  ingest_ms AS updated_ms, seq, first_service AS service_type
  FROM (SELECT *, first_value(service_type) OVER (PARTITION BY user_id ORDER BY seq) AS first_service FROM typed
        WHERE (seq - 1)*4 < 3*(SELECT max(seq) FROM typed))
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1""")
add("point_lookup", "pos", """SELECT user_id, lat, lng, seq FROM pos
  WHERE user_id IN (SELECT 'trj-' || CAST(c_custkey AS VARCHAR) FROM customer)""")
add("status_snapshot", "pings", """SELECT regexp_replace(user_id, '[^a-zA-Z0-9_]', '', 'g') AS user_id,
  ingest_ms + 1800000 AS expires_at, service_type, heading, ts_ms FROM pings WHERE latitude IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1""")
_LATEST = "(SELECT max(ingest_ms) FROM valid)"
_MIDDLE = "(SELECT (min(ingest_ms) + max(ingest_ms)) // 2 FROM valid)"
for _name, _at in (("active_status", _LATEST), ("stream_active_status", _LATEST),
                   ("active_status_past", _MIDDLE), ("stream_status_past", _MIDDLE)):
    add(_name, "valid", f"""SELECT user_id, last_ms, last_ms + 1800000 AS expires_at FROM (
      SELECT user_id, ingest_ms AS last_ms FROM valid WHERE ingest_ms <= {_at}
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1)
      WHERE {_at} - last_ms < 1800000""")
# Without a break of the TTL a period goes on; those that the last minute may extend are open.
add("stream_status_periods", "valid", f"""SELECT user_id, min(ingest_ms) AS from_ms,
  max(ingest_ms) + 1800000 AS expires_at, count(*) AS writes
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ingest_ms, seq) AS period
    FROM (SELECT *, CASE WHEN ingest_ms - lag(ingest_ms) OVER (PARTITION BY user_id ORDER BY ingest_ms, seq)
                 < 1800000 THEN 0 ELSE 1 END AS fresh FROM valid))
  GROUP BY user_id, period HAVING max(ingest_ms) + 1800000 <= {_LATEST} - 60000""")

# ---- metrics ------------------------------------------------------------------------


def _buckets(value: str, bounds: tuple[int, ...]) -> str:
    return ", ".join(f"count(*) FILTER ({value} <= {b}) AS le_{b}" for b in bounds) + ", count(*) AS n"


def _quantile(q: float, bounds: tuple[int, ...]) -> str:
    low, below, cases = 0, "0", ""
    for b in bounds:
        cases += (f" WHEN le_{b} >= {q}e0*n THEN {low} + ({b}-{low})*({q}e0*n-{below})"
                  f"/CAST(le_{b}-{below} AS DOUBLE)")
        low, below = b, f"le_{b}"
    return f"round(CASE{cases} ELSE {bounds[-1]}.0e0 END, 6)"


_FRESH, _LATENCY = (100, 500, 1000, 2000), (50, 100, 250, 500, 1000, 2500)


def _fresh(width: int) -> str:
    return f"""fresh AS (SELECT ingest_ms - ingest_ms % {width} AS window_ms,
      {_buckets('ingest_ms-ts_ms', _FRESH)} FROM pings WHERE ts_ms > 0 AND ingest_ms >= ts_ms GROUP BY 1)"""


add("freshness_histogram", "pings", "SELECT * FROM fresh", _fresh(3600000))
add("freshness_slo", "pings", "SELECT window_ms, "
    + ", ".join(f"round(le_{b}/CAST(n AS DOUBLE), 9) AS within_{b}" for b in _FRESH) + " FROM fresh",
    _fresh(3600000))
add("freshness_p95_p99", "pings", f"""SELECT window_ms, {_quantile(0.95, _FRESH)} AS p95,
  {_quantile(0.99, _FRESH)} AS p99 FROM fresh""", _fresh(3600000))
_CLASS_WINDOW = "application, class, ts_ms - ts_ms % 86400000 AS window_ms"
add("latency_p95_p99", "cls", f"""SELECT application, class, window_ms, {_quantile(0.95, _LATENCY)} AS p95,
  {_quantile(0.99, _LATENCY)} AS p99 FROM (SELECT {_CLASS_WINDOW}, {_buckets('duration_ms', _LATENCY)}
  FROM cls GROUP BY ALL)""")
_HOUR_RPS = "round(count(*) FILTER ({0}) / 3600.0e0, 6)"
add("throughput", "cls", f"""SELECT application, ts_ms - ts_ms % 3600000 AS window_ms,
  {_HOUR_RPS.format("class='write'")} AS write_rps, {_HOUR_RPS.format("class='read'")} AS read_rps,
  {_HOUR_RPS.format('true')} AS total_rps FROM cls GROUP BY ALL""")
add("sliding_throughput", "cls", """SELECT application, class, window_ms, round(count(*)/3600.0e0, 6) AS rps
  FROM (SELECT application, class, ts_ms - ts_ms % 600000 - s*600000 AS window_ms
        FROM cls, (SELECT unnest(range(6)) AS s)) GROUP BY ALL""")
add("sliding_throughput_uneven", "cls", """SELECT application, class, window_ms, round(count(*)/1500.0e0, 6) AS rps
  FROM (SELECT application, class, ts_ms, ts_ms - ts_ms % 600000 - s*600000 AS window_ms
        FROM cls, (SELECT unnest(range(3)) AS s)) WHERE ts_ms < window_ms + 1500000 GROUP BY ALL""")
_ERROR = """100.0e0 * greatest(count(*) FILTER (status BETWEEN 500 AND 599),
  count(*) FILTER (outcome = 'SERVER_ERROR')) / 86400.0e0 / greatest(count(*)/86400.0e0, 1e-4)"""
add("error_rate", "cls", f"""SELECT {_CLASS_WINDOW}, round({_ERROR}, 6) AS error_pct
  FROM cls GROUP BY ALL""")
_GAUGE = """SELECT application, 100*coalesce(avg(value/1009) FILTER (metric='process'),
  avg(value/1009) FILTER (metric='system')) AS gauge_pct FROM samples GROUP BY 1"""
add("gauge_avg", "samples", f"SELECT application, round(gauge_pct, 6) AS gauge_pct FROM ({_GAUGE})")
add("gauge_last", "samples", """SELECT series, value FROM samples WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY seq DESC) = 1""")
add("counter_increase", "samples", """SELECT series, ts_ms - ts_ms % 86400000 AS window_ms,
  sum(CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END) AS increase
  FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts_ms, seq) AS prev
        FROM samples WHERE value IS NOT NULL) GROUP BY ALL""")
_APP = "(['table','log','stream'])[event_id%3+1] AS application"
_RISE = """CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END"""
add("sample_throughput", "", f"""SELECT ts_ms - ts_ms % 3600000 AS window_ms, application, class,
  round(sum({_RISE})/3600.0e0, 6) AS rate FROM (SELECT *, lag(value) OVER (PARTITION BY application, class
    ORDER BY ts_ms) AS prev FROM (SELECT ts_ms, application, class,
      CASE WHEN class = 'write' THEN ts_ms//1000 ELSE ts_ms//9000%40009 END AS value
      FROM (SELECT {MS} AS ts_ms, {_APP} FROM events), (SELECT unnest(['write', 'read']) AS class)))
  GROUP BY ALL""")
ORACLE["sample_file_throughput"] = ORACLE["sample_throughput"]
_RATES = ", ".join(f"sum(value - prev) FILTER (le = {b}) / 86400.0e0 AS {n}" for b, n in
                   [(b, f"le_{b}") for b in _LATENCY] + [(999999, "n")])
_VALUE = " + ".join(f"CASE WHEN le >= {b} THEN ts_ms//{20000 * (j + 1)} ELSE 0 END"
                    for j, b in enumerate([*_LATENCY, 999999]))
add("sample_p95_p99", "", f"""SELECT window_ms, application, {_quantile(0.95, _LATENCY)} AS p95,
  {_quantile(0.99, _LATENCY)} AS p99 FROM (SELECT ts_ms - ts_ms % 86400000 AS window_ms, application, {_RATES}
  FROM (SELECT *, coalesce(lag(value) OVER (PARTITION BY application, le ORDER BY ts_ms), value) AS prev
    FROM (SELECT ts_ms, application, le, {_VALUE} AS value FROM (SELECT {MS} AS ts_ms, {_APP} FROM events),
      (SELECT unnest([{', '.join(map(str, [*_LATENCY, 999999]))}]) AS le)))
  GROUP BY ALL)""")


def _quantile_s(q: float) -> str:
    """The quantile over buckets whose bounds are the milliseconds in seconds."""
    low, below, cases = "0", "0", ""
    for b in _LATENCY:
        cases += (f" WHEN le_{b} >= {q}e0*n THEN {low} + ({b / 1000}e0-{low})*({q}e0*n-{below})"
                  f"/CAST(le_{b}-{below} AS DOUBLE)")
        low, below = f"{b / 1000}e0", f"le_{b}"
    return f"round(CASE{cases} ELSE {_LATENCY[-1] / 1000}e0 END, 6)"


add("sample_p95_p99_seconds", "", f"""SELECT window_ms, application, {_quantile_s(0.95)} AS p95,
  {_quantile_s(0.99)} AS p99 FROM (SELECT ts_ms - ts_ms % 86400000 AS window_ms, application, {_RATES}
  FROM (SELECT *, coalesce(lag(value) OVER (PARTITION BY application, le ORDER BY ts_ms), value) AS prev
    FROM (SELECT ts_ms, application, le, {_VALUE} AS value FROM (SELECT {MS} AS ts_ms, {_APP} FROM events),
      (SELECT unnest([{', '.join(map(str, [*_LATENCY, 999999]))}]) AS le)))
  GROUP BY ALL)""")
_WIDE = """CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END"""
add("counter_rate_sliding", "", f"""SELECT window_ms, application, class, round(sum({_WIDE})/3600.0e0, 6) AS rate
  FROM (SELECT *, lag(value) OVER (PARTITION BY application, class, window_ms ORDER BY ts_ms) AS prev
    FROM (SELECT ts_ms, application, class, ts_ms - ts_ms % 600000 - s*600000 AS window_ms,
      CASE WHEN class = 'write' THEN ts_ms//1000 ELSE ts_ms//9000%40009 END AS value
      FROM (SELECT {MS} AS ts_ms, {_APP} FROM events), (SELECT unnest(['write', 'read']) AS class),
        (SELECT unnest(range(6)) AS s)))
  GROUP BY window_ms, application, class HAVING max(ts_ms) > min(ts_ms)""")
add("counter_rate_extrapolated", "samples", f"""SELECT series, window_ms, round(inside * (seen + least(
    head, CASE WHEN inside > 0 AND first >= 0 THEN seen*(first/inside) ELSE head END) + tail) / seen / 43200.0e0, 6) AS rate
  FROM (SELECT *, CASE WHEN a >= mean*1.1e0 THEN mean/2 ELSE a END AS head, CASE WHEN b >= mean*1.1e0 THEN mean/2 ELSE b END AS tail
  FROM (SELECT series, window_ms, sum({_WIDE}) AS inside, CAST(max(ts_ms)-min(ts_ms) AS DOUBLE) AS seen,
      (max(ts_ms)-min(ts_ms))/CAST(count(*)-1 AS DOUBLE) AS mean, CAST(min(ts_ms)-window_ms AS DOUBLE) AS a,
      CAST(window_ms+43200000-max(ts_ms) AS DOUBLE) AS b, arg_min(value, (ts_ms, seq)) AS first
    FROM (SELECT *, lag(value) OVER (PARTITION BY series, window_ms ORDER BY ts_ms, seq) AS prev
      FROM (SELECT *, ts_ms - ts_ms % 18000000 - s*18000000 AS window_ms FROM samples, (SELECT unnest(range(3)) AS s))
      WHERE value IS NOT NULL AND ts_ms < window_ms + 43200000)
    GROUP BY series, window_ms HAVING max(ts_ms) > min(ts_ms)))""")
add("sample_error_rate", "", f"""SELECT window_ms, application,
  round(100 * coalesce(sum(r) FILTER (d >= 50000 AND application <> 'stream'), 0)
    / greatest(coalesce(sum(r) FILTER (d < 50000 OR application <> 'stream'), 0), 1e-4), 6) AS error_pct
  FROM (SELECT window_ms, application, d, sum(value - coalesce(prev, value))/3600.0e0 AS r
    FROM (SELECT *, ts_ms - ts_ms % 3600000 AS window_ms, lag(value) OVER (PARTITION BY application, d ORDER BY ts_ms) AS prev
      FROM (SELECT ts_ms, application, d, ts_ms // d AS value FROM (SELECT {MS} AS ts_ms, {_APP} FROM events),
        (SELECT unnest([1000, 7000, 50000, 90000]) AS d))) GROUP BY ALL)
  GROUP BY window_ms, application""")
add("check_pass_rate", "req", """SELECT pattern || ' is 200' AS "check",
  round(avg(CASE WHEN status = 200 THEN 1.0e0 ELSE 0.0e0 END), 6) AS pass_rate, count(*) AS requests
  FROM req JOIN (SELECT unnest(['/api/[a-z]+/update', '/api/[a-z]+/search/range',
    '/api/[a-z]+/search/knn']) AS pattern) ON regexp_full_match(uri, pattern) GROUP BY pattern""")
add("distinct_applications", "req", "SELECT DISTINCT application FROM req")


def _band(value: str, yellow: int, red: int) -> str:
    return f"CASE WHEN {value} >= {red} THEN 'red' WHEN {value} >= {yellow} THEN 'yellow' ELSE 'green' END"


add("kpi_bands", "cls samples", f"""SELECT application, window_ms, {_band('rps', 200, 500)} AS rps_band,
  {_band('error_pct', 1, 5)} AS error_band, {_band('gauge_pct', 70, 85)} AS cpu_band
  FROM (SELECT application, ts_ms - ts_ms % 86400000 AS window_ms, count(*)/86400.0e0 AS rps
        FROM cls GROUP BY ALL)
  JOIN (SELECT {_CLASS_WINDOW}, {_ERROR} AS error_pct FROM cls WHERE class = 'write' GROUP BY ALL)
    USING (application, window_ms)
  JOIN ({_GAUGE}) USING (application)""")

# ---- streams ------------------------------------------------------------------------

add("stream_ingest", "pings", "SELECT * FROM pings WHERE latitude IS NOT NULL")
add("stream_map_decode", "maps", "SELECT seq, trj_id, pingtimestamp, speed, bearing, accuracy, "
    "parse_errors FROM maps")
add("stream_upsert_event_time", "valid", """SELECT user_id, latitude AS lat, longitude AS lng, ts_ms, seq
  FROM (SELECT * REPLACE (CASE WHEN seq%3=0 THEN ts_ms - 3456000000 ELSE ts_ms END AS ts_ms) FROM valid)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, seq DESC) = 1""")
add("stream_latest", "pos", "SELECT user_id, lat, lng, seq FROM pos")
add("quarantine", "pings", "SELECT seq, ingest_ms FROM pings WHERE seq % 67 = 0 OR seq % 71 = 0")
add("quarantine_split", "pings", """SELECT seq, seq % 67 = 0 OR seq % 71 = 0 AS poison FROM pings
  WHERE latitude IS NOT NULL OR seq % 67 = 0 OR seq % 71 = 0""")
add("stream_topic_copy", "pings", """SELECT seq, user_id, service_type, latitude, longitude, speed, ts_ms, ingest_ms
  FROM pings WHERE latitude IS NOT NULL""")
ORACLE["stream_map_copy"] = ORACLE["ping_encode_map"]
# A status expires if the rider stays away for the whole limit. The last one of a rider is seen to
# expire once the stream is a minute past it.
add("stream_status_expiry", "valid", f"""SELECT user_id, last_ms, last_ms + 1800000 AS expired_ms FROM (
  SELECT user_id, ingest_ms AS last_ms, lead(ingest_ms) OVER (PARTITION BY user_id ORDER BY ingest_ms, seq) AS next_ms
  FROM valid) WHERE next_ms - last_ms >= 1800000 OR next_ms IS NULL AND last_ms + 1800000 <= {_LATEST} - 60000""")
add("stream_sliding_throughput", "cls", """SELECT application, class, window_ms, round(count(*)/3600.0e0, 6) AS rps
  FROM (SELECT application, class, ts_ms - ts_ms % 600000 - s*600000 AS window_ms
        FROM cls, (SELECT unnest(range(6)) AS s))
  WHERE window_ms + 3600000 <= (SELECT max(ts_ms) FROM cls) - 60000 GROUP BY ALL""")
add("stream_sliding_latency", "cls", f"""SELECT application, class, window_ms, {_quantile(0.95, _LATENCY)} AS p95,
  {_quantile(0.99, _LATENCY)} AS p99
  FROM (SELECT application, class, window_ms, {_buckets('duration_ms', _LATENCY)}
    FROM (SELECT application, class, duration_ms, ts_ms - ts_ms % 600000 - s*600000 AS window_ms
          FROM cls, (SELECT unnest(range(6)) AS s))
    WHERE window_ms + 3600000 <= (SELECT max(ts_ms) FROM cls) - 60000 GROUP BY ALL)""")
add("stream_freshness", "pings", "SELECT * FROM fresh",
    _fresh(60000).replace("WHERE ts_ms", "WHERE latitude IS NOT NULL AND ts_ms"))

# ---- workload -----------------------------------------------------------------------

add("seed_riders", "trace", """SELECT 'user_' || CAST(c_custkey AS VARCHAR) AS user_id,
  trj_id || '_v' || CAST(c_custkey AS VARCHAR) AS vehicle, rawlat AS latitude,
  rawlng AS longitude, speed
  FROM customer JOIN trace ON seq = (c_custkey*7919+13) % (SELECT count(*) FROM trace)""")
add("update_batch", "trace", """SELECT seq, 'user_' || CAST((seq*104729+7) %
    (SELECT count(*) FROM customer) AS VARCHAR) AS user_id,
  CASE WHEN seq%10 < 9 THEN 'write' ELSE 'read' END AS op, rawlat AS latitude, rawlng AS longitude
  FROM trace""")
add("query_workload", "q", """SELECT qid, kind, lat, lng, CASE WHEN kind='range' THEN radius_m END AS radius_m,
  CASE WHEN kind='knn' THEN k END AS k,
  CASE WHEN kind='pip' THEN round(lat + side, 5) END AS max_lat,
  CASE WHEN kind='pip' THEN round(lng + side, 5) END AS max_lng
  FROM (SELECT *, CASE WHEN qid%100 < 33 THEN 'pip' WHEN qid%100 < 66 THEN 'range' ELSE 'knn' END AS kind,
    CASE WHEN qid%2=0 THEN 0.02e0 ELSE 0.05e0 END AS side FROM q)""")
