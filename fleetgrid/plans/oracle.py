"""The registered queries as DuckDB SQL, for comparison on the same tables."""

from __future__ import annotations

_LAT = "concat('43.', lpad(cast(6000 + (event_id * 37) % 2000 AS VARCHAR), 4, '0'))"
_LON = "concat('-79.', lpad(cast(2000 + (event_id * 91) % 4000 AS VARCHAR), 4, '0'))"

_POSITIONS = f"""positions AS (
  SELECT concat('veh-', cast(user_id AS VARCHAR)) AS id,
         event_type AS "routeTag",
         CASE WHEN event_id % 5 > 0 THEN concat(event_type, '_', cast(event_id % 2 AS VARCHAR)) END
           AS "dirTag",
         {_LAT} AS lat,
         {_LON} AS lon,
         json_extract_string(props, '$.k') AS "secsSinceReport",
         CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS predictable,
         cast((event_id * 13) % 360 AS VARCHAR) AS heading,
         cast(cast(value AS DECIMAL(10,2)) AS VARCHAR) AS "speedKmHr",
         ts + INTERVAL 5 SECOND AS fetched_at,
         ts AS api_timestamp,
         event_id
  FROM events
)"""

_RECENT = """recent AS (
  SELECT * FROM positions
  WHERE api_timestamp >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
)"""

_LATEST = """latest AS (
  SELECT * FROM recent
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY api_timestamp DESC, event_id DESC) = 1
)"""

_POINT = (
    "cast(to_json({'type': 'Point', 'coordinates': "
    "[cast(lon AS DOUBLE), cast(lat AS DOUBLE)]}) AS VARCHAR)"
)

_PATHS = f"""paths AS (
  SELECT id,
         list([cast(lon AS DOUBLE), cast(lat AS DOUBLE)] ORDER BY api_timestamp, event_id) AS points,
         avg(cast("speedKmHr" AS DOUBLE)) AS speed,
         arg_max(heading, (api_timestamp, event_id)) AS last_heading,
         count(*) AS n
  FROM recent GROUP BY id HAVING count(*) > 1
)"""

_LINE = "cast(to_json({'type': 'LineString', 'coordinates': points}) AS VARCHAR)"

_PLANE = f"""plane AS (
  SELECT event_id, api_timestamp, "speedKmHr",
         (cast(lon AS DOUBLE) + 79.38) * cos(radians(43.65)) * 111.32 AS x,
         (cast(lat AS DOUBLE) - 43.65) * 110.574 AS y
  FROM positions
), fractional AS (
  SELECT *, (sqrt(3) / 3 * x - y / 3) / 0.46 AS qf, (2.0 / 3 * y) / 0.46 AS rf FROM plane
), rounded AS (
  SELECT *, floor(qf + 0.5) AS q0, floor(rf + 0.5) AS r0, floor(-qf - rf + 0.5) AS s0 FROM fractional
), cells AS (
  SELECT event_id, api_timestamp, "speedKmHr",
         cast(CASE WHEN abs(q0 - qf) > abs(r0 - rf) AND abs(q0 - qf) > abs(s0 + qf + rf)
              THEN -r0 - s0 ELSE q0 END AS BIGINT) AS q,
         cast(CASE WHEN NOT (abs(q0 - qf) > abs(r0 - rf) AND abs(q0 - qf) > abs(s0 + qf + rf))
                    AND abs(r0 - rf) > abs(s0 + qf + rf)
              THEN -q0 - s0 ELSE r0 END AS BIGINT) AS r
  FROM rounded
)"""

_SPEEDS = """speeds AS (
  SELECT q, r, cast(date_part('hour', api_timestamp) AS INTEGER) AS hour_of_day,
         round(avg(cast("speedKmHr" AS FLOAT)), 6) AS speed,
         count(*) AS num_observations,
         concat(cast(q AS VARCHAR), '_', cast(r AS VARCHAR)) AS hex_id
  FROM cells
  WHERE api_timestamp >= (SELECT max(ts) FROM events) - INTERVAL 90 DAY
  GROUP BY q, r, hour_of_day
), this_hour AS (
  SELECT * FROM speeds WHERE hour_of_day = (SELECT date_part('hour', max(ts)) FROM events)
)"""

_STOPS_FILE = """stops_file AS (
  SELECT cast(p_partkey AS VARCHAR) AS stop_id,
         concat('c', cast(p_partkey % 1000 AS VARCHAR)) AS stop_code,
         p_name AS stop_name,
         p_type AS stop_desc,
         p_brand AS zone_id,
         cast(NULL AS VARCHAR) AS stop_url,
         p_size % 2 AS location_type,
         CASE WHEN p_size > 25 THEN cast(p_partkey % 100 AS VARCHAR) END AS parent_station,
         'America/Toronto' AS stop_timezone,
         p_size % 3 AS wheelchair_boarding,
         cast(concat('43.', lpad(cast(6000 + (p_partkey * 37) % 2000 AS VARCHAR), 4, '0')) AS DOUBLE)
           AS stop_lat,
         cast(concat('-79.', lpad(cast(2000 + (p_partkey * 91) % 4000 AS VARCHAR), 4, '0')) AS DOUBLE)
           AS stop_lon
  FROM part
)"""

_STOP_POINT = "cast(to_json({'type': 'Point', 'coordinates': [stop_lon, stop_lat]}) AS VARCHAR)"

_DIRECTION = (
    "cast((row_number() OVER (PARTITION BY lower(stop_name)[1:10] "
    "ORDER BY length(stop_name), stop_id) - 1) % 4 AS INTEGER)"
)

_STOP_PLANE = """stop_plane AS (
  SELECT stop_id, radians(stop_lon) AS mx, -ln(tan(pi() / 4 + radians(stop_lat) / 2)) AS my
  FROM stops_file
)"""

_SHAPE_POINTS = """shape_points AS (
  SELECT cast(l_orderkey AS VARCHAR) AS shape_id,
         cast(concat('-79.', lpad(cast(2000 + (l_suppkey * 3) % 40 AS VARCHAR), 4, '0')) AS DOUBLE) AS x,
         cast(concat('43.', lpad(cast(6000 + (l_partkey * 7) % 200 AS VARCHAR), 4, '0')) AS DOUBLE) AS y,
         l_linenumber AS seq, l_partkey AS tie_1, l_suppkey AS tie_2
  FROM lineitem
)"""


def _simplified(tolerance: float) -> str:
    """Douglas-Peucker as a recursive query over segments ``a..b`` of point numbers."""
    return f"""
WITH RECURSIVE {_SHAPE_POINTS}, pts AS MATERIALIZED (
  SELECT shape_id, x, y,
         row_number() OVER (PARTITION BY shape_id ORDER BY seq, tie_1, tie_2, x, y) AS n,
         count(*) OVER (PARTITION BY shape_id) AS c
  FROM shape_points
), seg AS (
  SELECT shape_id, cast(1 AS BIGINT) AS a, c AS b FROM pts WHERE n = 1 AND c > 1
  UNION ALL
  SELECT f.shape_id, CASE WHEN h.half = 0 THEN f.a ELSE f.m END, CASE WHEN h.half = 0 THEN f.m ELSE f.b END
  FROM (
    SELECT shape_id, a, b, max(d) AS far, min(n) FILTER (WHERE d = top) AS m
    FROM (
      SELECT *, max(d) OVER (PARTITION BY shape_id, a, b) AS top
      FROM (
        SELECT s.shape_id, s.a, s.b, p.n,
               CASE WHEN (v.x - u.x) ^ 2 + (v.y - u.y) ^ 2 = 0
                      OR (p.x - u.x) * (v.x - u.x) + (p.y - u.y) * (v.y - u.y) <= 0
                    THEN sqrt((p.x - u.x) ^ 2 + (p.y - u.y) ^ 2)
                    WHEN (p.x - u.x) * (v.x - u.x) + (p.y - u.y) * (v.y - u.y)
                         >= (v.x - u.x) ^ 2 + (v.y - u.y) ^ 2
                    THEN sqrt((p.x - v.x) ^ 2 + (p.y - v.y) ^ 2)
                    ELSE abs((u.y - p.y) * (v.x - u.x) - (u.x - p.x) * (v.y - u.y))
                         / sqrt((v.x - u.x) ^ 2 + (v.y - u.y) ^ 2) END AS d
        FROM seg s
        JOIN pts p ON p.shape_id = s.shape_id AND p.n > s.a AND p.n < s.b
        JOIN pts u ON u.shape_id = s.shape_id AND u.n = s.a
        JOIN pts v ON v.shape_id = s.shape_id AND v.n = s.b
      )
    )
    GROUP BY shape_id, a, b
    HAVING max(d) > {tolerance}
  ) f CROSS JOIN (SELECT unnest([0, 1]) AS half) h
), kept AS (
  SELECT shape_id, a AS n FROM seg UNION SELECT shape_id, b FROM seg
  UNION SELECT shape_id, n FROM pts WHERE c = 1
)
SELECT shape_id, cast(0 AS BIGINT) AS part, cast(1 AS BIGINT) AS parts, cast(0 AS BIGINT) AS start,
       cast(to_json({{'type': 'LineString', 'coordinates': list([x, y] ORDER BY n)}}) AS VARCHAR) AS geometry
FROM kept JOIN pts USING (shape_id, n) GROUP BY shape_id
"""


def _banded(speed: str) -> str:
    """Clamped speed, band and place of an expression, as select items."""
    s = f"least(greatest(coalesce({speed}, 0.0), 0.0), 50.0)"
    return f"""{s} AS speed_clamped,
       CASE WHEN {s} < 5 THEN 0 WHEN {s} < 15 THEN 1 WHEN {s} < 30 THEN 2 ELSE 3 END AS speed_band,
       round(CASE WHEN {s} < 5 THEN {s} / 5 WHEN {s} < 15 THEN ({s} - 5) / 10
                  WHEN {s} < 30 THEN ({s} - 15) / 15 ELSE ({s} - 30) / 20 END, 6) AS speed_place"""


_COARSE = f"""concat('veh-', cast(user_id AS VARCHAR)) AS id,
         {{lat}} AS lat,
         substring({_LON}, 1, 5) AS lon,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS "routeTag",
         cast(event_id % 4 * 90 AS VARCHAR) AS heading"""

_DAILY = f"""daily AS (
  SELECT {_COARSE.format(lat=f"CASE WHEN event_id % 13 > 0 THEN substring({_LAT}, 1, 4) END")},
         cast(ts AS DATE) AS batch_id
  FROM events
), replayed AS (
  SELECT DISTINCT id, lat, lon, "routeTag", heading, batch_id
  FROM (SELECT *, min(batch_id) OVER (PARTITION BY id, lat, lon) AS first FROM daily)
  WHERE batch_id = first OR id IS NULL OR lat IS NULL OR lon IS NULL
)"""

_BAD_SPEED = "CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE \"speedKmHr\" END"


def _feature(geometry: str, properties: str) -> str:
    """Feature text from geometry text and a struct literal."""
    return (
        f"concat('{{\"type\":\"Feature\",\"geometry\":', {geometry}, "
        f"',\"properties\":', cast(to_json({properties}) AS VARCHAR), '}}') AS feature"
    )


_CELL_CENTRE = (
    "cast(to_json({'type': 'Point', 'coordinates': ["
    "round(0.46 * sqrt(3) * (q + r / 2.0) / (111.32 * cos(radians(43.65))) - 79.38, 4), "
    "round(0.46 * 1.5 * r / 110.574 + 43.65, 4)]}) AS VARCHAR)"
)

_CELL_RING = (
    "cast(to_json({'type': 'Polygon', 'coordinates': [[" + ", ".join(
        f"[round((0.46 * sqrt(3) * (q + r / 2.0) + 0.46 * cos(radians({angle}))) / (111.32 * cos(radians(43.65))) - 79.38, 6), "
        f"round((0.46 * 1.5 * r + 0.46 * sin(radians({angle}))) / 110.574 + 43.65, 6)]"
        for angle in (-30, 30, 90, 150, 210, 270, -30)
    ) + "]]}) AS VARCHAR)"
)

_SPEED_PROPERTIES = (
    "{'hexId': hex_id, 'hourOfDay': hour_of_day, 'speed': speed, 'numObservations': num_observations}"
)

_HOUR_PROPERTIES = (
    "{'hexId': hex_id, 'hourOfDay': hour_of_day, 'numObservations': num_observations}"
)

_INGESTED = f"""
WITH {_POSITIONS}, coarse AS (
  SELECT {_COARSE.format(lat=f"substring({_LAT}, 1, 4)")}, NULL::VARCHAR AS "dirTag", NULL::VARCHAR AS "secsSinceReport",
         NULL::VARCHAR AS predictable, NULL::VARCHAR AS "speedKmHr", ts + INTERVAL 5 SECOND AS fetched_at,
         date_trunc('millisecond', ts) AS api_timestamp, event_id
  FROM events
)
SELECT * EXCLUDE (event_id) FROM coarse
QUALIFY (api_timestamp, fetched_at, event_id) = min((api_timestamp, fetched_at, event_id)) OVER (PARTITION BY id, lat, lon)
""".replace(f"{_POSITIONS}, ", "")

_PAYLOADS = f"""{_POSITIONS}, payloads AS (
  SELECT event_id, fetched_at,
    concat(CASE WHEN event_id % 7 > 0 THEN concat('{{"vehicle":[',
      replace(cast(to_json({{'id': id, 'routeTag': "routeTag", 'dirTag': "dirTag", 'lat': lat, 'lon': lon,
        'secsSinceReport': "secsSinceReport", 'predictable': predictable, 'heading': heading,
        'speedKmHr': "speedKmHr"}}) AS VARCHAR), '"dirTag":null,', ''), ',',
      cast(to_json({{'id': concat('veh-', cast(user_id + 1000000 AS VARCHAR)), 'routeTag': "routeTag", 'lat': lat, 'lon': lon}}) AS VARCHAR),
      '],') ELSE '{{' END,
      '"lastTime":{{"time":"', cast(epoch_us(api_timestamp) // 1000 AS VARCHAR), '"}}}}') AS value
  FROM positions JOIN (SELECT event_id, user_id FROM events) USING (event_id)
)"""

_DAMAGED = "CASE WHEN event_id % 3 = 0 THEN value[:length(value) - 5] ELSE replace(value, 'lastTime', 'noTime') END"

ORACLE: dict[str, str] = {
    "current_locations": f"""
WITH {_POSITIONS}, {_RECENT}, {_LATEST}
SELECT *, {_POINT} AS geometry FROM latest
""",
    "current_locations_features": f"""
WITH {_POSITIONS}, {_RECENT}, {_LATEST}
SELECT {_feature(_POINT, '''{'id': id, 'routeTag': "routeTag", 'dirTag': "dirTag", 'heading': heading,
  'predictable': predictable, 'secsSinceReport': "secsSinceReport", 'speedKmHr': "speedKmHr",
  'fetched_at': cast(fetched_at AS VARCHAR), 'api_timestamp': cast(api_timestamp AS VARCHAR)}''')}
FROM latest
""",
    "current_paths": f"""
WITH {_POSITIONS}, {_RECENT}, {_PATHS}
SELECT id, cast(0 AS BIGINT) AS part, cast(1 AS BIGINT) AS parts, cast(0 AS BIGINT) AS start,
       n AS n_points, round(speed, 6) AS "avgSpeedKmHr",
       last_heading AS "lastHeading", {_LINE} AS geometry
FROM paths
""",
    "current_paths_line": f"""
WITH {_POSITIONS}, {_RECENT}, numbered AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY api_timestamp, event_id) - 1 AS position,
         cast(lon AS DOUBLE) AS lon, cast(lat AS DOUBLE) AS lat, count(*) OVER (PARTITION BY id) AS n
  FROM recent
)
SELECT id, position, lon, lat FROM numbered WHERE n > 1
""",
    "bound_parameters": f"""
WITH {_POSITIONS}
SELECT count(*) AS n_rows, count(DISTINCT id) AS n_vehicles FROM positions
WHERE api_timestamp >= (SELECT max(ts) FROM events) - 604800 * INTERVAL '1 second'
  AND "routeTag" = 'click'
""",
    "current_paths_features": f"""
WITH {_POSITIONS}, {_RECENT}, {_PATHS}
SELECT {_feature(_LINE, "{'id': id, 'part': 0, 'avgSpeedKmHr': round(speed, 6), 'lastHeading': last_heading}")} FROM paths
""",
    "markers": f"""
WITH {_POSITIONS}, {_RECENT}, {_PATHS}
SELECT id, points[-1][1] AS lon, points[-1][2] AS lat, round(speed, 6) AS "avgSpeedKmHr",
       last_heading AS "lastHeading",
       CASE WHEN last_heading IS NULL THEN 'dot' ELSE 'arrow' END AS marker,
       round(speed_clamped, 6) AS speed_clamped, speed_band, speed_place
FROM (SELECT *, {_banded("speed")} FROM paths)
""",
    "typed_positions": f"""
WITH {_POSITIONS}
SELECT id, try_cast(lat AS DOUBLE) AS lat, try_cast(lon AS DOUBLE) AS lon,
       try_cast("secsSinceReport" AS INTEGER) AS "secsSinceReport",
       try_cast(predictable AS BOOLEAN) AS predictable,
       try_cast(heading AS INTEGER) AS heading,
       try_cast({_BAD_SPEED} AS DOUBLE) AS "speedKmHr",
       "routeTag", "dirTag", fetched_at, api_timestamp, event_id,
       CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END AS rejected
FROM positions
""",
    "rejected_numbers": f"""
WITH {_POSITIONS}
SELECT "routeTag", count(*) AS n_rows,
       cast(sum(CASE WHEN try_cast({_BAD_SPEED} AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS BIGINT)
         AS n_rejected
FROM positions GROUP BY "routeTag"
""",
    "avg_speeds": f"""
WITH {_POSITIONS}, {_PLANE}, {_SPEEDS}
SELECT * FROM speeds
""",
    "avg_speeds_hour": f"""
WITH {_POSITIONS}, {_PLANE}, {_SPEEDS}
SELECT *, {_CELL_RING} AS geometry FROM this_hour
""",
    "avg_speeds_features": f"""
WITH {_POSITIONS}, {_PLANE}, {_SPEEDS}
SELECT {_feature(_CELL_RING, _SPEED_PROPERTIES)} FROM this_hour
""",
    "document_features": f"""
WITH {_POSITIONS}, {_PLANE}, {_SPEEDS}
SELECT {_feature(_CELL_RING, _SPEED_PROPERTIES)} FROM this_hour
""",
    "feature_documents": f"""
WITH {_POSITIONS}, {_PLANE}, {_SPEEDS}, features AS (
  SELECT {_feature(_CELL_RING, _SPEED_PROPERTIES)} FROM this_hour
), numbered AS (SELECT feature, (row_number() OVER (ORDER BY feature) - 1) // 50 AS document FROM features)
SELECT document, concat('{{"type":"FeatureCollection","features":[', string_agg(feature, ',' ORDER BY feature), ']}}') AS geojson
FROM numbered GROUP BY document
""",
    "avg_speeds_corners": f"""
WITH {_POSITIONS}, {_PLANE}, {_SPEEDS}
SELECT hex_id, hour_of_day, 'Polygon' AS geometry_type, 7 AS n_corners, true AS closed,
       round((0.46 * sqrt(3) * (q + r / 2.0) + 0.46 * cos(radians(-30)))
             / (111.32 * cos(radians(43.65))) - 79.38, 9) AS first_lon,
       round((0.46 * 1.5 * r + 0.46 * sin(radians(-30))) / 110.574 + 43.65, 9) AS first_lat
FROM this_hour
""",
    "feature_collection": f"""
WITH {_POSITIONS}, {_PLANE}, {_SPEEDS}, features AS (
  SELECT {_feature(_CELL_CENTRE, _HOUR_PROPERTIES)} FROM this_hour
)
SELECT concat('{{"type":"FeatureCollection","features":[',
              coalesce(string_agg(feature, ',' ORDER BY feature), ''), ']}}') AS geojson
FROM features
""",
    "hex_boundary": f"""
WITH {_POSITIONS}, {_PLANE}, cell AS (SELECT DISTINCT q, r FROM cells),
corners AS (SELECT q, r, unnest([0, 1, 2, 3, 4, 5, 6]) AS corner FROM cell)
SELECT q, r, corner,
       round((0.46 * sqrt(3) * (q + r / 2.0) + 0.46 * cos(radians(60 * (corner % 6) - 30)))
             / (111.32 * cos(radians(43.65))) - 79.38, 9) AS lon,
       round((0.46 * 1.5 * r + 0.46 * sin(radians(60 * (corner % 6) - 30))) / 110.574 + 43.65, 9) AS lat
FROM corners
""",
    "build_stops": f"""
WITH {_STOPS_FILE}
SELECT stop_id, stop_code, stop_name, stop_desc, zone_id, stop_url, location_type, parent_station,
       stop_timezone, wheelchair_boarding, {_STOP_POINT} AS coords
FROM stops_file
""",
    "stops": f"""
WITH {_STOPS_FILE}
SELECT stop_id, stop_name, {_DIRECTION} AS label_direction, {_STOP_POINT} AS geometry FROM stops_file
""",
    "stops_features": f"""
WITH {_STOPS_FILE}, named AS (SELECT *, {_DIRECTION} AS direction FROM stops_file)
SELECT {_feature(_STOP_POINT,
  "{'stop_id': stop_id, 'stopName': stop_name, 'labelDirection': direction}")}
FROM named
""",
    "stop_labels": f"""
WITH {_STOPS_FILE}, unnamed AS (
  SELECT stop_id, CASE WHEN cast(stop_id AS BIGINT) % 9 > 0 THEN stop_name END AS stop_name
  FROM stops_file
)
SELECT stop_id, coalesce(stop_name, '') AS stop_name, coalesce({_DIRECTION}, 0) AS label_direction
FROM unnamed
""",
    "build_routes": f"""
WITH {_SHAPE_POINTS}
SELECT shape_id, cast(0 AS BIGINT) AS part, cast(1 AS BIGINT) AS parts, cast(0 AS BIGINT) AS start,
       count(*) AS n_points,
       cast(to_json(list([x, y] ORDER BY seq, tie_1, tie_2)) AS VARCHAR) AS points
FROM shape_points GROUP BY shape_id
""",
    "routes": _simplified(0.0001),
    "routes_features": f"""
WITH simplified AS ({_simplified(0.0001)})
SELECT {_feature("geometry", "{'shape_id': shape_id, 'part': 0}")} FROM simplified
""",
    "routes_coarse": _simplified(0.005),
    "to_features": f"""
WITH given AS (
  SELECT c_custkey AS id, nullif(c_mktsegment, 'BUILDING') AS segment,
         CASE WHEN c_custkey % 5 > 0 THEN concat('{{"type":"Point","coordinates":[-79.',
           cast(1000 + c_custkey % 7919 AS VARCHAR), ',43.', cast(1000 + c_custkey % 997 AS VARCHAR),
           ']}}') END AS geometry
  FROM customer
)
SELECT {_feature("geometry", "{'id': id, 'segment': segment}")} FROM given WHERE geometry IS NOT NULL
""",
    "point_xy": f"""
WITH {_POSITIONS}
SELECT event_id, cast(lon AS DOUBLE) AS x, cast(lat AS DOUBLE) AS y FROM positions
""",
    "wkt_geometry": """
WITH given AS (
  SELECT o_orderkey,
         [cast(concat('-79.', cast(1000 + o_orderkey % 9000 AS VARCHAR)) AS DOUBLE),
          cast(concat('43.', cast(1001 + o_custkey % 899 AS VARCHAR)) AS DOUBLE)] AS a
  FROM orders
)
SELECT o_orderkey,
       CASE o_orderkey % 4
         WHEN 0 THEN cast(to_json({'type': 'Point', 'coordinates': a}) AS VARCHAR)
         WHEN 1 THEN cast(to_json({'type': 'LineString', 'coordinates': [a, [-79.5, 43.5]]}) AS VARCHAR)
         WHEN 2 THEN cast(to_json({'type': 'Polygon',
           'coordinates': [[a, [-79.5, 43.5], [-79.25, 43.75], a]]}) AS VARCHAR)
       END AS geometry,
       CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 END AS n
FROM given
""",
    "mercator": f"""
WITH {_POSITIONS}
SELECT event_id, round(radians(cast(lon AS DOUBLE)), 9) AS mx,
       round(-ln(tan(pi() / 4 + radians(cast(lat AS DOUBLE)) / 2)), 9) AS my
FROM positions
""",
    "extent": f"""
WITH {_STOPS_FILE}, {_STOP_PLANE}
SELECT round(min(mx), 9) AS min_x, round(max(mx), 9) AS max_x,
       round(min(my), 9) AS min_y, round(max(my), 9) AS max_y
FROM stop_plane
""",
    "canvas_stops": f"""
WITH {_STOPS_FILE}, {_STOP_PLANE}, bounds AS (
  SELECT min(mx) AS x0, max(mx) AS x1, min(my) AS y0, max(my) AS y1 FROM stop_plane
), view AS (SELECT *, least(800 / (x1 - x0), 600 / (y1 - y0)) AS k FROM bounds)
SELECT stop_id, round(k * mx + 500 - k * (x0 + x1) / 2, 6) AS px,
       round(k * my + 400 - k * (y0 + y1) / 2, 6) AS py
FROM stop_plane, view
""",
    "lod_stops": f"""
WITH {_STOPS_FILE}, numbered AS (
  SELECT stop_id, stop_name, row_number() OVER (ORDER BY stop_id) - 1 AS stop_no FROM stops_file
)
SELECT * FROM numbered WHERE stop_no % 6 = 0
""",
    "lod_stops_moving": f"""
WITH {_STOPS_FILE}, numbered AS (
  SELECT stop_id, stop_name, row_number() OVER (ORDER BY stop_id) - 1 AS stop_no FROM stops_file
)
SELECT * FROM numbered WHERE stop_no % 36 = 0
""",
    "speed_scale": f"""
WITH {_POSITIONS}, speeds AS (
  SELECT event_id, CASE WHEN event_id % 19 > 0 THEN cast("speedKmHr" AS DOUBLE) END AS speed FROM positions
)
SELECT event_id, {_banded("speed")} FROM speeds
""",
    "speed_bands": f"""
WITH {_POSITIONS}, banded AS (
  SELECT {_banded('cast("speedKmHr" AS DOUBLE)')} FROM positions
)
SELECT speed_band, count(*) AS n FROM banded GROUP BY speed_band
""",
    "drawable_rings": """
WITH counted AS (
  SELECT event_id, 2 + CASE WHEN event_id % 3 > 0 THEN 1 ELSE 0 END
                     + CASE WHEN event_id % 2 > 0 THEN 1 ELSE 0 END AS n_vertices
  FROM events
)
SELECT * FROM counted WHERE n_vertices >= 3
""",
    "feed_parse": f"""
WITH {_POSITIONS}, sent AS (
  SELECT * FROM positions JOIN (SELECT event_id, user_id FROM events) USING (event_id)
  WHERE event_id % 7 > 0
)
SELECT id, "routeTag", "dirTag", lat, lon, "secsSinceReport", predictable, heading, "speedKmHr",
       fetched_at, date_trunc('millisecond', api_timestamp) AS api_timestamp, event_id
FROM sent
UNION ALL
SELECT concat('veh-', cast(user_id + 1000000 AS VARCHAR)), "routeTag", NULL, lat, lon, NULL, NULL, NULL,
       NULL, fetched_at, date_trunc('millisecond', api_timestamp), event_id
FROM sent
""",
    "feed_cursor": "SELECT cast(epoch_us(max(ts)) // 1000 AS VARCHAR) AS cursor FROM events",
    "raw_landing": f"""
WITH {_PAYLOADS}
SELECT event_id AS sequence, md5(value) AS value_md5, fetched_at, CASE WHEN event_id % 7 > 0 THEN 2 ELSE 0 END AS n_vehicles
FROM payloads
""",
    "dedup_consecutive": f"""
WITH {_DAILY}, reports AS (
  SELECT id, batch_id, lag(batch_id) OVER (PARTITION BY id ORDER BY batch_id) AS before
  FROM (SELECT DISTINCT id, batch_id FROM daily WHERE lat IS NOT NULL)
)
SELECT DISTINCT d.* FROM daily d LEFT JOIN reports r ON d.id = r.id AND d.batch_id = r.batch_id
WHERE d.lat IS NULL OR NOT EXISTS (
  SELECT 1 FROM daily e WHERE e.id = d.id AND e.lat = d.lat AND e.lon = d.lon AND e.batch_id = r.before
)
""",
    "dedup_replay": f"WITH {_DAILY} SELECT * FROM replayed",
    "insert_counts": f"""
WITH {_DAILY}, received AS (SELECT batch_id, count(*) AS received FROM daily GROUP BY batch_id),
kept AS (SELECT batch_id, count(*) AS n FROM replayed GROUP BY batch_id)
SELECT batch_id, received, coalesce(n, 0) AS inserted, received - coalesce(n, 0) AS skipped
FROM received LEFT JOIN kept USING (batch_id)
""",
    "anti_join_new_positions": f"""
WITH {_DAILY}, half AS (
  SELECT cast(min(batch_id) + cast((max(batch_id) - min(batch_id)) // 2 AS INTEGER) AS DATE) AS middle FROM daily
)
SELECT DISTINCT id, lat, lon, "routeTag", heading FROM daily d
WHERE batch_id >= (SELECT middle FROM half) AND NOT EXISTS (
  SELECT 1 FROM daily v
  WHERE v.batch_id < (SELECT middle FROM half) AND v.id = d.id AND v.lat = d.lat AND v.lon = d.lon
)
""",
    "stream_ingest": _INGESTED,
    "ingest_restart": _INGESTED,
    "bad_feed_files": f"""
WITH {_PAYLOADS}
SELECT md5({_DAMAGED}) AS value_md5, length({_DAMAGED}) AS n_chars FROM payloads WHERE event_id % 3 = 0 OR event_id % 5 = 0
""",
    "indented_feed_files": f"""
WITH {_PAYLOADS}
SELECT md5(value) AS value_md5, CASE WHEN event_id % 7 > 0 THEN 2 ELSE 0 END AS n_vehicles, false AS malformed FROM payloads
""",
    "bad_payloads": f"""
WITH {_PAYLOADS}
SELECT event_id, length({_DAMAGED}) AS n_chars, fetched_at FROM payloads WHERE event_id % 3 = 0 OR event_id % 5 = 0
""",
    "locations_as_of_past": f"""
WITH {_POSITIONS}, at AS (
  SELECT date_trunc('hour', min(ts) + (max(ts) - min(ts)) / 2) AS now FROM events
), recent AS (
  SELECT * FROM positions
  WHERE api_timestamp BETWEEN (SELECT now FROM at) - INTERVAL 1 DAY AND (SELECT now FROM at)
), {_LATEST}
SELECT *, {_POINT} AS geometry FROM latest
""".replace(" at AS (", " middle AS (").replace("FROM at)", "FROM middle)"),
    "archive_resource": """
WITH listed AS (
  SELECT o_orderkey, o_custkey, unnest([0, 1, 2]) AS i FROM orders
), outside AS (
  SELECT o_orderkey, o_custkey, min(i) AS i FROM listed
  WHERE (o_orderkey + i * o_custkey) % 3 = 0 GROUP BY o_orderkey, o_custkey
)
SELECT o_orderkey, concat('r', cast(o_orderkey * 10 + i AS VARCHAR)) AS resource_id,
       concat('r', cast(o_orderkey * 10 + i AS VARCHAR)) AS resource_name,
       concat('http://data/', cast(o_custkey AS VARCHAR), '/', cast(i AS VARCHAR), '.zip') AS url
FROM outside
""",
    "archive_stops": f"WITH {_STOPS_FILE} SELECT * FROM stops_file",
    "archive_stops_inferred": f"""
WITH {_STOPS_FILE}
SELECT * REPLACE (cast(stop_id AS BIGINT) AS stop_id, cast(location_type AS BIGINT) AS location_type,
  cast(parent_station AS BIGINT) AS parent_station, cast(wheelchair_boarding AS BIGINT) AS wheelchair_boarding)
FROM stops_file
""",
    "archive_members": """
SELECT 'stops.txt' AS member, 'ttc_stops' AS table_name,
  'stop_id,stop_code,stop_name,stop_desc,zone_id,stop_url,location_type,parent_station,stop_timezone,wheelchair_boarding,stop_lat,stop_lon' AS columns
UNION ALL SELECT 'agency.txt', 'ttc_agency', 'agency_id,agency_name'
UNION ALL SELECT 'empty.txt', 'ttc_empty', ''
""",
    "archive_routes": f"""
WITH {_SHAPE_POINTS}
SELECT shape_id, cast(0 AS BIGINT) AS part, cast(1 AS BIGINT) AS parts, cast(0 AS BIGINT) AS start,
       count(*) AS n_points, cast(to_json(list([x, y] ORDER BY seq, x, y)) AS VARCHAR) AS points
FROM shape_points GROUP BY shape_id
""",
    "inferred_types": """
SELECT o_orderkey AS order_no, cast(cast(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS price,
       o_custkey % 2 = 0 AS even,
       CASE WHEN o_orderkey % 997 = 3 THEN concat('t_', cast(o_orderkey AS VARCHAR))
            ELSE cast(o_orderkey AS VARCHAR) END AS mixed
FROM orders
""",
    "replaced_table": f"""
WITH {_STOPS_FILE}
SELECT * EXCLUDE (stop_lat, stop_lon) FROM stops_file WHERE parent_station IS NOT NULL
""",
    "snapshot_copy": f"""
WITH {_POSITIONS} SELECT * FROM positions
""",
    "missing_table": f"WITH {_POSITIONS} SELECT * FROM positions",
}
