"""SQL restatement of the derived tables, as common table expressions with their dependencies."""

from workload.rounding import expand_round

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], sql: str) -> None:
    CTES[name] = (needs, sql)


def build(select: str, *needs: str) -> str:
    """``select`` preceded by every CTE it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in CTES[name][0]:
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    body = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    return expand_round(f"WITH {body}\n{select}" if order else select)


def _haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
        f"*pow(sin(radians({lon2}-{lon1})/2),2))"
    )
    return f"(3440.065::DOUBLE*2*atan2(sqrt({a}),sqrt(1-{a})))"


def _bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    y = f"(sin(radians({lon2}-{lon1}))*cos(radians({lat2})))"
    x = (
        f"(cos(radians({lat1}))*sin(radians({lat2}))-sin(radians({lat1}))*cos(radians({lat2}))"
        f"*cos(radians({lon2}-{lon1})))"
    )
    return f"fmod(degrees(atan2({y},{x}))+360, 360)"


def _risk(x: str) -> str:
    return f"CASE WHEN {x}<25 THEN 'low' WHEN {x}<50 THEN 'medium' WHEN {x}<75 THEN 'high' ELSE 'critical' END"


haversine, bearing, risk = _haversine, _bearing, _risk

cte(
    "raw",
    [],
    """
SELECT 'ac' || (1000 + user_id % 40) AS icao24, upper(event_type) || (user_id % 40) AS callsign,
  1766685600 + event_id * 4 AS ts,
  CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 95.0::DOUBLE
    ELSE 30.0137::DOUBLE + (user_id % 40) * 0.25::DOUBLE + (event_id % 1000) * 0.001::DOUBLE END AS lat,
  -100.0091::DOUBLE + (user_id % 40) * 0.5::DOUBLE + (event_id % 2000) * 0.002::DOUBLE AS lon,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 211 = 0 THEN 99999.0::DOUBLE
    ELSE value * 100.0::DOUBLE END + bump AS alt,
  CASE WHEN event_id % 53 = 0 THEN NULL WHEN event_id % 223 = 0 THEN 900.0::DOUBLE ELSE value + 100.0::DOUBLE END AS spd,
  ((event_id * 37) % 360)::DOUBLE AS hdg, ((event_id % 5 - 2) * 800)::DOUBLE AS vr,
  CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'F' WHEN 2 THEN '1.0' ELSE 'false' END AS ground_text,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE printf('%04d', event_id % 7777) END AS squawk, src, event_id
FROM events, (VALUES ('a', 0.0::DOUBLE), ('b', 1.0::DOUBLE)) AS copies(src, bump)
WHERE src = 'a' OR event_id % 50 = 0""",
)
cte(
    "sv",
    ["raw"],
    """
SELECT icao24, callsign, ts, lat, lon, alt, spd, hdg, vr,
  CASE WHEN lower(ground_text) IN ('true','1','t') THEN true WHEN lower(ground_text) IN ('false','0','f') THEN false END AS on_ground,
  coalesce(squawk, '') AS squawk, src, make_timestamp(ts * 1000000)::DATE AS date FROM raw""",
)
cte(
    "valid",
    ["sv"],
    """
SELECT * FROM sv WHERE lat IS NOT NULL AND lon IS NOT NULL AND ts IS NOT NULL AND lat >= -90 AND lat <= 90
  AND lon >= -180 AND lon <= 180 AND (alt IS NULL OR (alt >= -1000 AND alt <= 60000))
  AND (spd IS NULL OR (spd >= 0 AND spd <= 700))""",
)
cte(
    "clean",
    ["valid"],
    "SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY date, icao24, ts ORDER BY src) = 1",
)
cte(
    "seg",
    ["clean"],
    """
SELECT *, min(ts) OVER s AS seg_start, max(ts) OVER s AS seg_end FROM (
  SELECT *, sum(is_new) OVER (PARTITION BY date, icao24 ORDER BY ts) AS seg_no FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY date, icao24 ORDER BY ts) <= 300 THEN 0 ELSE 1 END AS is_new FROM clean))
WINDOW s AS (PARTITION BY date, icao24, seg_no) QUALIFY count(*) OVER s > 1""",
)
_MEASURES = ["lat", "lon", "alt", "spd", "hdg", "vr"]
cte(
    "filled",
    ["seg"],
    "SELECT * EXCLUDE (lat, lon, alt, spd, hdg, vr), "
    + ", ".join(f"{c} AS raw_{c}" for c in _MEASURES)
    + ", "
    + ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
        for c in _MEASURES
    )
    + " FROM seg WINDOW w AS (PARTITION BY date, icao24, seg_start ORDER BY ts)",
)
cte(
    "ids",
    ["seg"],
    """
SELECT date, icao24, seg_start, seg_end, n, callsign, on_ground,
  icao24 || '_' || date::VARCHAR || '_' || printf('%04d', row_number() OVER (PARTITION BY date ORDER BY icao24, seg_start) - 1) AS flight_id
FROM (SELECT date, icao24, seg_start, seg_end, count(*) AS n, first(callsign ORDER BY ts) AS callsign,
  first(on_ground ORDER BY ts) AS on_ground FROM seg GROUP BY ALL)""",
)
cte(
    "points",
    ["ids", "filled", "seg"],
    "WITH ticks AS (SELECT date, icao24, seg_start, flight_id, callsign, on_ground, "
    "unnest(generate_series(seg_start, seg_end, 10)) AS ts FROM ids WHERE seg_end - seg_start >= 10), "
    "spans AS (SELECT *, lead(ts) OVER w AS next_ts, "
    + ", ".join(f"lead({c}) OVER w AS next_{c}" for c in _MEASURES)
    + " FROM filled WINDOW w AS (PARTITION BY date, icao24, seg_start ORDER BY ts)) "
    "SELECT t.date, t.icao24, t.seg_start, t.flight_id, t.callsign, t.on_ground, t.ts, "
    + ", ".join(
        f"CASE WHEN s.next_ts IS NULL THEN s.{c} ELSE s.{c} + (s.next_{c} - s.{c}) / (s.next_ts - s.ts) * (t.ts - s.ts) END AS {c}"
        for c in _MEASURES
    )
    + " FROM ticks t ASOF JOIN spans s ON t.date = s.date AND t.icao24 = s.icao24 AND t.seg_start = s.seg_start AND t.ts >= s.ts "
    "UNION ALL SELECT i.date, i.icao24, i.seg_start, i.flight_id, i.callsign, i.on_ground, s.ts, "
    + ", ".join(f"s.{c}" for c in _MEASURES)
    + " FROM ids i JOIN seg s USING (date, icao24, seg_start) WHERE i.seg_end - i.seg_start < 10",
)
cte(
    "steps",
    ["points"],
    f"""
SELECT *, {_haversine('plat', 'plon', 'lat', 'lon')} AS step_nm,
  least(abs(phdg - hdg) % 360, 360 - abs(phdg - hdg) % 360) AS turn_deg,
  CASE WHEN pvr <= 0 AND coalesce(vr, 0) > 500 THEN 1 ELSE 0 END AS climb_start,
  CASE WHEN pvr >= 0 AND coalesce(vr, 0) < -500 THEN 1 ELSE 0 END AS descent_start
FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(coalesce(vr, 0)) OVER w AS pvr,
  last_value(hdg IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS phdg
  FROM points WINDOW w AS (PARTITION BY flight_id ORDER BY ts))""",
)
cte(
    "flights",
    ["steps"],
    """
SELECT flight_id, date, icao24, any_value(callsign) AS callsign, count(*) AS n_points, min(ts) AS first_ts, max(ts) AS last_ts,
  max(ts) - min(ts) AS duration_sec, coalesce(sum(step_nm), 0) AS distance_nm, coalesce(max(alt), 0) AS max_alt_ft,
  coalesce(avg(spd), 0) AS avg_speed_kts, coalesce(sum(turn_deg), 0) AS heading_change_total,
  sum(climb_start) AS climb_count, sum(descent_start) AS descent_count
FROM steps GROUP BY flight_id, date, icao24""",
)
cte(
    "celled",
    ["points"],
    """
SELECT *, ((ts // 3600) % 24)::INT AS hour, round_even(lat / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS grid_lat,
  round_even(lon / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS grid_lon FROM points""",
)
cte(
    "grid",
    ["celled"],
    """
SELECT date, hour, grid_lat, grid_lon, count(DISTINCT flight_id) AS flight_count, count(*) AS point_count,
  avg(alt) AS avg_altitude_ft, avg(spd) AS avg_speed_kts FROM celled GROUP BY ALL""",
)
cte(
    "cell_stats",
    ["grid"],
    """
SELECT grid_lat, grid_lon, avg(flight_count) AS mean_flights, stddev_samp(flight_count) AS std_flights,
  max(flight_count) AS max_flights, avg(point_count) AS mean_points, stddev_samp(point_count) AS std_points
FROM grid GROUP BY ALL""",
)
cte(
    "density",
    ["grid", "cell_stats"],
    """
SELECT g.date, g.hour, g.grid_lat, g.grid_lon, g.flight_count / greatest(s.max_flights, 1) AS density_score,
  CASE WHEN s.std_flights IS NULL THEN 1.0 ELSE greatest(1.0, least(99.0,
    50 + 15 * (g.flight_count - s.mean_flights) / greatest(s.std_flights, 1.0))) END::DOUBLE AS density_percentile
FROM grid g JOIN cell_stats s USING (grid_lat, grid_lon)""",
)
cte(
    "dispersion",
    ["celled"],
    """
SELECT grid_lat, grid_lon, hour, stddev_pop(coalesce(alt, 0)) AS alt_std, stddev_pop(coalesce(hdg, 0)) AS heading_std,
  stddev_pop(coalesce(spd, 0)) AS speed_std FROM celled GROUP BY ALL""",
)
cte(
    "stress",
    ["dispersion", "grid"],
    f"""
SELECT *, {_risk('stress_index')} AS risk_level FROM (
  SELECT *, density * 40 + maneuver * 35 + heading * 20 + 0 * 5 AS stress_index FROM (
    SELECT d.date, p.hour, p.grid_lat, p.grid_lon, coalesce(d.mean_flights / m.top, 0.5) AS density,
      (least(1.0, p.alt_std / 10000) + least(1.0, p.speed_std / 200)) / 2 AS maneuver, least(1.0, p.heading_std / 180) AS heading
    FROM dispersion p LEFT JOIN (SELECT grid_lat, grid_lon, hour, avg(flight_count) AS mean_flights, min(date) AS date
      FROM grid GROUP BY ALL) d USING (grid_lat, grid_lon, hour), (SELECT greatest(max(flight_count), 1) AS top FROM grid) m))""",
)
cte(
    "mids",
    ["points"],
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY ts) - 1 AS i,
  count(*) OVER (PARTITION BY flight_id) AS n FROM points) WHERE i = n // 2""",
)
cte(
    "pred",
    ["mids", "points"],
    """
SELECT g.flight_id, g.date, g.mid_ts, g.horizon_sec, g.target_ts, g.plat, g.plon, g.palt, g.conf,
  a.ts AS actual_ts, a.lat AS alat, a.lon AS alon, a.alt AS aalt,
  CASE WHEN a.ts IS NOT NULL THEN sqrt(pow(g.plat - a.lat, 2) + pow(g.plon - a.lon, 2)) * 60 END AS err_lat,
  CASE WHEN a.ts IS NOT NULL THEN abs(g.palt - coalesce(a.alt, 0)) END AS err_alt
FROM (SELECT flight_id, date, ts AS mid_ts, h AS horizon_sec, ts + h AS target_ts,
    lat + coalesce(spd, 0) * 1.852::DOUBLE / 399600.0::DOUBLE * h * cos(radians(coalesce(hdg, 0))) AS plat,
    lon + coalesce(spd, 0) * 1.852::DOUBLE / 399600.0::DOUBLE * h * sin(radians(coalesce(hdg, 0)))
      / greatest(cos(radians(lat)), 0.001) AS plon,
    coalesce(alt, 0) + coalesce(vr, 0) * (h / 60.0::DOUBLE) AS palt, greatest(0.3, 1 - h / 600.0::DOUBLE) AS conf
  FROM mids, (VALUES (60), (120), (300)) AS hs(h) WHERE n >= 10) g
ASOF LEFT JOIN points a ON g.flight_id = a.flight_id AND a.ts >= g.target_ts""",
)
_FEATURES = [
    "duration_sec",
    "distance_nm",
    "max_alt_ft",
    "avg_speed_kts",
    "heading_change_total",
    "climb_count",
    "descent_count",
]
cte(
    "scaler",
    ["flights"],
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {i} AS pos, avg({f})::DOUBLE AS mean, "
        f"CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END::DOUBLE AS scale FROM flights"
        for i, f in enumerate(_FEATURES)
    ),
)
cte(
    "explained",
    ["flights", "scaler", "mids"],
    """
SELECT z.*, m.lat AS loc_lat, m.lon AS loc_lon, coalesce(m.alt, 0) AS loc_alt,
  CASE WHEN feature LIKE '%alt%' THEN 'altitude' WHEN feature LIKE '%speed%' THEN 'speed'
    WHEN feature LIKE '%heading%' THEN 'route' ELSE 'behavior' END AS anomaly_type,
  0.5::DOUBLE + (split_part(flight_id, '_', 3)::INT % 100) / 200.0::DOUBLE AS anomaly_score
FROM (SELECT u.flight_id, u.date, u.feature, u.observed, abs(u.observed - s.mean) / s.scale AS z
  FROM (UNPIVOT (SELECT flight_id, date, """
    + ", ".join(f"{f}::DOUBLE AS {f}" for f in _FEATURES)
    + " FROM flights) ON "
    + ", ".join(_FEATURES)
    + """ INTO NAME feature VALUE observed) u JOIN scaler s USING (feature)
  QUALIFY row_number() OVER (PARTITION BY u.flight_id ORDER BY abs(u.observed - s.mean) / s.scale DESC, s.pos) = 1) z
JOIN mids m USING (flight_id)""",
)
cte("anom", ["explained"], "SELECT * FROM explained WHERE anomaly_score >= 0.7")
