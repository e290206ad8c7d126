"""Cleaning, segmentation, resampling, features, grid."""

from pyspark.sql import functions as F

from vaportrail.functions import geo, labels
from vaportrail.operators import clean, grid, tracks
from workload import derived
from workload.ctes import bearing, build, haversine
from workload.registry import query
from workload.rounding import r, rd


@query(
    "f1_not_null",
    build(
        "SELECT date, count(*) AS n FROM sv WHERE lat IS NOT NULL AND lon IS NOT NULL AND ts IS NOT NULL GROUP BY date",
        "sv",
    ),
)
def f1(spark, d):
    rows = derived.state_vectors(spark, d).where(clean.located())
    return rows.groupBy("date").agg(F.count("*").alias("n"))


@query(
    "f5_validity",
    build(
        """SELECT coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, false) AS ok_position,
  coalesce(alt BETWEEN -1000 AND 60000, false) AS ok_altitude, coalesce(spd BETWEEN 0 AND 700, true) AS ok_speed,
  count(*) AS n FROM sv GROUP BY ALL""",
        "sv",
    ),
)
def f5(spark, d):
    return (
        derived.state_vectors(spark, d)
        .select(
            labels.valid_coordinate(F.col("latitude"), F.col("longitude")).alias("ok_position"),
            labels.valid_altitude(F.col("altitude")).alias("ok_altitude"),
            labels.valid_speed(F.col("velocity")).alias("ok_speed"),
        )
        .groupBy("ok_position", "ok_altitude", "ok_speed")
        .agg(F.count("*").alias("n"))
    )


@query("f6_dedup", build("SELECT date, icao24, ts AS timestamp, alt AS altitude, src AS _source_file FROM clean", "clean"))
def f6(spark, d):
    kept = derived.reports(spark, d)
    return kept.select("date", "icao24", "timestamp", "altitude", "_source_file")


@query(
    "f7_clean",
    build(
        "SELECT date, icao24, callsign, ts AS timestamp, lat AS latitude, lon AS longitude, alt AS altitude, "
        "spd AS velocity, hdg AS heading, vr AS vertical_rate, on_ground, squawk FROM clean",
        "clean",
    ),
)
def f7(spark, d):
    return derived.reports(spark, d).drop("_source_file", "_ingest_ts")


@query(
    "f7_quarantine",
    build(
        """SELECT date, CASE WHEN lat IS NULL OR lon IS NULL THEN 'no position' WHEN lat > 90 THEN 'position out of range'
  WHEN alt > 60000 THEN 'altitude out of range' ELSE 'speed out of range' END AS reason, count(*) AS rows
  FROM sv WHERE lat IS NULL OR lon IS NULL OR lat > 90 OR alt > 60000 OR spd > 700 GROUP BY ALL""",
        "sv",
    ),
)
def f7_quarantine(spark, d):
    return clean.quarantine(derived.state_vectors(spark, d))


@query(
    "f7_retention",
    build(
        """SELECT date, rows_in, rows_out, rows_out * 100.0 / rows_in AS retained_pct FROM
  (SELECT date, count(*) AS rows_in FROM sv GROUP BY date) JOIN (SELECT date, count(*) AS rows_out FROM clean GROUP BY date) USING (date)""",
        "clean",
    ),
)
def f7_retention(spark, d):
    return clean.retention(derived.state_vectors(spark, d))


@query(
    "f13_region",
    build("SELECT icao24, ts AS timestamp, lat AS latitude, lon AS longitude FROM clean WHERE lat BETWEEN 32 AND 36 AND lon BETWEEN -98 AND 180", "clean"),
)
def f13(spark, d):
    inside = geo.in_region(F.col("latitude"), F.col("longitude"), 32.0, 36.0, -98.0, 0)
    return derived.reports(spark, d).where(inside).select("icao24", "timestamp", "latitude", "longitude")


@query(
    "t1_sorted_reports",
    build("SELECT icao24, ts AS timestamp, row_number() OVER (PARTITION BY date, icao24 ORDER BY ts) AS place, date FROM clean", "clean"),
)
def t1(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("date", "icao24").orderBy("timestamp")
    return derived.reports(spark, d).select(
        "icao24", "timestamp", F.row_number().over(order).alias("place"), "date"
    )


@query(
    "w1_segments",
    build("SELECT date, icao24, seg_start, max(ts) AS seg_end, count(*) AS n FROM seg GROUP BY date, icao24, seg_start", "seg"),
)
def w1(spark, d):
    seg = derived.segmented(spark, d)
    return seg.groupBy(*tracks.FLIGHT).agg(F.max("timestamp").alias("seg_end"), F.count("*").alias("n"))


@query(
    "w2_fill",
    build(
        "SELECT date, icao24, ts AS timestamp, lat AS latitude, lon AS longitude, alt AS altitude, spd AS velocity, "
        "hdg AS heading, vr AS vertical_rate FROM filled",
        "filled",
    ),
)
def w2(spark, d):
    return tracks.fill(derived.segmented(spark, d)).select("date", "icao24", "timestamp", *tracks.MEASURES)


@query(
    "w3_resample",
    build(
        "SELECT date, icao24, seg_start, ts, callsign, on_ground, round(lat, 6) AS lat, round(lon, 6) AS lon, round(alt, 6) AS alt_ft, "
        "round(spd, 6) AS speed_kts, round(hdg, 6) AS heading_deg, round(vr, 6) AS vrate_fpm FROM points",
        "points",
    ),
)
def w3(spark, d):
    return derived.points(spark, d).select(
        *tracks.FLIGHT, "ts", "callsign", "on_ground", r("lat"), r("lon"), r("alt_ft"),
        r("speed_kts"), r("heading_deg"), r("vrate_fpm"),
    )


@query("w5_flight_ids", build("SELECT date, icao24, seg_start, flight_id FROM ids", "ids"))
def w5(spark, d):
    return derived.flight_ids(spark, d).select("date", "icao24", "seg_start", "flight_id")


@query(
    "w4_steps",
    build(
        "SELECT flight_id, ts, round(step_nm, 6) AS step_nm, round(turn_deg, 4) AS turn_deg, climb_start, descent_start FROM steps",
        "steps",
    ),
)
def w4(spark, d):
    pts = tracks.steps(derived.flight_points(spark, d))
    return pts.select("flight_id", "ts", r("step_nm"), r("turn_deg", 4), "climb_start", "descent_start")


@query(
    "a7_features",
    build(
        """SELECT flight_id, date, icao24, callsign, n_points, first_ts, last_ts, duration_sec, round(distance_nm, 5) AS distance_nm,
  round(max_alt_ft, 4) AS max_alt_ft, round(avg_speed_kts, 6) AS avg_speed_kts, round(heading_change_total, 3) AS heading_change_total,
  climb_count, descent_count FROM flights""",
        "flights",
    ),
)
def a7(spark, d):
    return derived.flights(spark, d).select(
        "flight_id", "date", "icao24", "callsign", F.size("points").alias("n_points"),
        F.get("points", F.lit(0))["ts"].alias("first_ts"), F.element_at("points", -1)["ts"].alias("last_ts"),
        "duration_sec", r("distance_nm", 5), r("max_alt_ft", 4), r("avg_speed_kts"),
        r("heading_change_total", 3), "climb_count", "descent_count",
    )


@query(
    "a1_grid_density",
    build(
        "SELECT date, hour, grid_lat, grid_lon, flight_count, point_count, round(avg_altitude_ft, 6) AS avg_altitude_ft, "
        "round(avg_speed_kts, 6) AS avg_speed_kts FROM grid",
        "grid",
    ),
)
def a1(spark, d):
    return derived.grid_density(spark, d).select(
        *grid.CELL_HOUR, "flight_count", "point_count", r("avg_altitude_ft"), r("avg_speed_kts")
    )


@query(
    "b13_all_dates",
    build(
        """SELECT date, count(*) AS flights, sum(n_points) AS points, any_value(cells) AS cells FROM flights
  JOIN (SELECT date, count(*) AS cells FROM grid GROUP BY date) USING (date) GROUP BY date""",
        "flights",
        "grid",
    ),
)
def b13(spark, d):
    per_flight = derived.points(spark, d).groupBy(*tracks.FLIGHT).agg(F.count("*").alias("n"))
    flights = per_flight.groupBy("date").agg(F.count("*").alias("flights"), F.sum("n").alias("points"))
    cells = derived.grid_density(spark, d).groupBy("date").agg(F.count("*").alias("cells"))
    return flights.join(cells, "date")


@query(
    "s1_haversine",
    build(
        f"SELECT icao24, ts AS timestamp, round({haversine('plat', 'plon', 'lat', 'lon')}, 6) AS nm FROM "
        "(SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM clean WINDOW w AS (PARTITION BY date, icao24 ORDER BY ts))",
        "clean",
    ),
)
def s1(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("date", "icao24").orderBy("timestamp")
    lat, lon = F.col("latitude"), F.col("longitude")
    nm = geo.haversine_nm(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon)
    return derived.reports(spark, d).select("icao24", "timestamp", rd(nm, 6).alias("nm"))


@query(
    "s2_heading_diff",
    build(
        "SELECT icao24, ts AS timestamp, 180 - abs(180 - abs(phdg - hdg)) AS turn FROM "
        "(SELECT *, lag(hdg) OVER (PARTITION BY date, icao24 ORDER BY ts) AS phdg FROM clean)",
        "clean",
    ),
)
def s2(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("date", "icao24").orderBy("timestamp")
    turn = geo.heading_difference(F.lag("heading").over(w), F.col("heading"))
    return derived.reports(spark, d).select("icao24", "timestamp", turn.alias("turn"))


@query(
    "s3_s4_cell_and_hour",
    build(
        "SELECT icao24, ts AS timestamp, round_even(lat / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS grid_lat, "
        "round_even(lon / 0.5::DOUBLE, 0) * 0.5::DOUBLE AS grid_lon, hour(make_timestamp(ts * 1000000))::INT AS hour FROM clean",
        "clean",
    ),
)
def s3_s4(spark, d):
    return derived.reports(spark, d).select(
        "icao24", "timestamp", geo.snap_to_grid(F.col("latitude")).alias("grid_lat"),
        geo.snap_to_grid(F.col("longitude")).alias("grid_lon"), geo.hour_of_day(F.col("timestamp")).alias("hour"),
    )


@query(
    "s12_bearing",
    build(
        f"SELECT icao24, ts AS timestamp, round({bearing('plat', 'plon', 'lat', 'lon')}, 6) AS bearing FROM "
        "(SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM clean WINDOW w AS (PARTITION BY date, icao24 ORDER BY ts))",
        "clean",
    ),
)
def s12(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("date", "icao24").orderBy("timestamp")
    lat, lon = F.col("latitude"), F.col("longitude")
    angle = geo.initial_bearing(F.lag(lat).over(w), F.lag(lon).over(w), lat, lon)
    return derived.reports(spark, d).select("icao24", "timestamp", rd(angle, 6).alias("bearing"))


@query(
    "u1_union_parts",
    build("SELECT src AS _source_file, count(*) AS n, count(squawk) AS with_squawk FROM (SELECT src, squawk FROM raw UNION ALL SELECT src, NULL FROM raw) GROUP BY src", "raw"),
)
def u1(spark, d):
    full = derived.raw_reports(spark, d)
    both = full.unionByName(full.drop("squawk"), allowMissingColumns=True)
    return both.groupBy("_source_file").agg(F.count("*").alias("n"), F.count("squawk").alias("with_squawk"))
