"""Read queries Q1..Q12 and the view-side operators."""

from pyspark.sql import functions as F

from vaportrail.operators import forecast, grid, live, registry, sampling, stress, timetravel, tracks
from vaportrail.plans import views
from vaportrail.session import stage
from workload import derived
from workload.ctes import bearing, build, risk
from workload.queries_gold import AUDIT_SQL, ESTIMATE, PLANES_SQL, THIN_SQL, cell_planes
from workload.registry import query
from workload.rounding import r, rd

T0 = 1766689205  # inside the first hour of the data, off the ten-second ticks
DAY = "2025-12-25"


def version_tables(spark, d):
    """Registry and version history of two runs, derived from the flights' dates and last report."""
    last = derived.reports(spark, d).agg(F.max("timestamp")).scalar()
    models = stage(registry.model_metadata(registry.training_window(derived.segmented(spark, d)), last), "models")
    run_date = models.agg(F.max("training_window_end")).scalar()
    trained = models.agg(F.max("trained_at")).scalar()
    first = stage(registry.next_version(models, None, run_date, trained), "version")
    return models, first.unionByName(registry.next_version(models, first, run_date, trained))


VERSION_SQL = "(SELECT 'v' || strftime(max(date), '%Y%m%d') || '--002' AS data_version, max(date)::VARCHAR AS last_date, min(date)::VARCHAR AS first_date FROM ids)"


@query(
    "q1_metadata",
    build(
        f"""SELECT data_version, (SELECT max(ts) FROM clean) AS last_trained, first_date, last_date, model_id, type, '1.0.0' AS version,
  (SELECT max(ts) FROM clean)::VARCHAR AS trained_at FROM {VERSION_SQL} v, (VALUES ('traj_pred_001', 'trajectory'), ('anomaly_001', 'anomaly')) AS m(model_id, type)""",
        "ids",
        "clean",
    ),
)
def q1(spark, d):
    models, versions = version_tables(spark, d)
    index = registry.date_index(derived.flight_ids(spark, d))
    one = views.metadata(models, versions, index)
    return one.select(
        "data_version", "last_trained", F.col("date_range.start").alias("first_date"),
        F.col("date_range.end").alias("last_date"), F.inline("models"),
    )


@query(
    "q2_density",
    build(
        f"""SELECT grid_lat AS lat, grid_lon AS lon, hour, round_even(density_score, 4) AS score, round_even(density_percentile, 1) AS percentile,
  data_version FROM density, {VERSION_SQL} v WHERE date = DATE '{DAY}' AND hour = 19""",
        "density",
        "ids",
    ),
)
def q2(spark, d):
    _, versions = version_tables(spark, d)
    return views.stamped(views.density(derived.density(spark, d), DAY, 19), versions)


def flat_forecasts(view):
    p, a = F.get("predicted", F.lit(0)), F.get("actual", F.lit(0))
    return view.select(
        "flight_id", "prediction_ts", "horizon_sec", rd(p["lat"]).alias("lat"), rd(p["lon"]).alias("lon"),
        a["ts"].alias("actual_ts"), rd(F.col("error.mae_lateral_nm")).alias("mae_lateral_nm"),
    )


FLAT_SQL = """flight_id, mid_ts AS prediction_ts, horizon_sec, round(plat, 6) AS lat, round(plon, 6) AS lon, actual_ts,
  round(err_lat, 6) AS mae_lateral_nm"""


@query(
    "q3_predictions",
    build(f"SELECT {FLAT_SQL} FROM pred WHERE contains(flight_id, '{DAY}') AND horizon_sec = 120 ORDER BY flight_id LIMIT 100", "pred"),
)
def q3(spark, d):
    return flat_forecasts(views.predictions(derived.predictions(spark, d), DAY, horizon=120))


@query(
    "t2_head_predictions",
    build(f"SELECT {FLAT_SQL} FROM pred ORDER BY flight_id, horizon_sec LIMIT 500", "pred"),
)
def t2(spark, d):
    return flat_forecasts(views.predictions(derived.predictions(spark, d), limit=500))


ANOM_COLS = """flight_id, anomaly_type AS type, round_even(anomaly_score, 3) AS score, 'unusual_' || feature AS primary_factor,
  round(z * 100, 4) AS deviation_pct, round(loc_lat, 6) AS lat, round(loc_lon, 6) AS lon, round(loc_alt, 4) AS alt_ft"""


def flat_anomalies(view):
    return view.select(
        "flight_id", "type", "score", "explanation.primary_factor", r("explanation.deviation_pct", 4),
        r("location.lat"), r("location.lon"), r("location.alt_ft", 4),
    )


@query(
    "q4_anomalies",
    build(f"SELECT {ANOM_COLS} FROM anom WHERE contains(flight_id, '{DAY}') AND anomaly_type = 'route' AND anomaly_score >= 0.8 ORDER BY anomaly_score DESC, flight_id LIMIT 100", "anom"),
)
def q4(spark, d):
    found = views.anomalies(derived.fixture_anomalies(spark, d), DAY, "route", 0.8)
    return flat_anomalies(found)


@query(
    "t3_top_anomalies",
    build(f"SELECT {ANOM_COLS} FROM anom ORDER BY anomaly_score DESC, flight_id LIMIT 50", "anom"),
)
def t3(spark, d):
    return flat_anomalies(views.anomalies(derived.fixture_anomalies(spark, d), limit=50))


@query(
    "t5_cards",
    build(
        """SELECT flight_id, anomaly_type AS type, round_even(anomaly_score, 3) * 100 AS score_pct,
  'Feature ''' || feature || ''' deviates significantly from normal patterns' AS context, round_even(z * 100, 1) AS deviation_pct
  FROM anom ORDER BY anomaly_score DESC, flight_id LIMIT 5""",
        "anom",
    ),
)
def t5_cards(spark, d):
    return views.anomaly_cards(derived.fixture_anomalies(spark, d))


STRESS_VIEW = "grid_lat AS lat, grid_lon AS lon, hour, round_even(stress_index, 2) AS stress_index, risk_level, round(density, 6) AS density_component"


@query(
    "q5_stress",
    build(f"SELECT {STRESS_VIEW} FROM stress WHERE date = DATE '{DAY}' AND hour = 19 AND stress_index >= 25", "stress"),
)
def q5(spark, d):
    view = views.stress(derived.stress_table(spark, d), DAY, 19, 25.0)
    return view.select("lat", "lon", "hour", "stress_index", "risk_level", r("components.density_component"))


@query(
    "s19_components",
    build(
        f"""SELECT date, hour, grid_lat, grid_lon, risk_level, round_even(density, 2) AS density, round_even(maneuver, 2) AS maneuver_variance,
  round_even(heading, 2) AS heading_conflict, 0.0::DOUBLE AS anomaly FROM stress
  UNION ALL SELECT date, hour, grid_lat, grid_lon, {risk(ESTIMATE)}, round_even(density_score, 2),
  round_even((round_even(least(1.0, density_score * 0.5::DOUBLE + 0.1::DOUBLE), 4) + 0.15::DOUBLE) / 2, 2),
  round_even(round_even(least(1.0, density_score * 0.3::DOUBLE + 0.15::DOUBLE), 4), 2), 0.0::DOUBLE FROM density""",
        "stress",
        "density",
    ),
)
def s19(spark, d):
    full = views.display_components(derived.stress_table(spark, d))
    return full.unionByName(views.display_components(stress.stress_estimate(derived.density(spark, d))))


@query(
    "q6_trajectories",
    build(
        f"""SELECT flight_id, ts, lat, lon FROM (SELECT *, dense_rank() OVER (ORDER BY flight_id) AS rank FROM
  (SELECT * FROM ({THIN_SQL}) WHERE (ts // 3600) % 24 = 19 QUALIFY count(*) OVER (PARTITION BY flight_id) >= 2)) WHERE rank <= 100""",
        "points",
    ),
)
def q6(spark, d):
    thin = sampling.thin_tracks(derived.flights(spark, d))
    shown = tracks.explode_points(views.trajectories(thin, 19, 100), "flight_id")
    return shown.select("flight_id", "ts", r("lat"), r("lon"))


@query(
    "t4_first_flights",
    build(
        """SELECT flight_id, count(*) AS n FROM celled WHERE hour = 20 GROUP BY flight_id HAVING count(*) >= 2 ORDER BY flight_id LIMIT 100""",
        "celled",
    ),
)
def t4(spark, d):
    shown = views.trajectories(derived.flights(spark, d), 20, 100)
    return shown.select("flight_id", F.size("points").cast("bigint").alias("n"))


@query("q7_prediction_quality", build(f"SELECT *, 2 AS model_version FROM ({AUDIT_SQL})", "pred"))
def q7(spark, d):
    errors = stage(derived.predictions(spark, d).select("error_metrics"), "errors")
    return views.prediction_quality(forecast.audit(errors), version_tables(spark, d)[1])


@query(
    "j7_anomaly_split",
    build(
        "SELECT i.flight_id, a.flight_id IS NOT NULL AS is_anomaly FROM ids i LEFT JOIN anom a ON i.flight_id = a.flight_id",
        "ids",
        "anom",
    ),
)
def j7(spark, d):
    return timetravel.split_by_anomaly(
        derived.flight_ids(spark, d).select("flight_id"), derived.fixture_anomalies(spark, d)
    )


QUOTA_SQL = """(SELECT flight_id, is_anomaly FROM (SELECT i.flight_id, a.flight_id IS NOT NULL AS is_anomaly FROM ids i LEFT JOIN anom a ON i.flight_id = a.flight_id)
  QUALIFY row_number() OVER (PARTITION BY is_anomaly ORDER BY flight_id) <= 50)"""


@query("t5_quota", build(f"SELECT flight_id, is_anomaly FROM {QUOTA_SQL}", "ids", "anom"))
def t5(spark, d):
    return timetravel.quota(j7(spark, d))


def position_sql(flights: str, t: str) -> str:
    """Position of each flight of ``flights`` at ``t``: bracket by as-of joins in both directions."""
    return f"""SELECT f.flight_id, f.is_anomaly,
  CASE WHEN b.ts < a.ts THEN b.lat + (a.lat - b.lat) * ((f.t - b.ts) / (a.ts - b.ts)) ELSE coalesce(b.lat, a.lat) END AS lat,
  CASE WHEN b.ts < a.ts THEN b.lon + (a.lon - b.lon) * ((f.t - b.ts) / (a.ts - b.ts)) ELSE coalesce(b.lon, a.lon) END AS lon,
  CASE WHEN b.ts < a.ts THEN {bearing('b.lat', 'b.lon', 'a.lat', 'a.lon')} ELSE coalesce(b.hdg, a.hdg) END AS heading_deg,
  (SELECT count(*) FROM points p WHERE p.flight_id = f.flight_id AND p.ts <= f.t AND p.ts > f.t - 300) AS trail_points
FROM (SELECT *, {t} AS t FROM {flights}) f ASOF LEFT JOIN points b ON f.flight_id = b.flight_id AND f.t >= b.ts
ASOF LEFT JOIN points a ON f.flight_id = a.flight_id AND f.t <= a.ts"""


@query(
    "s13_position_at",
    build(
        f"SELECT flight_id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(heading_deg, 4) AS heading_deg FROM ({position_sql('(SELECT flight_id, false AS is_anomaly FROM ids)', f'{T0}.0::DOUBLE')})",
        "ids",
        "points",
    ),
)
def s13(spark, d):
    at = timetravel.position_at(F.col("points"), F.lit(float(T0)))
    return derived.flights(spark, d).select("flight_id", at.alias("at")).select(
        "flight_id", r("at.lat"), r("at.lon"), r("at.heading_deg", 4)
    )


@query(
    "j9_brackets",
    build(
        f"""SELECT i.flight_id, (SELECT max(ts) FROM points p WHERE p.flight_id = i.flight_id AND ts <= {T0}) AS before_ts,
  (SELECT min(ts) FROM points p WHERE p.flight_id = i.flight_id AND ts >= {T0}) AS after_ts FROM ids i""",
        "ids",
        "points",
    ),
)
def j9(spark, d):
    before, after = timetravel.bracket(F.col("points"), F.lit(T0))
    return derived.flights(spark, d).select("flight_id", before["ts"].alias("before_ts"), after["ts"].alias("after_ts"))


SLIDER_SQL = "(SELECT min(ts) + 37.5 / 100.0 * (max(ts) - min(ts)) FROM points)::DOUBLE"


@query(
    "q8_planes_at",
    build(
        f"SELECT flight_id, is_anomaly, round(lat, 6) AS lat, round(lon, 6) AS lon, round(heading_deg, 4) AS heading_deg, trail_points FROM ({position_sql(QUOTA_SQL, SLIDER_SQL)})",
        "ids",
        "anom",
        "points",
    ),
)
def q8(spark, d):
    flights = stage(derived.flights(spark, d), "flights")
    shown = timetravel.planes_at(flights, derived.anomalies_of(flights), position=37.5)
    return shown.select(
        "flight_id", "is_anomaly", r("lat"), r("lon"), r("heading_deg", 4),
        F.size("trail").cast("bigint").alias("trail_points"),
    )


@query(
    "s14_slider_time",
    build(f"SELECT pos, (SELECT min(ts) + pos / 100.0 * (max(ts) - min(ts)) FROM points)::DOUBLE AS t FROM (VALUES (0.0::DOUBLE), (25.0::DOUBLE), (100.0::DOUBLE)) AS p(pos)", "points"),
)
def s14(spark, d):
    from vaportrail.functions.geo import slider_time

    span = sampling.time_range(derived.flights(spark, d))
    spread = span.withColumn("pos", F.explode(F.array(F.lit(0.0), F.lit(25.0), F.lit(100.0))))
    return spread.select("pos", slider_time(F.col("pos"), F.col("min_ts"), F.col("max_ts")).alias("t"))


LIVE_SQL = f"""SELECT e.flight_id, round(elat, 6) AS lat, round(elon, 6) AS lon, a.flight_id IS NOT NULL AS is_anomaly,
  CASE WHEN legs >= 2 AND last_alat IS NOT NULL THEN round({bearing('slat', 'slon', 'elat', 'elon')}, 4) ELSE 0.0 END::DOUBLE AS heading_deg,
  CASE WHEN a.flight_id IS NOT NULL THEN legs END AS predicted_points, CASE WHEN a.flight_id IS NOT NULL THEN n_actual END AS actual_points
FROM (SELECT flight_id, count(*) AS legs,
    first(coalesce(alat, plat) ORDER BY horizon_sec) AS slat, first(coalesce(alon, plon) ORDER BY horizon_sec) AS slon,
    last(coalesce(alat, plat) ORDER BY horizon_sec) AS elat, last(coalesce(alon, plon) ORDER BY horizon_sec) AS elon,
    last(alat ORDER BY horizon_sec) AS last_alat, count(alat) AS n_actual FROM pred GROUP BY flight_id ORDER BY flight_id LIMIT 1500) e LEFT JOIN (SELECT flight_id FROM anom WHERE anomaly_type = 'route') a ON e.flight_id = a.flight_id"""


@query("q9_live_planes", build(LIVE_SQL, "pred", "anom"))
def q9(spark, d):
    flights = stage(derived.flights(spark, d), "flights")
    shown = live.live_planes(forecast.forecast(flights), derived.anomalies_of(flights))
    return shown.select(
        "flight_id", r("lat"), r("lon"), "is_anomaly", rd("heading_deg", 4).alias("heading_deg"),
        F.size("predicted_path").cast("bigint").alias("predicted_points"),
        F.size("actual_path").cast("bigint").alias("actual_points"),
    )


@query(
    "j8_deviation",
    build(
        """SELECT p.flight_id, round(last(plat ORDER BY horizon_sec), 6) AS predicted_lat, round(last(alat ORDER BY horizon_sec), 6) AS actual_lat
  FROM pred p JOIN anom a ON p.flight_id = a.flight_id AND anomaly_type = 'route'
  GROUP BY p.flight_id HAVING count(alat) = 3""",
        "pred",
        "anom",
    ),
)
def j8(spark, d):
    """End points of the forecast and actual path of route anomalies that were tracked over all horizons; of all flights."""
    flights = stage(derived.flights(spark, d), "flights")
    shown = live.live_planes(forecast.forecast(flights), derived.anomalies_of(flights), limit=None)
    return shown.where(F.size("actual_path") == 3).select(
        "flight_id", rd("deviation.predicted_lat").alias("predicted_lat"), rd("deviation.actual_lat").alias("actual_lat")
    )


@query(
    "q10_planes_in_cell",
    build(
        f"SELECT grid_lat, grid_lon, count(*) AS planes FROM ({PLANES_SQL}) GROUP BY ALL",
        "grid",
        "points",
    ),
)
def q10(spark, d):
    return cell_planes(spark, d).groupBy(*grid.CELL).agg(F.count("*").alias("planes"))


@query(
    "q11_what_if",
    build(
        f"""SELECT 'density' AS view, grid_lat AS lat, grid_lon AS lon, hour, greatest(0.0, least(1.0, round_even(density_score, 4) * 1.2::DOUBLE)) AS value, NULL AS risk_level
  FROM density WHERE date = DATE '{DAY}'
  UNION ALL SELECT 'stress', grid_lat, grid_lon, hour, least(100.0, round_even(stress_index, 2) * 1.2::DOUBLE), {risk('least(100.0, round_even(stress_index, 2) * 1.2::DOUBLE)')} FROM stress WHERE date = DATE '{DAY}'""",
        "density",
        "stress",
    ),
)
def q11(spark, d):
    dens = views.what_if_density_view(views.density(derived.density(spark, d), DAY), 120.0)
    strs = views.what_if_stress_view(views.stress(derived.stress_table(spark, d), DAY), 120.0)
    keys = ["lat", "lon", "hour"]
    return dens.select(
        F.lit("density").alias("view"), *keys, F.col("score").alias("value"),
        F.lit(None).cast("string").alias("risk_level"),
    ).unionByName(strs.select(F.lit("stress").alias("view"), *keys, F.col("stress_index").alias("value"), "risk_level"))


@query(
    "q12_path_pairs",
    build(
        """SELECT flight_id, horizon_sec, round(plat, 6) AS predicted_end_lat, round(plon, 6) AS predicted_end_lon, round(alat, 6) AS actual_end_lat,
  round(alon, 6) AS actual_end_lon FROM (SELECT * FROM pred ORDER BY flight_id, horizon_sec LIMIT 200) WHERE actual_ts IS NOT NULL""",
        "pred",
    ),
)
def q12(spark, d):
    pairs = live.path_pairs(derived.predictions(spark, d))
    ends = [f"{side}_end_{f}" for side in ("predicted", "actual") for f in ("lat", "lon")]
    return pairs.select("flight_id", "horizon_sec", *[r(c) for c in ends])


@query("a12_mean_stress", build("SELECT floor(avg(round_even(stress_index, 2)) + 0.5)::BIGINT AS avg_stress FROM stress", "stress"))
def a12(spark, d):
    return views.mean_stress(views.stress(derived.stress_table(spark, d)))


@query(
    "a13_bounds",
    build(
        "SELECT min(grid_lat) AS min_lat, max(grid_lat) AS max_lat, min(grid_lon) AS min_lon, max(grid_lon) AS max_lon FROM density WHERE grid_lat <> 0 AND grid_lon <> 0",
        "density",
    ),
)
def a13(spark, d):
    return views.bounds(views.density(derived.density(spark, d)))
