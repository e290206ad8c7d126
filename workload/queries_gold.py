"""Density percentiles, forecasts, stress, outliers, registry, sampling."""

from pyspark.sql import functions as F

from vaportrail import defaults
from vaportrail.functions import geo, labels, text
from vaportrail.operators import anomaly, forecast, grid, registry, sampling, stress, timetravel, tracks
from vaportrail.session import stage
from workload import derived
from workload.ctes import build, risk
from workload.registry import query
from workload.rounding import r, rd


PRED_COLS = (
    "flight_id, date, mid_ts AS prediction_ts, horizon_sec, target_ts, round(plat, 6) AS lat, round(plon, 6) AS lon, "
    "round(palt, 4) AS alt_ft, round(conf, 6) AS confidence, actual_ts, round(alat, 6) AS actual_lat, "
    "round(alon, 6) AS actual_lon, round(aalt, 4) AS actual_alt_ft, round(err_lat, 6) AS mae_lateral_nm, "
    "round(err_alt, 4) AS mae_vertical_ft"
)


def flat_predictions(pred):
    guess, actual = F.get("predicted_points", F.lit(0)), F.get("actual_points", F.lit(0))
    return pred.select(
        "flight_id", "date", "prediction_ts", "horizon_sec", guess["ts"].alias("target_ts"),
        rd(guess["lat"], 6).alias("lat"), rd(guess["lon"], 6).alias("lon"),
        rd(guess["alt_ft"], 4).alias("alt_ft"), rd(guess["confidence"], 6).alias("confidence"),
        actual["ts"].alias("actual_ts"), rd(actual["lat"], 6).alias("actual_lat"),
        rd(actual["lon"], 6).alias("actual_lon"), rd(actual["alt_ft"], 4).alias("actual_alt_ft"),
        r("error_metrics.mae_lateral_nm"), r("error_metrics.mae_vertical_ft", 4),
    )


@query("m7_forecast", build(f"SELECT {PRED_COLS} FROM pred", "pred"))
def m7(spark, d):
    return flat_predictions(derived.predictions(spark, d))


@query(
    "s5_dead_reckoning",
    build(
        """SELECT icao24, ts AS timestamp,
  round(lat + coalesce(spd, 0) * 1.852::DOUBLE * 60 / 399600.0 * cos(radians(coalesce(hdg, 0))), 6) AS lat,
  round(lon + coalesce(spd, 0) * 1.852::DOUBLE * 60 / 399600.0 * sin(radians(coalesce(hdg, 0))) / greatest(cos(radians(lat)), 0.001), 6) AS lon,
  round(coalesce(alt, 0) + coalesce(vr, 0), 4) AS alt_ft, 0.9::DOUBLE AS confidence FROM clean""",
        "clean",
    ),
)
def s5(spark, d):
    c = [F.col(x) for x in ("latitude", "longitude", "altitude", "velocity", "heading", "vertical_rate")]
    at = geo.dead_reckon(*c, F.lit(60))
    return derived.reports(spark, d).select(
        "icao24", "timestamp", rd(at["lat"], 6).alias("lat"), rd(at["lon"], 6).alias("lon"),
        rd(at["alt_ft"], 4).alias("alt_ft"), at["confidence"].alias("confidence"),
    )


@query(
    "j4_asof_actual",
    build("SELECT flight_id, horizon_sec, target_ts, actual_ts FROM pred", "pred"),
)
def j4(spark, d):
    mid = derived.flights(spark, d).where(F.size("points") >= 10)
    mid = mid.withColumn("horizon_sec", F.explode(F.array(*[F.lit(h) for h in (60, 120, 300)])))
    target = forecast.midpoint(F.col("points"))["ts"] + F.col("horizon_sec")
    hit = forecast.first_at_or_after(F.col("points"), F.col("target_ts"))
    return mid.withColumn("target_ts", target).select(
        "flight_id", "horizon_sec", "target_ts", hit["ts"].alias("actual_ts")
    )


@query(
    "w6_midpoints",
    build("SELECT flight_id, ts, round(lat, 6) AS lat, round(lon, 6) AS lon, round(coalesce(alt, 0), 4) AS alt_ft FROM mids", "mids"),
)
def w6(spark, d):
    mid = forecast.midpoint(F.col("points"))
    return derived.flights(spark, d).select(
        "flight_id", mid["ts"].alias("ts"), rd(mid["lat"], 6).alias("lat"), rd(mid["lon"], 6).alias("lon"),
        rd(geo.zero_if_missing(mid["alt_ft"]), 4).alias("alt_ft"),
    )


AUDIT_SQL = """SELECT count(err_lat) AS sample_count, round_even(avg(err_lat), 3) AS mean_lateral_error_nm,
  round_even(quantile_cont(err_lat, 0.5), 3) AS p50_lateral_error_nm, round_even(quantile_cont(err_lat, 0.9), 3) AS p90_lateral_error_nm,
  CASE WHEN avg(err_lat) < 0.5 THEN 'High' WHEN avg(err_lat) < 2 THEN 'Medium' ELSE 'Low' END AS confidence_label
FROM pred"""


@query("a8_audit", build(AUDIT_SQL, "pred"))
def a8(spark, d):
    pred = derived.predictions(spark, d).select("error_metrics")
    return forecast.audit(stage(pred, "errors"))


@query("a8_audit_by_horizon", build(AUDIT_SQL.replace("SELECT", "SELECT horizon_sec,", 1) + " GROUP BY horizon_sec", "pred"))
def a8_by_horizon(spark, d):
    pred = derived.predictions(spark, d).select("horizon_sec", "error_metrics")
    return forecast.audit(stage(pred, "errors"), ("horizon_sec",))


@query(
    "a2_cell_stats",
    build(
        "SELECT grid_lat, grid_lon, round(mean_flights, 6) AS mean_flights, round(std_flights, 6) AS std_flights, max_flights, "
        "round(mean_points, 6) AS mean_points, round(std_points, 6) AS std_points FROM cell_stats",
        "cell_stats",
    ),
)
def a2(spark, d):
    h = grid.cell_history(derived.grid_density(spark, d))
    return h.select(
        *grid.CELL, r("mean_flights"), r("std_flights"), "max_flights", r("mean_points"), r("std_points")
    )


@query(
    "a3_traffic_density",
    build(
        "SELECT date, hour, grid_lat, grid_lon, round(density_score, 6) AS density_score, round(density_percentile, 6) AS density_percentile, "
        "NULL::DOUBLE AS yoy_change_pct FROM density",
        "density",
    ),
)
def a3(spark, d):
    return derived.density(spark, d).select(
        *grid.CELL_HOUR, r("density_score"), r("density_percentile"), "yoy_change_pct"
    )


@query(
    "j1_density_with_stats",
    build(
        """SELECT date, hour, g.grid_lat, g.grid_lon, flight_count, round(mean_flights, 6) AS mean_flights, max_flights
  FROM grid g JOIN cell_stats s ON g.grid_lat = s.grid_lat AND g.grid_lon = s.grid_lon""",
        "grid",
        "cell_stats",
    ),
)
def j1(spark, d):
    cells = derived.grid_density(spark, d)
    return cells.join(grid.cell_history(cells), grid.CELL).select(
        *grid.CELL_HOUR, "flight_count", r("mean_flights"), "max_flights"
    )


@query(
    "a4_dispersion",
    build(
        "SELECT grid_lat, grid_lon, hour, round(alt_std, 5) AS alt_std, round(heading_std, 5) AS heading_std, round(speed_std, 5) AS speed_std FROM dispersion",
        "dispersion",
    ),
)
def a4(spark, d):
    return grid.with_centre(grid.cell_dispersion(derived.points(spark, d))).select(
        *grid.CELL, "hour", r("alt_std", 5), r("heading_std", 5), r("speed_std", 5)
    )


@query(
    "a5_stress",
    build(
        "SELECT date, hour, grid_lat, grid_lon, round(stress_index, 6) AS stress_index, risk_level, round(density, 6) AS density_component, "
        "round(maneuver, 6) AS maneuver_variance_component, round(heading, 6) AS heading_conflict_component, 0.0::DOUBLE AS anomaly_component FROM stress",
        "stress",
    ),
)
def a5(spark, d):
    return derived.stress_table(spark, d).select(
        *grid.CELL_HOUR, r("stress_index"), "risk_level", r("components.density_component"),
        r("components.maneuver_variance_component"), r("components.heading_conflict_component"),
        "components.anomaly_component",
    )


ESTIMATE = (
    "density_score * 40 + least(1.0, density_score * 0.5::DOUBLE + 0.1::DOUBLE) * 20 "
    "+ least(1.0, density_score * 0.3::DOUBLE + 0.15::DOUBLE) * 25 + 0.15::DOUBLE * 15"
)


@query(
    "a6_stress_estimate",
    build(
        f"""SELECT date, hour, grid_lat, grid_lon, round_even({ESTIMATE}, 2) AS stress_index, {risk(ESTIMATE)} AS risk_level,
  round_even(least(1.0, density_score * 0.5::DOUBLE + 0.1::DOUBLE), 4) AS altitude_variance FROM density""",
        "density",
    ),
)
def a6(spark, d):
    return stress.stress_estimate(derived.density(spark, d)).select(
        *grid.CELL_HOUR, "stress_index", "risk_level", "components.altitude_variance"
    )


@query(
    "j2_density_per_cell_hour",
    build(
        """SELECT p.grid_lat, p.grid_lon, p.hour, round(avg(g.flight_count), 6) AS mean_flights, count(g.flight_count) AS n
  FROM (SELECT DISTINCT grid_lat, grid_lon, hour FROM celled) p LEFT JOIN grid g USING (grid_lat, grid_lon, hour) GROUP BY ALL""",
        "celled",
        "grid",
    ),
)
def j2(spark, d):
    pts = derived.points(spark, d)
    key = [*grid.INDEX, "hour"]
    cells = grid.cell_dispersion(pts).join(stress.hourly_flights(grid.grid_density(pts)), key, "left")
    return grid.with_centre(cells).select(*grid.CELL, "hour", r("mean_flights"), F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "j3_share_of_busiest",
    build("SELECT date, hour, grid_lat, grid_lon, flight_count / (SELECT max(flight_count) FROM grid) AS share FROM grid", "grid"),
)
def j3(spark, d):
    cells = derived.grid_density(spark, d)
    return cells.select(*grid.CELL_HOUR, (F.col("flight_count") / stress.busiest(cells)).alias("share"))


CELLS_SQL = "(SELECT DISTINCT grid_lat, grid_lon FROM grid)"
PLANES_SQL = f"""SELECT c.grid_lat, c.grid_lon, p.flight_id, round(first(p.alt ORDER BY p.ts), 4) AS alt_ft FROM {CELLS_SQL} c JOIN points p
  ON p.lat BETWEEN c.grid_lat - 0.25 AND c.grid_lat + 0.25 AND p.lon BETWEEN c.grid_lon - 0.25 AND c.grid_lon + 0.25 GROUP BY ALL"""


@query("j6_planes_in_cell", build(PLANES_SQL, "grid", "points"))
def j6(spark, d):
    found = tracks.with_flight_ids(cell_planes(spark, d))
    return found.select(*grid.CELL, "flight_id", r("alt_ft", 4))


def cell_planes(spark, d):
    pts = tracks.build_points(derived.reports(spark, d))
    return grid.planes_in_cells(pts, derived.grid_density(spark, d), ["date", "icao24", "flight_no"])


@query(
    "j5_flights_by_horizon",
    build("SELECT horizon_sec, count(*) AS n, round(min(conf), 6) AS confidence FROM pred GROUP BY horizon_sec", "pred"),
)
def j5(spark, d):
    conf = F.get("predicted_points", F.lit(0))["confidence"]
    return derived.predictions(spark, d).groupBy("horizon_sec").agg(
        F.count("*").alias("n"), rd(F.min(conf), 6).alias("confidence")
    )


@query(
    "s15_what_if",
    build(
        f"""SELECT d.date, d.hour, d.grid_lat, d.grid_lon, round(greatest(0.0, least(1.0, density_score * 1.5)), 6) AS score,
  round(least(100.0, stress_index * 1.5), 6) AS stress_index, {risk('least(100.0, stress_index * 1.5)')} AS risk_level
  FROM density d JOIN stress s USING (date, hour, grid_lat, grid_lon)""",
        "density",
        "stress",
    ),
)
def s15(spark, d):
    scaled = labels.what_if_stress(F.col("stress_index"), 150.0)
    both = derived.density(spark, d).join(derived.stress_table(spark, d), grid.CELL_HOUR)
    return both.select(
        *grid.CELL_HOUR, rd(labels.what_if_density(F.col("density_score"), 150.0), 6).alias("score"),
        rd(scaled, 6).alias("stress_index"), labels.risk_level(scaled).alias("risk_level"),
    )


@query("m1_scaler", build("SELECT feature, round(mean, 5) AS mean, round(scale, 5) AS scale FROM scaler", "scaler"))
def m1(spark, d):
    features = anomaly.flight_features(derived.flights(spark, d))
    return anomaly.scaler(features).select("feature", r("mean", 5), r("scale", 5))


@query(
    "m4_explain",
    build(
        """SELECT flight_id, anomaly_type, 'unusual_' || feature AS primary_factor, round(z * 100, 4) AS deviation_pct, 0.0::DOUBLE AS baseline_value,
  round(observed, 5) AS observed_value, 'Feature ''' || feature || ''' deviates significantly from normal patterns' AS context FROM explained""",
        "explained",
    ),
)
def m4(spark, d):
    features = stage(anomaly.flight_features(derived.flights(spark, d)), "features")
    stats = anomaly.scaler_columns(anomaly.scaler(features))
    return anomaly.with_explanation(features, stats).select(
        "flight_id", "anomaly_type", "explanation.primary_factor", r("explanation.deviation_pct", 4),
        "explanation.baseline_value", r("explanation.observed_value", 5), "explanation.context",
    )


@query("m2_m3_anomalies")
def m2_m3(spark, d):
    """Forest scores of every flight (no SQL: the trees are random)."""
    features = stage(anomaly.flight_features(derived.flights(spark, d)), "features")
    detector = anomaly.fit_detector(features)
    if detector is None:
        return features.limit(0).select("flight_id", F.lit(0.0).alias("anomaly_score"), F.lit("").alias("anomaly_type"))
    return detector.score(features).select("flight_id", "anomaly_score", "anomaly_type")


@query("m5_emit_anomalies")
def m5(spark, d):
    features = stage(anomaly.flight_features(derived.flights(spark, d)), "features")
    detector = anomaly.fit_detector(features)
    if detector is None:
        return derived.anomalies_of(stage(derived.flights(spark, d), "flights")).limit(0)
    # 0.5 is the forest's own decision boundary
    return anomaly.to_anomalies(detector.score(features), threshold=0.5)


@query("m6_model_round_trip")
def m6(spark, d):
    """Scores by a model that was saved and loaded again."""
    from vaportrail.session import new_stage_path

    features = stage(anomaly.flight_features(derived.flights(spark, d)), "features")
    detector = anomaly.fit_detector(features)
    if detector is None:
        return features.limit(0).select("flight_id", F.lit(0.0).alias("anomaly_score"))
    path = new_stage_path(spark, "model")
    detector.save(path)
    return anomaly.Detector.load(spark, path).score(features).select("flight_id", "anomaly_score")


@query(
    "m2_m3_invariants",
    build(
        """SELECT count(*) AS scored, 0::BIGINT AS outside, 100::BIGINT AS trees, 0::BIGINT AS odd_samples, true AS share_holds
  FROM ids HAVING count(*) >= 100""",
        "ids",
    ),
)
def m2_m3_invariants(spark, d):
    """What holds for any forest: scores of all flights in 0..1, full samples in every tree, one in twenty flagged."""
    features = stage(anomaly.flight_features(derived.flights(spark, d)), "features")
    detector = anomaly.fit_detector(features)
    if detector is None:
        return spark.createDataFrame([], "scored long, outside long, trees long, odd_samples long, share_holds boolean")
    score, size = F.col("anomaly_score"), detector.meta.first()["subsample"]
    scored = detector.score(features).agg(
        F.count("*").alias("scored"), F.count_if(~score.between(0, 1)).alias("outside"), F.count_if(score > 0.5).alias("flagged")
    )
    roots = detector.nodes.where("node = 0").agg(
        F.countDistinct("tree").alias("trees"), F.count_if(F.col("size") != size).alias("odd_samples")
    )
    share = F.abs(F.col("flagged") - F.col("scored") * 0.05) <= 1
    return scored.join(roots, F.lit(True)).select("scored", "outside", "trees", "odd_samples", share.alias("share_holds"))


@query(
    "m5_planted_outliers",
    build(
        """SELECT count(*) + 10 AS scored, 10::BIGINT AS planted_on_top, 10::BIGINT AS planted_emitted, 0::BIGINT AS emitted_below
  FROM ids HAVING count(*) >= 100""",
        "ids",
    ),
)
def m5_planted(spark, d):
    """Ten impossible flights among the others: scored highest and emitted at the default threshold."""
    features = stage(anomaly.flight_features(derived.flights(spark, d)), "features")
    planted = features.orderBy("flight_id").limit(10).withColumns(
        {
            "flight_id": F.concat(F.lit("planted_"), "flight_id"),
            **{f: (F.col(f) * 40 + 9_000).cast(features.schema[f].dataType) for f in anomaly.FEATURES},
        }
    )
    both = stage(features.unionByName(planted), "planted")
    detector = anomaly.fit_detector(both)
    if detector is None:
        return spark.createDataFrame([], "scored long, planted_on_top long, planted_emitted long, emitted_below long")
    scored = stage(detector.score_trained(), "scored")
    is_planted = F.col("flight_id").startswith("planted_")
    top = scored.orderBy(F.desc("anomaly_score"), "flight_id").limit(10).agg(F.count_if(is_planted).alias("planted_on_top"))
    emitted = anomaly.to_anomalies(scored).agg(
        F.count_if(is_planted).alias("planted_emitted"), F.count_if(F.col("anomaly_score") < 0.7).alias("emitted_below")
    )
    return scored.agg(F.count("*").alias("scored")).join(top, F.lit(True)).join(emitted, F.lit(True))


@query(
    "m6_saved_twice",
    build(
        "SELECT count(*) AS scored, 0::BIGINT AS changed, 2::BIGINT AS versions FROM ids HAVING count(*) >= 100",
        "ids",
    ),
)
def m6_saved_twice(spark, d):
    """A model saved twice, next to another version, scores as before it was saved."""
    from vaportrail.session import new_stage_path

    features = stage(anomaly.flight_features(derived.flights(spark, d)), "features")
    detector = anomaly.fit_detector(features)
    if detector is None:
        return spark.createDataFrame([], "scored long, changed long, versions long")
    path = new_stage_path(spark, "model")
    anomaly.fit_detector(features, trees=3, version="1.0.1").save(path)
    for _ in range(2):
        detector.save(path)
    before = detector.score_trained().select("flight_id", F.col("anomaly_score").alias("before"))
    after = anomaly.Detector.load(spark, path).score(features).select("flight_id", "anomaly_score")
    versions = spark.read.parquet(f"{path}/meta").agg(F.count("*").alias("versions"))
    compared = before.join(after, "flight_id").agg(
        F.count("*").alias("scored"), F.count_if(F.col("before") != F.col("anomaly_score")).alias("changed")
    )
    return compared.join(versions, F.lit(True))


@query(
    "a9_date_index",
    build(
        "SELECT list_sort(list(DISTINCT date::VARCHAR)) AS available_dates, min(date)::VARCHAR AS first_date, max(date)::VARCHAR AS last_date FROM pred",
        "pred",
    ),
)
def a9(spark, d):
    return registry.date_index(derived.predictions(spark, d))


@query(
    "a10_window",
    build(
        """SELECT greatest(max(date) - 2, min(date)) AS training_start, max(date) AS training_end,
  (max(date) - greatest(max(date) - 2, min(date)) + 1)::INT AS training_days FROM ids""",
        "ids",
    ),
)
def a10(spark, d):
    return registry.training_window(derived.segmented(spark, d), days=3)


@query(
    "a15_registry",
    build(
        """SELECT model_id, model_type, '1.0.0' AS version, (SELECT max(ts) FROM clean) AS trained_at, (SELECT min(date) FROM ids) AS training_window_start,
  (SELECT max(date) FROM ids) AS training_window_end, (SELECT max(date) - min(date) + 1 FROM ids)::INT AS training_days,
  NULL::DOUBLE AS validation_mae, NULL::DOUBLE AS validation_rmse, auc::DOUBLE AS auc_roc
  FROM (VALUES ('traj_pred_001', 'trajectory', NULL), ('anomaly_001', 'anomaly', 0.85)) AS m(model_id, model_type, auc)""",
        "clean",
        "ids",
    ),
)
def a15(spark, d):
    window = registry.training_window(derived.segmented(spark, d))
    trained = derived.reports(spark, d).agg(F.max("timestamp")).scalar()
    return registry.model_metadata(window, trained)


@query(
    "a15_versions",
    build(
        """SELECT 'v' || strftime(max(date), '%Y%m%d') || '--' || printf('%03d', v.n) AS data_version, v.n AS model_version, min(date) AS training_start,
  max(date) AS training_end, (SELECT max(ts) FROM clean) AS last_trained FROM ids, (VALUES (1), (2)) AS v(n) GROUP BY v.n""",
        "clean",
        "ids",
    ),
)
def a15_versions(spark, d):
    window = registry.training_window(derived.segmented(spark, d))
    trained = derived.reports(spark, d).agg(F.max("timestamp")).scalar()
    models = stage(registry.model_metadata(window, trained), "models")
    run_date = models.agg(F.max("training_window_end")).scalar()
    stamp = models.agg(F.max("trained_at")).scalar()
    first = stage(registry.next_version(models, None, run_date, stamp), "version")
    return first.unionByName(registry.next_version(models, first, run_date, stamp)).drop("models")


W7_SQL = "(SELECT flight_id FROM (SELECT flight_id, row_number() OVER (ORDER BY flight_id) - 1 AS n, count(*) OVER () AS total FROM ids) WHERE n % greatest(1, total // 200) = 0)"


@query("w7_sample_flights", build(f"SELECT flight_id FROM {W7_SQL}", "ids"))
def w7(spark, d):
    return sampling.sample_flights(stage(derived.flight_ids(spark, d).select("flight_id"), "ids"))


THIN_SQL = """SELECT flight_id, ts, round(lat, 6) AS lat, round(lon, 6) AS lon, round(coalesce(alt, 0), 4) AS alt_ft FROM (
  SELECT *, count(*) OVER (PARTITION BY flight_id) AS kept FROM (
    SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY flight_id) AS n FROM points)
  WHERE n >= 5 AND (i % 20 = 0 OR i = n - 1)) WHERE kept >= 3"""


@query("w8_thin_points", build(THIN_SQL, "points"))
def w8(spark, d):
    thin = tracks.explode_points(sampling.thin_tracks(derived.flights(spark, d)), "flight_id")
    return thin.select("flight_id", "ts", r("lat"), r("lon"), r("alt_ft", 4))


HOUR_SQL = """SELECT flight_id, ts, round(lat, 6) AS lat, round(lon, 6) AS lon FROM celled WHERE hour = 19
  QUALIFY count(*) OVER (PARTITION BY flight_id) >= 2"""


@query("f11_hour_points", build(HOUR_SQL, "celled"))
def f11(spark, d):
    cut = tracks.explode_points(sampling.hour_tracks(derived.flights(spark, d), 19), "flight_id")
    return cut.select("flight_id", "ts", r("lat"), r("lon"))


@query(
    "f12_minimum_sizes",
    build(
        "SELECT count(*) FILTER (n_points >= 2) AS two, count(*) FILTER (n_points >= 10) AS ten, count(*) FILTER (n_points >= 5) AS five FROM flights",
        "flights",
    ),
)
def f12(spark, d):
    long_enough = lambda n: F.count_if(labels.at_least(F.col("points"), n))
    return derived.flights(spark, d).agg(
        long_enough(2).alias("two"), long_enough(defaults.MIN_FORECAST_POINTS).alias("ten"), long_enough(5).alias("five")
    )


@query(
    "f14_trail",
    build(
        "SELECT flight_id, ts FROM points WHERE ts <= 1766689200 AND ts > 1766689200 - 300",
        "points",
    ),
)
def f14(spark, d):
    tail = timetravel.trail(F.col("points"), F.lit(1766689200))
    return derived.flights(spark, d).select("flight_id", F.explode(tail).alias("p")).select("flight_id", "p.ts")


@query("a11_time_range", build("SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM points WHERE ts > 0", "points"))
def a11(spark, d):
    return sampling.time_range(derived.flights(spark, d))


@query(
    "s11_flight_id_parts",
    build("SELECT flight_id, date::VARCHAR AS day, icao24 || '_' || date::VARCHAR AS stem FROM ids", "ids"),
)
def s11(spark, d):
    ids = derived.flight_ids(spark, d)
    return ids.select(
        "flight_id", text.flight_date_text(F.col("flight_id")).alias("day"),
        F.regexp_replace("flight_id", r"_\d+$", "").alias("stem"),
    )
