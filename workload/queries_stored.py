"""Queries on stored layers: Silver with its time index and cell states, and Gold as published."""

from pyspark.sql import functions as F

from vaportrail.operators import cellstate, grid, playback, sampling, spatial, stress, timetravel, tracks
from vaportrail.plans import gold, silver, views
from vaportrail.session import new_stage_path
from vaportrail.sources import tables
from workload import derived
from workload.ctes import build
from workload.queries_gold import AUDIT_SQL, HOUR_SQL, THIN_SQL
from workload.queries_views import DAY, QUOTA_SQL, SLIDER_SQL, flat_forecasts, position_sql
from workload.registry import QUERIES, query
from workload.rounding import r

_BUILT: dict[tuple, str] = {}


def _once(kind, spark, d, make):
    """What several queries of a session read is built by the first of them."""
    key = (kind, spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        path = new_stage_path(spark, kind)
        make(path)
        _BUILT[key] = path
    return _BUILT[key]


def stored_silver(spark, d):
    """Built from two thirds of the reports; then the others arrive, and each date is built anew."""

    def make(path):
        source = new_stage_path(spark, "bronze")
        reports = derived.state_vectors(spark, d)
        late = F.xxhash64("icao24", "timestamp") % 3 == 0
        tables.append_bronze(reports.where(~late), source)
        silver.build_silver(spark, source, path)
        tables.append_bronze(reports.where(late), source)
        dates = [row["date"] for row in reports.select("date").distinct().orderBy("date").collect()]
        failed = {date: why for date, (_, _, why) in silver.build_dates(spark, source, path, dates).items() if why}
        if failed:
            raise RuntimeError(f"dates not built: {failed}")

    return _once("silver", spark, d, make)


def published_gold(spark, d):
    """One published run, as of the last report."""

    def make(path):
        now = F.lit(derived.reports(spark, d).agg(F.max("timestamp")).first()[0])
        gold.publish_gold(spark, stored_silver(spark, d), path, now=now)

    return _once("gold", spark, d, make)


@query("f11_stored_hour", build(HOUR_SQL, "celled"))
def f11(spark, d):
    cut = sampling.hour_tracks(tables.load_trajectories(spark, stored_silver(spark, d)), 19)
    return tracks.explode_points(cut, "flight_id").select("flight_id", "ts", r("lat"), r("lon"))


@query("a11_stored_range", build("SELECT min(ts) AS min_ts, max(ts) AS max_ts FROM points WHERE ts > 0", "points"))
def a11(spark, d):
    return sampling.time_range(tables.load_trajectories(spark, stored_silver(spark, d)))


@query(
    "q6_stored_tracks",
    build(
        f"""SELECT flight_id, ts, lat, lon FROM (SELECT *, dense_rank() OVER (ORDER BY flight_id) AS rank FROM
  (SELECT * FROM ({THIN_SQL}) WHERE (ts // 3600) % 24 = 19 QUALIFY count(*) OVER (PARTITION BY flight_id) >= 2)) WHERE rank <= 100""",
        "points",
    ),
)
def q6(spark, d):
    inside = tables.load_trajectories(spark, stored_silver(spark, d)).where(sampling.in_hour(19))
    shown = tracks.explode_points(views.trajectories(sampling.thin_tracks(inside), 19, 100), "flight_id")
    return shown.select("flight_id", "ts", r("lat"), r("lon"))


@query(
    "q8_stored_planes",
    build(
        f"SELECT flight_id, is_anomaly, round(lat, 6) AS lat, round(lon, 6) AS lon, round(heading_deg, 4) AS heading_deg, trail_points FROM ({position_sql(QUOTA_SQL, SLIDER_SQL)})",
        "ids",
        "anom",
        "points",
    ),
)
def q8(spark, d):
    flights = tables.load_trajectories(spark, stored_silver(spark, d))
    shown = timetravel.planes_at(flights, derived.anomalies_of(flights), position=37.5)
    return shown.select(
        "flight_id", "is_anomaly", r("lat"), r("lon"), r("heading_deg", 4), F.size("trail").cast("bigint").alias("trail_points")
    )


MOMENTS = 100
MOMENTS_SQL = f"""(SELECT (a + (b - a) * k // {MOMENTS - 1})::DOUBLE AS tick FROM (SELECT min(ts) AS a, max(ts) AS b FROM points), range({MOMENTS}) AS m(k))"""
ACTIVE_SQL = f"""(SELECT f.flight_id, false AS is_anomaly, tick FROM flights f JOIN {MOMENTS_SQL} m ON m.tick >= f.first_ts AND m.tick <= f.last_ts)"""


@query(
    "j9_playback",
    build(
        f"SELECT flight_id, t, round(lat, 6) AS lat, round(lon, 6) AS lon, round(heading_deg, 4) AS heading_deg FROM ({position_sql(ACTIVE_SQL, 'tick').replace('SELECT f.flight_id, f.is_anomaly,', 'SELECT f.flight_id, f.t,', 1)})",
        "flights",
        "points",
    ),
)
def j9(spark, d):
    """All flights under way at a hundred moments over the whole time of the data."""
    flights = tables.load_trajectories(spark, stored_silver(spark, d))
    step = F.col("min_ts") + F.floor((F.col("max_ts") - F.col("min_ts")) * F.col("k") / (MOMENTS - 1))
    numbers = sampling.time_range(flights).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(MOMENTS - 1))))
    shown = playback.playback(flights, numbers.select(step.alias("t")))
    return shown.select("flight_id", "t", r("lat"), r("lon"), r("heading_deg", 4))


def ordered_points(spark, d):
    path = stored_silver(spark, d)
    _once("ordered", spark, d, lambda _: silver.build_ordered_points(spark, path))
    return tables.load_ordered_points(spark, path)


@query("j6_stored_planes", QUERIES["j6_planes_in_cell"][1])
def j6(spark, d):
    cells = tables.load_grid(spark, stored_silver(spark, d))
    found = grid.planes_in_cells(ordered_points(spark, d), cells)
    return found.select(*grid.CELL, "flight_id", r("alt_ft", 4))


@query("q10_stored_planes", QUERIES["q10_planes_in_cell"][1])
def q10(spark, d):
    cells = tables.load_grid(spark, stored_silver(spark, d))
    return grid.planes_in_cells(ordered_points(spark, d), cells).groupBy(*grid.CELL).agg(F.count("*").alias("planes"))


BOX = (33.0, 34.5, -96.0, -92.5)


@query(
    "j6_planes_in_box",
    build(
        f"""SELECT flight_id, round(first(alt ORDER BY ts), 4) AS alt_ft FROM points
  WHERE lat BETWEEN {BOX[0]}::DOUBLE AND {BOX[1]}::DOUBLE AND lon BETWEEN {BOX[2]}::DOUBLE AND {BOX[3]}::DOUBLE GROUP BY flight_id""",
        "points",
    ),
)
def j6_box(spark, d):
    return spatial.planes_in_box(ordered_points(spark, d), *BOX).select("flight_id", r("alt_ft", 4))


def states(spark, d):
    return tables.load_states(spark, stored_silver(spark, d))


@query("a2_merged_history", QUERIES["a2_cell_stats"][1])
def a2(spark, d):
    h = grid.with_centre(cellstate.cell_history(states(spark, d)[1]))
    return h.select(*grid.CELL, r("mean_flights"), r("std_flights"), "max_flights", r("mean_points"), r("std_points"))


@query("a3_merged_density", QUERIES["a3_traffic_density"][1])
def a3(spark, d):
    cells = tables.load_grid(spark, stored_silver(spark, d))
    density = cellstate.traffic_density(cells, states(spark, d)[1])
    return density.select(
        "date", F.col("hour").cast("int").alias("hour"), *grid.CELL, r("density_score"), r("density_percentile"), "yoy_change_pct"
    )


@query("a4_merged_dispersion", QUERIES["a4_dispersion"][1])
def a4(spark, d):
    spread = grid.with_centre(cellstate.cell_dispersion(states(spark, d)[0]))
    return spread.select(*grid.CELL, F.col("hour").cast("int").alias("hour"), r("alt_std", 5), r("heading_std", 5), r("speed_std", 5))


@query("a5_merged_stress", QUERIES["a5_stress"][1])
def a5(spark, d):
    cells = tables.load_grid(spark, stored_silver(spark, d))
    index = stress.stress_index(cells, None, dispersion=cellstate.cell_dispersion(states(spark, d)[0]))
    return index.select(
        "date", F.col("hour").cast("int").alias("hour"), *grid.CELL, r("stress_index"), "risk_level", r("components.density_component"),
        r("components.maneuver_variance_component"), r("components.heading_conflict_component"), "components.anomaly_component",
    )


def artifact(spark, d, name):
    return gold.load_artifact(spark, gold.current(spark, published_gold(spark, d)), name)


def versions(spark, d):
    return gold.published(spark, published_gold(spark, d))


@query("q1_published", QUERIES["q1_metadata"][1].replace("--002", "--001"))
def q1(spark, d):
    folder = gold.current(spark, published_gold(spark, d))
    models = tables.read_table(spark, f"{folder}/metadata/models", gold.schemas.MODEL)
    one = views.metadata(models, versions(spark, d), spark.read.parquet(f"{folder}/metadata/date_index"))
    return one.select(
        "data_version", "last_trained", F.col("date_range.start").alias("first_date"),
        F.col("date_range.end").alias("last_date"), F.inline("models"),
    )


@query("q2_published", QUERIES["q2_density"][1].replace("--002", "--001"))
def q2(spark, d):
    return views.stamped(views.density(artifact(spark, d, "traffic_density"), DAY, 19), versions(spark, d))


@query("q3_published", QUERIES["q3_predictions"][1])
def q3(spark, d):
    return flat_forecasts(views.predictions(artifact(spark, d, "predictions"), DAY, horizon=120))


@query("q5_published", QUERIES["q5_stress"][1])
def q5(spark, d):
    view = views.stress(artifact(spark, d, "airspace_stress"), DAY, 19, 25.0)
    return view.select("lat", "lon", "hour", "stress_index", "risk_level", r("components.density_component"))


@query("q7_published", build(f"SELECT *, 1 AS model_version FROM ({AUDIT_SQL})", "pred"))
def q7(spark, d):
    folder = gold.current(spark, published_gold(spark, d))
    audit = spark.read.parquet(f"{folder}/metadata/audit").drop("date", "computed_at")
    return views.prediction_quality(audit, versions(spark, d))


@query(
    "b16_published_contents",
    build(
        f"""SELECT 'density' AS artifact, count(*) AS n, round(sum(density_score), 4) AS total FROM density
  UNION ALL SELECT 'stress', count(*), round(sum(stress_index), 4) FROM stress
  UNION ALL SELECT 'predictions', count(*), round(sum(err_lat), 4) FROM pred
  UNION ALL SELECT 'flights_sampled_of', count(*), NULL FROM flights""",
        "density",
        "stress",
        "pred",
        "flights",
    ),
)
def b16(spark, d):
    """Contents of the published tables, by sums over all rows, and the flights they come from."""
    total = lambda df, name, c: df.agg(F.lit(name).alias("artifact"), F.count("*").alias("n"), F.sum(c).alias("total"))
    sums = total(artifact(spark, d, "traffic_density"), "density", "density_score")
    sums = sums.unionByName(total(artifact(spark, d, "airspace_stress"), "stress", "stress_index"))
    sums = sums.unionByName(total(artifact(spark, d, "predictions"), "predictions", "error_metrics.mae_lateral_nm"))
    sums = sums.select("artifact", "n", r("total", 4))
    flights = tables.load_trajectories(spark, stored_silver(spark, d))
    return sums.unionByName(
        flights.agg(F.lit("flights_sampled_of").alias("artifact"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total"))
    )
