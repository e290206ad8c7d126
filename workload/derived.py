"""Flight tables derived from the ``events`` table: the inputs of the registered queries.

The modulo terms shape values (missing positions, out-of-range altitudes, repeated reports); no row is left out.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaportrail.functions.geo import epoch_date
from vaportrail.operators import anomaly, clean, forecast, grid, stress, tracks
from vaportrail.schemas import BRONZE, conform
from vaportrail.session import stage

EPOCH0 = 1766685600  # 2025-12-25 18:00 UTC


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State vectors before typing: numbers still numbers, ``on_ground`` still text, every 50th report sent twice."""
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")
    eid, plane = F.col("event_id"), F.col("user_id") % 40
    once = F.struct(F.lit("a").alias("src"), F.lit(0.0).alias("bump"))
    again = F.struct(F.lit("b").alias("src"), F.lit(1.0).alias("bump"))
    e = e.withColumn("c", F.explode(F.when(eid % 50 == 0, F.array(once, again)).otherwise(F.array(once))))
    ground = (
        F.when(eid % 7 == 0, "true").when(eid % 7 == 1, "F").when(eid % 7 == 2, "1.0").otherwise("false")
    )
    return e.select(
        F.concat(F.lit("ac"), (plane + 1000).cast("string")).alias("icao24"),
        F.concat(F.upper("event_type"), plane.cast("string")).alias("callsign"),
        (eid * 4 + EPOCH0).alias("timestamp"),
        F.when(eid % 89 == 0, None)
        .when(eid % 97 == 0, 95.0)
        .otherwise(F.lit(30.0137) + plane * 0.25 + (eid % 1000) * 0.001)
        .alias("latitude"),
        (F.lit(-100.0091) + plane * 0.5 + (eid % 2000) * 0.002).alias("longitude"),
        (
            F.when(F.col("event_type") == "error", None).when(eid % 211 == 0, 99999.0).otherwise(F.col("value") * 100.0)
            + F.col("c.bump")
        ).alias("altitude"),
        F.when(eid % 53 == 0, None).when(eid % 223 == 0, 900.0).otherwise(F.col("value") + 100.0).alias("velocity"),
        ((eid * 37) % 360).cast("double").alias("heading"),
        ((eid % 5 - 2) * 800).cast("double").alias("vertical_rate"),
        ground.alias("on_ground"),
        F.when(eid % 3 == 0, None).otherwise(F.format_string("%04d", eid % 7777)).alias("squawk"),
        F.col("c.src").alias("_source_file"),
    )


def state_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze table."""
    from vaportrail.functions.text import to_flag

    raw = raw_reports(spark, sf_dir)
    return conform(
        raw.withColumns(
            {
                "on_ground": to_flag(F.col("on_ground")),
                "squawk": F.coalesce("squawk", F.lit("")),
                "_ingest_ts": F.lit(0),
                "date": epoch_date(F.col("timestamp")),
            }
        ),
        BRONZE,
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_reports(state_vectors(spark, sf_dir))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.segment(reports(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.resample(segmented(spark, sf_dir))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.build_trajectories(reports(spark, sf_dir))


def flight_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per flight, without its points."""
    reported = tracks.with_flight_numbers(segmented(spark, sf_dir))
    starts = reported.where(F.col("timestamp") == F.col("seg_start")).select(*tracks.FLIGHT, "flight_no")
    return tracks.with_flight_ids(starts)


def flight_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long points with flight ids."""
    return tracks.with_flight_ids(tracks.build_points(reports(spark, sf_dir)))


def grid_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.grid_density(points(spark, sf_dir))


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.traffic_density(grid_density(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.forecast(flights(spark, sf_dir))


def stress_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = points(spark, sf_dir)
    return stress.stress_index(grid.grid_density(pts), pts)


def anomalies_of(stored_flights: DataFrame) -> DataFrame:
    """Anomaly records with a score that SQL can restate: 0.5 + (flight number mod 100) / 200.

    Type and explanation are the real ones; only the forest score is replaced.
    """
    features = anomaly.flight_features(stored_flights)
    stats = anomaly.scaler_columns(anomaly.scaler(features))
    number = F.get(F.split("flight_id", "_"), F.lit(2)).cast("int")
    scored = features.withColumn("anomaly_score", F.lit(0.5) + (number % 100) / 200.0)
    return anomaly.to_anomalies(anomaly.with_explanation(scored, stats), threshold=0.7)


def fixture_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies_of(stage(flights(spark, sf_dir), "flights"))
