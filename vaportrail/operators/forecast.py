"""Constant-velocity forecasts from the middle of each track, and their measured error."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaportrail.defaults import HORIZONS_SEC, MIN_FORECAST_POINTS
from vaportrail.functions.geo import dead_reckon, lateral_error_nm, zero_if_missing
from vaportrail.functions.labels import at_least, confidence_label
from vaportrail.operators.percentiles import group_percentiles


def midpoint(points: Column) -> Column:
    return F.get(points, F.floor(F.size(points) / 2).cast("int"))


def first_at_or_after(points: Column, ts: Column) -> Column:
    """First point of a time-sorted track at or after ``ts``; null past the end."""
    return F.get(F.filter(points, lambda p: p["ts"] >= ts), F.lit(0))


def forecast(
    flights: DataFrame, horizons: tuple[int, ...] = HORIZONS_SEC, min_points: int = MIN_FORECAST_POINTS
) -> DataFrame:
    """One row per flight and horizon: predicted point, actual point when the track reaches it, error.

    Works inside each flight's array: no shuffle.
    """
    points, mid_ts = F.col("points"), F.col("mid.ts")
    legs = F.transform(
        F.array(*[F.lit(h) for h in horizons]),
        lambda h: F.struct(
            h.alias("horizon_sec"),
            (mid_ts + h).alias("target_ts"),
            first_at_or_after(points, mid_ts + h).alias("actual"),
        ),
    )
    # the legs are found inside the array, so that the tracks themselves are not repeated per horizon
    ahead = (
        flights.where(at_least(F.col("points"), min_points))
        .withColumn("mid", midpoint(points))
        .select("flight_id", "date", "mid", F.inline(legs))
    )
    guess = dead_reckon(
        *[F.col(f"mid.{f}") for f in ("lat", "lon", "alt_ft", "speed_kts", "heading_deg", "vrate_fpm")],
        F.col("horizon_sec"),
    )
    ahead = ahead.withColumn(
        "guess", F.struct(F.col("target_ts").alias("ts"), *[c.alias(name) for name, c in guess.items()])
    )
    actual = F.struct(*[F.col(f"actual.{f}").alias(f) for f in ("ts", "lat", "lon", "alt_ft")])
    error = F.struct(
        lateral_error_nm(
            F.col("guess.lat"), F.col("guess.lon"), F.col("actual.lat"), F.col("actual.lon")
        ).alias("mae_lateral_nm"),
        F.abs(F.col("guess.alt_ft") - zero_if_missing(F.col("actual.alt_ft"))).alias("mae_vertical_ft"),
        F.lit(0.0).alias("mae_temporal_sec"),
    )
    reached = F.col("actual").isNotNull()
    return ahead.select(
        "flight_id",
        F.col("mid.ts").alias("prediction_ts"),
        "horizon_sec",
        F.array("guess").alias("predicted_points"),
        F.filter(F.array(F.when(reached, actual)), lambda p: p.isNotNull()).alias("actual_points"),
        F.when(reached, error).alias("error_metrics"),
        "date",
    )


def audit(predictions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row on forecast quality, or one for each value of the columns ``by``; none where no forecast could be checked.

    Reads ``predictions`` more than once: pass a stored table.
    """
    group = list(by) or ["_all"]
    error = F.col("error_metrics.mae_lateral_nm")
    errors = predictions.withColumn("_all", F.lit(0)).select(*group, error.alias("e")).where(F.col("e").isNotNull() & ~F.isnan("e"))
    summary = errors.groupBy(*group).agg(F.count("*").alias("sample_count"), F.avg("e").alias("mean_e"))
    ranked = group_percentiles(errors, "e", [0.5, 0.9], group).drop("n")
    at = lambda i: F.bround(F.get("percentiles", F.lit(i)), 3)
    return summary.join(ranked, group).select(
        *by,
        "sample_count",
        F.bround("mean_e", 3).alias("mean_lateral_error_nm"),
        at(0).alias("p50_lateral_error_nm"),
        at(1).alias("p90_lateral_error_nm"),
        confidence_label(F.col("mean_e")).alias("confidence_label"),
    )
