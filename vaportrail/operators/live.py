"""Current position of every forecast flight, and forecast against actual paths."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaportrail.defaults import MAX_LIVE_PLANES, MAX_PATH_PAIRS
from vaportrail.functions.geo import initial_bearing


def live_planes(predictions: DataFrame, anomalies: DataFrame, limit: int | None = MAX_LIVE_PLANES) -> DataFrame:
    """One row per flight of the first ``limit`` ids, or of all with None: position from its furthest forecast, heading over its forecasts, route-anomaly flag.

    Route anomalies also carry both paths and the gap between their ends.
    """
    actual, guess = F.get("actual_points", F.lit(0)), F.get("predicted_points", F.lit(0))
    fields = ("lat", "lon", "alt_ft")
    rows = predictions.select(
        "flight_id",
        "horizon_sec",
        F.when(actual.isNotNull(), F.struct(*[actual[f].alias(f) for f in fields])).alias("actual"),
        F.when(guess.isNotNull(), F.struct(*[guess[f].alias(f) for f in fields])).alias("guess"),
    )
    if limit is not None:  # ids alone are sorted; only the legs of the chosen ones are gathered
        chosen = predictions.select("flight_id").distinct().orderBy("flight_id").limit(limit)
        rows = rows.join(chosen, "flight_id", "left_semi")
    flights = rows.groupBy("flight_id").agg(
        F.sort_array(F.collect_list(F.struct("horizon_sec", "actual", "guess"))).alias("legs")
    )
    first, last = F.get("legs", F.lit(0)), F.try_element_at("legs", F.lit(-1))
    start, end = F.coalesce(first["actual"], first["guess"]), F.coalesce(last["actual"], last["guess"])
    moving = (F.size("legs") >= 2) & last["actual"].isNotNull()
    placed = flights.where(end.isNotNull()).select(
        "flight_id",
        end["lat"].alias("lat"),
        end["lon"].alias("lon"),
        last["actual"]["alt_ft"].alias("alt_ft"),
        F.when(moving, initial_bearing(start["lat"], start["lon"], end["lat"], end["lon"]))
        .otherwise(0.0)
        .alias("heading_deg"),
        F.filter(F.transform("legs", lambda leg: leg["guess"]), lambda p: p.isNotNull()).alias("predicted_path"),
        F.filter(F.transform("legs", lambda leg: leg["actual"]), lambda p: p.isNotNull()).alias("actual_path"),
    )
    route = anomalies.where(F.col("anomaly_type") == "route").select(
        "flight_id", F.lit(True).alias("is_anomaly"), "anomaly_score", F.col("explanation.context").alias("context")
    )
    flagged = placed.join(route, "flight_id", "left").withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(False))
    )
    predicted_end, actual_end = (
        F.try_element_at("predicted_path", F.lit(-1)),
        F.try_element_at("actual_path", F.lit(-1)),
    )
    gap = F.struct(
        predicted_end["lat"].alias("predicted_lat"),
        predicted_end["lon"].alias("predicted_lon"),
        actual_end["lat"].alias("actual_lat"),
        actual_end["lon"].alias("actual_lon"),
    )
    both = predicted_end.isNotNull() & actual_end.isNotNull()
    return flagged.withColumns(
        {
            "deviation": F.when(F.col("is_anomaly") & both, gap),
            "predicted_path": F.when(F.col("is_anomaly"), F.col("predicted_path")),
            "actual_path": F.when(F.col("is_anomaly"), F.col("actual_path")),
        }
    )


def path_pairs(predictions: DataFrame, limit: int | None = MAX_PATH_PAIRS) -> DataFrame:
    """Predicted and actual path of the first forecasts, where both exist, and the segment between their ends."""
    head = predictions if limit is None else predictions.orderBy("flight_id", "horizon_sec").limit(limit)
    end_of = {n: F.try_element_at(F.col(n), F.lit(-1)) for n in ("predicted_points", "actual_points")}
    return head.where((F.size("predicted_points") > 0) & (F.size("actual_points") > 0)).select(
        "flight_id",
        "horizon_sec",
        F.col("predicted_points").alias("predicted"),
        F.col("actual_points").alias("actual"),
        *[
            end[f].alias(f"{name.split('_')[0]}_end_{f}")
            for name, end in end_of.items()
            for f in ("lat", "lon")
        ],
    )
