"""Where flights were at a given moment."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaportrail.defaults import QUOTA_ANOMALY, QUOTA_NORMAL, TRAIL_SEC
from vaportrail.functions.geo import initial_bearing, slider_time
from vaportrail.operators.sampling import time_range


def bracket(points: Column, t: Column) -> tuple[Column, Column]:
    """The last point of a time-sorted track at or before ``t``, and the first at or after it; null where there is none."""
    before = F.try_element_at(F.filter(points, lambda p: p["ts"] <= t), F.lit(-1))
    return before, F.get(F.filter(points, lambda p: p["ts"] >= t), F.lit(0))


def position_at(points: Column, t: Column) -> Column:
    """Struct (lat, lon, alt_ft, heading_deg) at time ``t`` on a time-sorted track.

    Between two points: linear, heading along the line. On a point, or outside the track: that point as stored.
    """
    before, after = bracket(points, t)
    nearest = F.coalesce(before, after)
    between = before["ts"] < after["ts"]
    share = (t - before["ts"]) / (after["ts"] - before["ts"])

    def along(field: str) -> Column:
        moved = before[field] + (after[field] - before[field]) * share
        return F.when(between, moved).otherwise(nearest[field]).alias(field)

    bearing = initial_bearing(before["lat"], before["lon"], after["lat"], after["lon"])
    return F.struct(
        along("lat"),
        along("lon"),
        along("alt_ft"),
        F.when(between, bearing).otherwise(nearest["heading_deg"]).alias("heading_deg"),
    )


def trail(points: Column, t: Column, seconds: int = TRAIL_SEC) -> Column:
    """Points of the last ``seconds`` up to ``t``."""
    return F.filter(points, lambda p: (p["ts"] <= t) & (p["ts"] > t - seconds))


def split_by_anomaly(flights: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Adds ``is_anomaly``: whether the flight has an anomaly record."""
    flagged = anomalies.select("flight_id").distinct().withColumn("is_anomaly", F.lit(True))
    return flights.join(flagged, "flight_id", "left").withColumn(
        "is_anomaly", F.coalesce("is_anomaly", F.lit(False))
    )


def quota(flagged: DataFrame, anomalous: int = QUOTA_ANOMALY, normal: int = QUOTA_NORMAL) -> DataFrame:
    """First flights by id of each kind. The rank filter limits every task before the shuffle."""
    most = max(anomalous, normal)
    ranked = flagged.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("is_anomaly").orderBy("flight_id"))
    ).where(F.col("_rank") <= most)
    allowed = F.when(F.col("is_anomaly"), anomalous).otherwise(normal)
    return ranked.where(F.col("_rank") <= allowed).drop("_rank")


def planes_at(
    flights: DataFrame,
    anomalies: DataFrame,
    t: int | float | None = None,
    position: float | None = None,
    anomalous: int = QUOTA_ANOMALY,
    normal: int = QUOTA_NORMAL,
) -> DataFrame:
    """Position and trail of up to ``anomalous`` + ``normal`` flights at time ``t`` or at a 0..100 slider position.

    The quota is settled on ids alone; only the chosen flights' tracks are then touched.
    """
    if t is None:
        span = time_range(flights)
        moment = span.select(slider_time(position, F.col("min_ts"), F.col("max_ts"))).scalar()
    else:
        moment = F.lit(float(t))
    chosen = quota(split_by_anomaly(flights.select("flight_id"), anomalies), anomalous, normal)
    tracks = flights.where(F.size("points") > 0).join(chosen, "flight_id")
    return (
        tracks.withColumn("t", moment)
        .withColumn("at", position_at(F.col("points"), F.col("t")))
        .select("flight_id", "callsign", "is_anomaly", "t", "at.*", trail(F.col("points"), F.col("t")).alias("trail"))
    )
