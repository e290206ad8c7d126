"""Reduced tracks for display: every n-th flight, every n-th point, points of one hour."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaportrail.defaults import SAMPLE_EVERY, SAMPLE_FLIGHTS
from vaportrail.functions.geo import hour_of_day, zero_if_missing
from vaportrail.functions.labels import at_least
from vaportrail.operators.numbering import number_rows


def sample_flights(flights: DataFrame, target: int = SAMPLE_FLIGHTS, hard_limit: bool = False) -> DataFrame:
    """Every (n div target)-th flight in id order; may return up to twice ``target`` unless ``hard_limit``.

    Only ids are numbered; the sample's fewer than 2 * target ids then pick their tracks.
    """
    ids = flights.select("flight_id")
    step = F.greatest(F.lit(1), F.floor(ids.agg(F.count("*")).scalar() / target))
    picked = number_rows(ids, "flight_id").where(F.col("row_no") % step == 0).select("flight_id")
    if hard_limit:
        picked = picked.orderBy("flight_id").limit(target)
    return flights.join(picked, "flight_id", "left_semi")


def thin_tracks(flights: DataFrame, every: int = SAMPLE_EVERY, min_raw: int = 5, min_kept: int = 3) -> DataFrame:
    """Every ``every``-th point and the last one; tracks too short before or after are left out."""
    last = F.size("points") - 1
    kept = F.filter("points", lambda p, i: (i % every == 0) | (i == last))
    slim = F.transform(
        kept,
        lambda p: F.struct(
            p["ts"].alias("ts"),
            *[zero_if_missing(p[f]).alias(f) for f in ("lat", "lon", "alt_ft", "speed_kts", "heading_deg")],
        ),
    )
    return (
        flights.where(at_least(F.col("points"), min_raw))
        .select("flight_id", slim.alias("points"))
        .where(at_least(F.col("points"), min_kept))
    )


def with_time_index(flights: DataFrame) -> DataFrame:
    """Adds what hour filters and the time range need as plain columns: first and last positive timestamp, first and last
    hour of day, and ``hours``, a mask with a bit for each hour of day that has a point."""
    stamps = F.filter(F.col("points.ts"), lambda ts: ts > 0)
    since_epoch = F.array_distinct(F.transform("_stamps", lambda ts: F.call_function("div", ts, F.lit(3600))))
    hours = F.transform(since_epoch, lambda hour: F.pmod(hour, F.lit(24)).cast("int"))  # a few for each flight
    bit = lambda hour: F.call_function("shiftleft", F.lit(1), hour)
    return flights.withColumn("_stamps", stamps).withColumn("_hours", hours).withColumns(
        {
            "first_ts": F.array_min("_stamps"),
            "last_ts": F.array_max("_stamps"),
            "first_hour": F.array_min("_hours").cast("tinyint"),
            "last_hour": F.array_max("_hours").cast("tinyint"),
            "hours": F.aggregate("_hours", F.lit(0), lambda mask, hour: mask.bitwiseOR(bit(hour))),
        }
    ).drop("_stamps", "_hours")


def in_hour(hour: int) -> Column:
    """Flights with a point in that hour of day, by their time index. The range of hours reaches the scan."""
    range_of = (F.col("first_hour") <= F.lit(hour).cast("tinyint")) & (F.col("last_hour") >= F.lit(hour).cast("tinyint"))
    return range_of & (F.col("hours").bitwiseAND(F.lit(1 << hour)) != 0)


def hour_tracks(flights: DataFrame, hour: int | None = None, min_points: int = 2) -> DataFrame:
    """Tracks cut to the points of one UTC hour, in time order; tracks left with too few points are dropped.

    Of flights with a time index only those with a point in the hour have their points unpacked.
    """
    points = F.col("points")
    if hour is not None:
        points = F.filter(points, lambda p: (p["ts"] > 0) & (hour_of_day(p["ts"]) == hour))
        if "hours" in flights.columns:
            flights = flights.where(in_hour(hour))
    return (
        flights.withColumn("points", points)
        .where(at_least(F.col("points"), min_points))
        .withColumn("points", F.sort_array("points"))
    )


def time_range(flights: DataFrame) -> DataFrame:
    """One row: first and last positive timestamp over all points, zeros when there is none.

    Flights with a time index have theirs read instead of their points.
    """
    if "first_ts" in flights.columns:
        first, last = F.min("first_ts"), F.max("last_ts")
    else:
        stamps = F.filter(F.transform("points", lambda p: p["ts"]), lambda ts: ts > 0)
        first, last = F.min(F.array_min(stamps)), F.max(F.array_max(stamps))
    return flights.agg(F.coalesce(first, F.lit(0)).alias("min_ts"), F.coalesce(last, F.lit(0)).alias("max_ts"))
