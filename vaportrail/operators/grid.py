"""Hourly density on a latitude / longitude grid."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaportrail.defaults import GRID_DEG
from vaportrail.functions.geo import cell_centre, cell_index, hour_of_day
from vaportrail.operators.tracks import FLIGHT

CELL = ["grid_lat", "grid_lon"]
CELL_HOUR = ["date", "hour", *CELL]
# Cells are grouped and joined by integer index; the coordinates are worked out at the end.
INDEX = ["lat_index", "lon_index"]


def with_index(df: DataFrame, resolution: float = GRID_DEG, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.withColumns(
        {"lat_index": cell_index(F.col(lat), resolution), "lon_index": cell_index(F.col(lon), resolution)}
    )


def with_centre(df: DataFrame, resolution: float = GRID_DEG) -> DataFrame:
    """Replaces the cell index by the coordinates of the cell's centre."""
    return df.withColumns(
        {
            "grid_lat": cell_centre(F.col("lat_index"), resolution),
            "grid_lon": cell_centre(F.col("lon_index"), resolution),
        }
    ).drop(*INDEX)


def with_cell_hour(points: DataFrame, resolution: float = GRID_DEG) -> DataFrame:
    return with_index(points, resolution).withColumn("hour", hour_of_day(F.col("ts")))


def grid_density(points: DataFrame, flight: list[str] = FLIGHT, resolution: float = GRID_DEG) -> DataFrame:
    """Flights, points, mean altitude and mean speed per date, hour and cell.

    Points are first folded per flight and cell, which makes the flight count a plain count and leaves little
    to shuffle for a crowded cell. Missing altitudes and speeds do not enter the means.
    """
    flight = [c for c in flight if c != "date"]
    per_flight = (
        with_cell_hour(points, resolution)
        .groupBy("date", "hour", *INDEX, *flight)
        .agg(
            F.count("*").alias("n"),
            F.sum("alt_ft").alias("alt_sum"),
            F.count("alt_ft").alias("alt_n"),
            F.sum("speed_kts").alias("speed_sum"),
            F.count("speed_kts").alias("speed_n"),
        )
    )
    cells = per_flight.groupBy("date", "hour", *INDEX).agg(
        F.count("*").alias("flight_count"),
        F.sum("n").alias("point_count"),
        F.try_divide(F.sum("alt_sum"), F.sum("alt_n")).alias("avg_altitude_ft"),
        F.try_divide(F.sum("speed_sum"), F.sum("speed_n")).alias("avg_speed_kts"),
    )
    return with_centre(cells, resolution)


def cell_history(grid: DataFrame) -> DataFrame:
    """Per-cell statistics over all dates and hours (sample deviations)."""
    return grid.groupBy(*CELL).agg(
        F.avg("flight_count").alias("mean_flights"),
        F.stddev_samp("flight_count").alias("std_flights"),
        F.max("flight_count").alias("max_flights"),
        F.avg("point_count").alias("mean_points"),
        F.stddev_samp("point_count").alias("std_points"),
    )


def traffic_density(grid: DataFrame) -> DataFrame:
    """Score against the cell's maximum and an approximate percentile within the cell's history.

    The cell's statistics come from a window, so rows are not joined back. A cell seen once has no deviation
    and gets percentile 1. A cell holds at most one row per date and hour.
    """
    cell = Window.partitionBy(*CELL)
    flights = F.col("flight_count")
    deviation = F.stddev_samp(flights).over(cell)
    spread = 50 + 15 * ((flights - F.avg(flights).over(cell)) / F.greatest(deviation, F.lit(1.0)))
    percentile = F.when(deviation.isNull(), 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(99.0), spread)))
    return grid.select(
        *CELL_HOUR,
        (flights / F.greatest(F.max(flights).over(cell), F.lit(1))).alias("density_score"),
        percentile.alias("density_percentile"),
        F.lit(None).cast("double").alias("yoy_change_pct"),
    )


def cell_dispersion(points: DataFrame, resolution: float = GRID_DEG) -> DataFrame:
    """Population deviation of altitude, heading and speed per cell index and hour, all dates together."""
    zeroed = with_cell_hour(points, resolution).fillna(0.0, ["alt_ft", "heading_deg", "speed_kts"])
    return zeroed.groupBy(*INDEX, "hour").agg(
        F.stddev_pop("alt_ft").alias("alt_std"),
        F.stddev_pop("heading_deg").alias("heading_std"),
        F.stddev_pop("speed_kts").alias("speed_std"),
    )


def max_cells(resolution: float = GRID_DEG) -> int:
    """Number of cells of the whole globe: the most rows a table of distinct cells can have."""
    return int(180 / resolution + 1) * int(360 / resolution + 1)


def planes_in_cells(
    points: DataFrame, cells: DataFrame, flight: list[str] | None = None, resolution: float = GRID_DEG
) -> DataFrame:
    """Flights with a point inside each cell's box (edges included) and the altitude at the first such point.

    ``cells`` has ``grid_lat`` and ``grid_lon``; ``flight`` names the columns of ``points`` that identify a flight. A
    point can only lie in the boxes centred just below and just above it, so it is expanded to those, tested, and
    folded per cell and flight before the join.
    """
    flight = flight or ["flight_id"]
    res, half = F.lit(resolution), F.lit(resolution / 2)

    def indexes(x: str):
        below, above = F.floor(F.col(x) / res).cast("int"), F.ceil(F.col(x) / res).cast("int")
        in_below = F.col(x) <= cell_centre(below, resolution) + half
        in_above = F.col(x) >= cell_centre(above, resolution) - half
        return F.explode(
            F.when(in_below & in_above & (below < above), F.array(below, above))
            .when(in_below, F.array(below))
            .when(in_above, F.array(above))
        )

    first_seen = (
        points.select(*flight, "ts", "lat", "lon", "alt_ft")
        .withColumn("lat_index", indexes("lat"))
        .withColumn("lon_index", indexes("lon"))
        .groupBy(*INDEX, *flight)
        .agg(F.min_by("alt_ft", "ts").alias("alt_ft"))
    )
    wanted = with_index(cells, resolution, *CELL).select(*INDEX).distinct()
    if max_cells(resolution) <= 300_000:  # 8 bytes a row: a few megabytes at most
        wanted = F.broadcast(wanted)
    return with_centre(first_seen.join(wanted, INDEX), resolution)
