"""Mergeable per-cell state, so that a training window is put together from days that were each worked out once.

A state is a count, means and sums of squared differences (M2). Two merge into the state of both (Chan's pairwise formula), so a
new day adds one partition and a changed day replaces one; the points of the other days are not read again.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaportrail.defaults import GRID_DEG
from vaportrail.operators.grid import CELL_HOUR, INDEX, with_cell_hour, with_centre, with_index

MEASURES = {"alt": "alt_ft", "heading": "heading_deg", "speed": "speed_kts"}
COUNTS = {"flights": "flight_count", "points": "point_count"}


def _moments(columns: dict[str, str]) -> list[Column]:
    out = [F.count("*").alias("n")]
    for name, column in columns.items():
        out += [F.avg(column).alias(f"{name}_mean"), (F.var_pop(column) * F.count("*")).alias(f"{name}_m2")]
    return out


def hour_states(points: DataFrame, resolution: float = GRID_DEG) -> DataFrame:
    """State of altitude, heading and speed per date, hour and cell; missing values count as zero, as in the dispersion."""
    zeroed = with_cell_hour(points, resolution).fillna(0.0, list(MEASURES.values()))
    return zeroed.groupBy("date", "hour", *INDEX).agg(*_moments(MEASURES))


def day_states(grid: DataFrame, resolution: float = GRID_DEG) -> DataFrame:
    """State of the hourly flight and point counts per date and cell."""
    indexed = with_index(grid, resolution, "grid_lat", "grid_lon")
    return indexed.groupBy("date", *INDEX).agg(*_moments(COUNTS), F.max("flight_count").alias("max_flights"))


def merged(states: DataFrame, key: list[str], measures: list[str], *more: Column) -> DataFrame:
    """One state for each ``key``: those of its dates merged one after the other, in order of date.

    A key has at most one state for each date of the window.
    """
    fields = ["date", "n", *[f"{m}_{part}" for m in measures for part in ("mean", "m2")]]

    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        parts = [n.alias("n")]
        for m in measures:
            apart = b[f"{m}_mean"] - a[f"{m}_mean"]
            parts.append((a[f"{m}_mean"] + apart * b["n"] / n).alias(f"{m}_mean"))
            parts.append((a[f"{m}_m2"] + b[f"{m}_m2"] + apart * apart * a["n"] * b["n"] / n).alias(f"{m}_m2"))
        return F.struct(*parts)

    start = F.struct(
        F.lit(0).cast("bigint").alias("n"), *[F.lit(0.0).alias(f"{m}_{part}") for m in measures for part in ("mean", "m2")]
    )
    held = states.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("days"), *more)
    return held.withColumn("state", F.aggregate("days", start, merge)).drop("days").select("*", "state.*").drop("state")


def cell_dispersion(states: DataFrame) -> DataFrame:
    """Population deviations per cell index and hour over all dates, from hour states."""
    names = list(MEASURES)
    whole = merged(states, [*INDEX, "hour"], names)
    return whole.select(*INDEX, "hour", *[F.sqrt(F.col(f"{m}_m2") / F.col("n")).alias(f"{m}_std") for m in names])


def cell_history(states: DataFrame) -> DataFrame:
    """Per cell index over all dates and hours, from day states: means, sample deviations and the largest flight count."""
    whole = merged(states, INDEX, list(COUNTS), F.max("max_flights").alias("max_flights"))
    deviation = lambda m: F.when(F.col("n") > 1, F.sqrt(F.col(f"{m}_m2") / (F.col("n") - 1)))
    return whole.select(
        *INDEX,
        F.col("flights_mean").alias("mean_flights"),
        deviation("flights").alias("std_flights"),
        "max_flights",
        F.col("points_mean").alias("mean_points"),
        deviation("points").alias("std_points"),
    )


def traffic_density(grid: DataFrame, states: DataFrame, resolution: float = GRID_DEG) -> DataFrame:
    """As :func:`grid.traffic_density`, with the cells' history from day states. A cell has at most one row an hour of the window."""
    flights = F.col("flight_count")
    indexed = with_index(grid, resolution, "grid_lat", "grid_lon").join(cell_history(states), INDEX)
    spread = 50 + 15 * ((flights - F.col("mean_flights")) / F.greatest("std_flights", F.lit(1.0)))
    bounded = F.greatest(F.lit(1.0), F.least(F.lit(99.0), spread))
    return with_centre(indexed, resolution).select(
        *CELL_HOUR,
        (flights / F.greatest("max_flights", F.lit(1))).alias("density_score"),
        F.when(F.col("std_flights").isNull(), 1.0).otherwise(bounded).alias("density_percentile"),
        F.lit(None).cast("double").alias("yoy_change_pct"),
    )
