"""Airspace stress index per cell and hour."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaportrail.defaults import GRID_DEG
from vaportrail.functions.labels import risk_level
from vaportrail.operators.grid import CELL, CELL_HOUR, INDEX, cell_dispersion, with_centre, with_index

# Weights (sum 100), scales, and the density of a cell without density rows.
WEIGHT_DENSITY, WEIGHT_MANEUVER, WEIGHT_HEADING, WEIGHT_ANOMALY = 40, 35, 20, 5
ALT_SCALE_FT, HEADING_SCALE_DEG, SPEED_SCALE_KTS = 10000, 180, 200
DEFAULT_DENSITY = 0.5
# Weights of the density-only estimate.
ESTIMATE_DENSITY, ESTIMATE_ALTITUDE, ESTIMATE_HEADING, ESTIMATE_SPEED = 40, 20, 25, 15


def _capped(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def busiest(grid: DataFrame) -> Column:
    """The most flights that any cell had in any hour, 1 at least."""
    return grid.agg(F.greatest(F.max("flight_count"), F.lit(1))).scalar()


def hourly_flights(grid: DataFrame, resolution: float = GRID_DEG) -> DataFrame:
    """Mean flights per cell index and hour over all dates, and how many dates those are."""
    return with_index(grid, resolution, *CELL).groupBy(*INDEX, "hour").agg(
        F.avg("flight_count").alias("mean_flights"), F.count("flight_count").alias("n"), F.min("date").alias("date")
    )


def stress_index(
    grid: DataFrame,
    points: DataFrame | None,
    resolution: float = GRID_DEG,
    anomaly_share: Column | None = None,
    dispersion: DataFrame | None = None,
) -> DataFrame:
    """Weighted mix of density, altitude and speed spread, and heading spread for every cell and hour with points.

    ``dispersion``, where it is known already (:mod:`cellstate`), spares reading the points.
    Both sides are aggregated to one row per cell and hour before they meet, so the join sees no skew.
    """
    parts = (
        (cell_dispersion(points, resolution) if dispersion is None else dispersion)
        .join(hourly_flights(grid, resolution), [*INDEX, "hour"], "left")
        .select(
            F.coalesce("date", F.current_date()).alias("date"),
            "hour",
            *INDEX,
            F.coalesce(F.col("mean_flights") / busiest(grid), F.lit(DEFAULT_DENSITY)).alias("density"),
            (
                (_capped(F.col("alt_std") / ALT_SCALE_FT) + _capped(F.col("speed_std") / SPEED_SCALE_KTS)) / 2
            ).alias("maneuver"),
            _capped(F.col("heading_std") / HEADING_SCALE_DEG).alias("heading"),
            (anomaly_share if anomaly_share is not None else F.lit(0.0)).alias("anomaly"),
        )
    )
    index = (
        F.col("density") * WEIGHT_DENSITY
        + F.col("maneuver") * WEIGHT_MANEUVER
        + F.col("heading") * WEIGHT_HEADING
        + F.col("anomaly") * WEIGHT_ANOMALY
    )
    return with_centre(parts, resolution).select(
        *CELL_HOUR,
        index.alias("stress_index"),
        F.struct(
            F.col("density").alias("density_component"),
            F.col("maneuver").alias("maneuver_variance_component"),
            F.col("heading").alias("heading_conflict_component"),
            F.col("anomaly").alias("anomaly_component"),
        ).alias("components"),
        risk_level(index).alias("risk_level"),
    )


def stress_estimate(
    density: DataFrame, altitude_noise: float = 0.1, heading_noise: float = 0.15, speed: float = 0.15
) -> DataFrame:
    """Stress guessed from the density score alone, for cells without track data."""
    score = F.col("density_score")
    parts = {
        "density_score": score,
        "altitude_variance": _capped(score * 0.5 + altitude_noise),
        "heading_conflict_score": _capped(score * 0.3 + heading_noise),
        "speed_variance": _capped(F.lit(speed)),
    }
    index = (
        parts["density_score"] * ESTIMATE_DENSITY
        + parts["altitude_variance"] * ESTIMATE_ALTITUDE
        + parts["heading_conflict_score"] * ESTIMATE_HEADING
        + parts["speed_variance"] * ESTIMATE_SPEED
    )
    return density.select(
        *CELL_HOUR,
        F.bround(index, 2).alias("stress_index"),
        F.struct(*[F.bround(c, 4).alias(name) for name, c in parts.items()]).alias("components"),
        risk_level(index).alias("risk_level"),
    )


def with_estimates(index: DataFrame, density: DataFrame) -> DataFrame:
    """The stress index, and for cells and hours that have density rows but no tracks the estimate, in the same columns.

    A cell and hour is estimated once, from its mean density score. Altitude and speed variance are averaged into one component.
    """
    keys = [*CELL, "hour"]
    bare = density.groupBy(*keys).agg(F.avg("density_score").alias("density_score"), F.min("date").alias("date"))
    bare = bare.join(index.select(*keys).distinct(), keys, "left_anti")
    part = lambda name: F.col(f"components.{name}")
    components = F.struct(
        part("density_score").alias("density_component"),
        ((part("altitude_variance") + part("speed_variance")) / 2).alias("maneuver_variance_component"),
        part("heading_conflict_score").alias("heading_conflict_component"),
        F.lit(0.0).alias("anomaly_component"),
    )
    estimated = stress_estimate(bare).withColumn("components", components)
    return index.unionByName(estimated.select(*index.columns))
