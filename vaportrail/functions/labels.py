"""Labels and scores as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaportrail.defaults import ALT_RANGE, LAT_RANGE, LON_RANGE, SPEED_RANGE


def risk_level(stress: Column) -> Column:
    # 25 / 50 / 75.
    return F.when(stress < 25, "low").when(stress < 50, "medium").when(stress < 75, "high").otherwise("critical")


def confidence_label(mean_error_nm: Column) -> Column:
    # 0.5 / 2 nautical miles.
    return F.when(mean_error_nm < 0.5, "High").when(mean_error_nm < 2.0, "Medium").otherwise("Low")


def anomaly_type(feature: Column) -> Column:
    # Which feature-name part gives which type.
    return (
        F.when(feature.contains("alt"), "altitude")
        .when(feature.contains("speed"), "speed")
        .when(feature.contains("heading"), "route")
        .otherwise("behavior")
    )


def what_if_density(score: Column, factor_pct: float | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score * (F.lit(factor_pct) / 100.0)))


def what_if_stress(stress: Column, factor_pct: float | Column) -> Column:
    return F.least(F.lit(100.0), stress * (F.lit(factor_pct) / 100.0))


def at_least(points: Column, n: int) -> Column:
    """A track of ``n`` points or more."""
    return F.size(points) >= n


def valid_coordinate(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(*LAT_RANGE) & lon.between(*LON_RANGE), F.lit(False))


def valid_altitude(alt: Column) -> Column:
    return F.coalesce(alt.between(*ALT_RANGE), F.lit(False))


def valid_speed(speed: Column) -> Column:
    """A missing speed is valid."""
    return F.coalesce(speed.between(*SPEED_RANGE), F.lit(True))
