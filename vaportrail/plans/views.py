"""Read queries over the Gold tables. Each takes DataFrames, filters on the scan, and returns a DataFrame."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaportrail.functions.labels import risk_level, what_if_density, what_if_stress
from vaportrail.operators import registry, sampling


def _matches(conditions: list[tuple]) -> Column:
    """AND of the conditions whose parameter was given."""
    wanted = F.lit(True)
    for value, condition in conditions:
        if value is not None:
            wanted = wanted & condition
    return wanted


def _on_date(date: str | None) -> Column:
    return F.col("date") == F.lit(date).cast("date")


def metadata(models: DataFrame, versions: DataFrame, date_index: DataFrame) -> DataFrame:
    """One row: current version, when trained, range of dates, models."""
    current = versions.orderBy(F.col("model_version").desc()).limit(1)
    index = date_index.select(F.struct(F.col("first_date").alias("start"), F.col("last_date").alias("end"))).scalar()
    listed = models.agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "model_id",
                    F.col("model_type").alias("type"),
                    "version",
                    F.col("trained_at").cast("string").alias("trained_at"),
                )
            )
        )
    ).scalar()
    return current.select("data_version", "last_trained", index.alias("date_range"), listed.alias("models"))


def density(traffic_density: DataFrame, date: str | None = None, hour: int | None = None) -> DataFrame:
    return traffic_density.where(_matches([(date, _on_date(date)), (hour, F.col("hour") == F.lit(hour))])).select(
        F.col("grid_lat").alias("lat"),
        F.col("grid_lon").alias("lon"),
        F.col("hour").cast("int").alias("hour"),
        F.bround("density_score", 4).alias("score"),
        F.bround("density_percentile", 1).alias("percentile"),
    )


def predictions(
    table: DataFrame,
    date: str | None = None,
    flight_id: str | None = None,
    horizon: int | None = None,
    limit: int = 100,
) -> DataFrame:
    """Forecasts in flight, then horizon order. The date is matched as part of the flight id; the partition column,
    which holds the same date, prunes the scan."""
    chosen = table.where(
        _matches(
            [
                (date, _on_date(date) & F.col("flight_id").contains(F.lit(date))),
                (flight_id, F.col("flight_id") == F.lit(flight_id)),
                (horizon, F.col("horizon_sec") == F.lit(horizon)),
            ]
        )
    )
    return (
        chosen.orderBy("flight_id", "horizon_sec")
        .limit(limit)
        .select(
            "flight_id",
            "prediction_ts",
            "horizon_sec",
            F.col("predicted_points").alias("predicted"),
            F.col("actual_points").alias("actual"),
            F.col("error_metrics").alias("error"),
        )
    )


def anomalies(
    table: DataFrame, date: str | None = None, kind: str | None = None, min_score: float = 0.0, limit: int = 100
) -> DataFrame:
    """Highest scores first."""
    chosen = table.where(
        _matches(
            [
                (date, _on_date(date) & F.col("flight_id").contains(F.lit(date))),
                (kind, F.col("anomaly_type") == F.lit(kind)),
            ]
        )
        & (F.col("anomaly_score") >= min_score)
    )
    return (
        chosen.orderBy(F.col("anomaly_score").desc(), "flight_id")
        .limit(limit)
        .select(
            "flight_id",
            F.col("anomaly_type").alias("type"),
            F.bround("anomaly_score", 3).alias("score"),
            "explanation",
            "location",
        )
    )


def anomaly_cards(table: DataFrame, limit: int = 5) -> DataFrame:
    """The first few anomalies, as shown on cards."""
    return anomalies(table, limit=limit).select(
        "flight_id",
        "type",
        (F.col("score") * 100).alias("score_pct"),
        "explanation.context",
        F.bround("explanation.deviation_pct", 1).alias("deviation_pct"),
    )


def stress(
    table: DataFrame, date: str | None = None, hour: int | None = None, min_stress: float = 0.0
) -> DataFrame:
    return table.where(
        _matches([(date, _on_date(date)), (hour, F.col("hour") == F.lit(hour))])
        & (F.col("stress_index") >= min_stress)
    ).select(
        F.col("grid_lat").alias("lat"),
        F.col("grid_lon").alias("lon"),
        F.col("hour").cast("int").alias("hour"),
        F.bround("stress_index", 2).alias("stress_index"),
        "risk_level",
        "components",
    )


def display_components(stress_table: DataFrame) -> DataFrame:
    """Stress components under their display names, two decimals.

    Tables of the density-only estimate carry other component names; their maneuver value is the mean of two.
    """
    have = set(stress_table.schema["components"].dataType.fieldNames())

    def part(name: str) -> Column:
        return F.col(f"components.{name}") if name in have else F.lit(None).cast("double")

    zero = F.lit(0.0)
    older_maneuver = (
        F.coalesce(part("altitude_variance"), zero) + F.coalesce(part("speed_variance"), zero)
    ) / 2
    shown = {
        "density": F.coalesce(part("density_component"), part("density_score"), zero),
        "maneuver_variance": F.coalesce(part("maneuver_variance_component"), older_maneuver),
        "heading_conflict": F.coalesce(part("heading_conflict_component"), part("heading_conflict_score"), zero),
        "anomaly": F.coalesce(part("anomaly_component"), zero),
    }
    return stress_table.select(
        "date",
        F.col("hour").cast("int").alias("hour"),
        "grid_lat",
        "grid_lon",
        "risk_level",
        *[F.bround(c, 2).alias(name) for name, c in shown.items()],
    )


def trajectories(sampled: DataFrame, hour: int | None = None, limit: int = 100) -> DataFrame:
    """First flights by id with at least two points in the hour; points in time order."""
    return sampling.hour_tracks(sampled, hour).orderBy("flight_id").limit(limit).select("flight_id", "points")


def prediction_quality(audit: DataFrame, versions: DataFrame) -> DataFrame:
    """The forecast audit with the current model version."""
    return audit.withColumn("model_version", versions.agg(F.max("model_version")).scalar())


def mean_stress(view: DataFrame) -> DataFrame:
    """Mean stress as an integer, halves up; 0 for no rows."""
    return view.agg(F.coalesce(F.floor(F.avg("stress_index") + 0.5), F.lit(0)).alias("avg_stress"))


def bounds(located: DataFrame) -> DataFrame:
    """Smallest box around the rows; zero and missing coordinates are skipped."""
    lat, lon = F.when(F.col("lat") != 0, F.col("lat")), F.when(F.col("lon") != 0, F.col("lon"))
    return located.agg(
        F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon")
    )


def what_if_density_view(view: DataFrame, factor_pct: float) -> DataFrame:
    return view.withColumn("score", what_if_density(F.col("score"), factor_pct))


def what_if_stress_view(view: DataFrame, factor_pct: float) -> DataFrame:
    scaled = what_if_stress(F.col("stress_index"), factor_pct)
    return view.withColumns({"stress_index": scaled, "risk_level": risk_level(scaled)})


def stamped(view: DataFrame, versions: DataFrame) -> DataFrame:
    """Any view with the current data version on every row."""
    return registry.stamped(view, versions)
