"""Outlier flights: features, scaling, isolation-forest score, explanation, model tables."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaportrail.defaults import (
    ANOMALY_THRESHOLD,
    FOREST_CONTAMINATION,
    FOREST_SUBSAMPLE,
    FOREST_TREES,
    MIN_TRAINING_FLIGHTS,
)
from vaportrail.functions.geo import zero_if_missing
from vaportrail.functions.labels import anomaly_type
from vaportrail.operators.forecast import midpoint
from vaportrail.operators.forest import grow_forest, isolation, tree_samples
from vaportrail.operators.percentiles import exact_percentiles
from vaportrail.session import stage

# Feature order (first wins a tie) and model identity.
FEATURES = [
    "duration_sec",
    "distance_nm",
    "max_alt_ft",
    "avg_speed_kts",
    "heading_change_total",
    "climb_count",
    "descent_count",
]
# Also fixed: the texts of an explanation in with_explanation.
MODEL_ID = "anomaly_001"
MODEL_VERSION = "1.0.0"


def flight_features(flights: DataFrame) -> DataFrame:
    """Slim table for training and scoring: seven features and the midpoint location."""
    mid = midpoint(F.col("points"))
    return flights.select(
        "flight_id",
        "date",
        *[zero_if_missing(F.col(f)).alias(f) for f in FEATURES],
        F.struct(*[zero_if_missing(mid[f]).alias(f) for f in ("lat", "lon", "alt_ft")]).alias("location"),
    )


def scaler(features: DataFrame) -> DataFrame:
    """Mean and population deviation per feature, one row each; a constant feature scales by 1."""
    wide = features.agg(
        *[F.avg(f).alias(f"mean_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"std_{f}") for f in FEATURES]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"mean_{f}").alias("mean"),
                F.when(F.col(f"std_{f}") == 0, 1.0).otherwise(F.col(f"std_{f}")).alias("scale"),
            )
            for f in FEATURES
        ]
    )
    return wide.select(F.inline(rows))


def scaler_columns(scaler_df: DataFrame) -> dict[str, tuple[Column, Column]]:
    """The scaler as one scalar subquery, so that scaling needs no join and no driver round trip."""
    table = scaler_df.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale"))))
    ).scalar()
    return {f: (table[f]["mean"], table[f]["scale"]) for f in FEATURES}


def z_scores(stats: dict[str, tuple]) -> dict[str, Column]:
    return {f: (F.col(f) - mean) / scale for f, (mean, scale) in stats.items()}


def with_explanation(features: DataFrame, stats: dict[str, tuple]) -> DataFrame:
    """Names the feature furthest from its mean and derives the anomaly type from it."""
    sizes = F.array(*[F.abs(z) for z in z_scores(stats).values()])
    placed = features.withColumn("_z", sizes).withColumn("_at", F.array_position("_z", F.array_max("_z")).cast("int"))
    name = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("_at"))
    return placed.withColumns(
        {
            "anomaly_type": anomaly_type(name),
            "explanation": F.struct(
                F.concat(F.lit("unusual_"), name).alias("primary_factor"),
                (F.array_max("_z") * 100).alias("deviation_pct"),
                F.lit(0.0).alias("baseline_value"),
                F.element_at(F.array(*FEATURES), F.col("_at")).alias("observed_value"),
                F.concat(
                    F.lit("Feature '"), name, F.lit("' deviates significantly from normal patterns")
                ).alias("context"),
            ),
        }
    ).drop("_z", "_at")


@dataclass
class Detector:
    """A trained model: three small tables. ``trained_on`` are its training rows with their isolation."""

    nodes: DataFrame
    scaler: DataFrame
    meta: DataFrame
    trained_on: DataFrame | None = None

    def save(self, path: str) -> None:
        """Stores this version, in place of what was stored under it; other versions stay."""
        for name, table in (("nodes", self.nodes), ("scaler", self.scaler), ("meta", self.meta)):
            (
                table.write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("model_id", "version")
                .parquet(f"{path}/{name}")
            )

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, model_id: str = MODEL_ID, version: str = MODEL_VERSION
    ) -> "Detector":
        def read(name: str) -> DataFrame:
            wanted = (F.col("model_id") == model_id) & (F.col("version") == version)
            return spark.read.parquet(f"{path}/{name}").where(wanted)

        return cls(read("nodes"), read("scaler"), read("meta"))

    def stats(self) -> dict[str, tuple[Column, Column]]:
        """Seven rows, as literals."""
        rows = {r["feature"]: r for r in self.scaler.collect()}
        return {f: (F.lit(rows[f]["mean"]), F.lit(rows[f]["scale"])) for f in FEATURES}

    def isolation_column(self, stats: dict[str, tuple]) -> Column:
        """Score column; ships the forest, at most trees * 511 rows, to the tasks."""
        size = self.meta.first()["subsample"]
        return isolation(self.nodes.drop("model_id", "version").toPandas(), size, list(z_scores(stats).values()))

    def score(self, features: DataFrame) -> DataFrame:
        """Adds ``anomaly_score`` in 0..1, ``anomaly_type`` and ``explanation``."""
        stats = self.stats()
        return self._explained(features.withColumn("_isolation", self.isolation_column(stats)), stats)

    def score_trained(self) -> DataFrame:
        """:meth:`score` of the training rows, whose isolation is known."""
        return self._explained(self.trained_on, self.stats())

    def _explained(self, isolated: DataFrame, stats: dict[str, tuple]) -> DataFrame:
        decision = F.col("_isolation") - F.lit(self.meta.first()["offset"])
        scored = isolated.withColumn(
            "anomaly_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - decision))
        ).drop("_isolation")
        return with_explanation(scored, stats)


def fit_detector(
    features: DataFrame,
    trees: int = FOREST_TREES,
    subsample: int = FOREST_SUBSAMPLE,
    contamination: float = FOREST_CONTAMINATION,
    min_flights: int = MIN_TRAINING_FLIGHTS,
    trained_at: Column | None = None,
    version: str = MODEL_VERSION,
) -> Detector | None:
    """Train on a stored table of :func:`flight_features`; None below ``min_flights``."""
    total = features.count()
    if total < min_flights:
        return None
    size = min(subsample, total)
    identity = {"model_id": F.lit(MODEL_ID), "version": F.lit(version)}
    scales = stage(scaler(features).withColumns(identity), "scaler")
    detector = Detector(nodes=None, scaler=scales, meta=None)
    stats = detector.stats()
    scaled = features.select("flight_id", *[z.alias(f) for f, z in z_scores(stats).items()])
    samples = tree_samples(scaled, "flight_id", total, trees, size)
    detector.nodes = stage(grow_forest(samples, "flight_id", FEATURES, size).withColumns(identity), "forest")
    detector.meta = features.limit(1).select(F.lit(size).alias("subsample"))
    detector.trained_on = stage(features.withColumn("_isolation", detector.isolation_column(stats)), "isolation")
    offset = exact_percentiles(detector.trained_on, "_isolation", [contamination])[0]
    detector.meta = stage(
        features.limit(1).select(
            F.lit(size).alias("subsample"),
            F.lit(offset).alias("offset"),
            F.lit(total).cast("bigint").alias("samples_trained"),
            (trained_at if trained_at is not None else F.unix_timestamp()).alias("trained_at"),
            *[c.alias(n) for n, c in identity.items()],
        ),
        "meta",
    )
    return detector


def to_anomalies(scored: DataFrame, threshold: float = ANOMALY_THRESHOLD) -> DataFrame:
    """Scored flights at or above the threshold, in the anomaly schema."""
    return scored.where(F.col("anomaly_score") >= threshold).select(
        "flight_id",
        "anomaly_type",
        "anomaly_score",
        F.unix_timestamp().alias("detected_at_ts"),
        "explanation",
        "location",
        "date",
    )
