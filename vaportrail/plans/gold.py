"""Silver to Gold: density, forecasts with their audit, outliers, stress, registry, display sample."""

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaportrail import schemas
from vaportrail.defaults import ANOMALY_THRESHOLD, HORIZONS_SEC, KEPT_GOLD_RUNS, TRAINING_DAYS
from vaportrail.functions.geo import epoch_date
from vaportrail.operators import anomaly, cellstate, forecast, registry, sampling, stress
from vaportrail.session import delete_path, stage
from vaportrail.sources import tables

ARTIFACTS = {
    "traffic_density": schemas.DENSITY,
    "predictions": schemas.PREDICTION,
    "anomalies": schemas.ANOMALY,
    "airspace_stress": schemas.STRESS,
}


def build_gold(
    spark: SparkSession,
    silver_path: str,
    gold_path: str,
    training_days: int = TRAINING_DAYS,
    horizons: tuple[int, ...] = HORIZONS_SEC,
    threshold: float = ANOMALY_THRESHOLD,
    root: str | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Writes every Gold table for the training window that ends at the latest Silver date; the run's version row.

    With a ``root`` the run is one of several (:func:`publish_gold`): models and the history of versions belong to the root, and
    the version row is left to the caller to write. ``now`` is the epoch second of the run.
    """
    now = F.unix_timestamp() if now is None else now
    dates = tables.load_trajectories(spark, silver_path).select("date")
    window = registry.training_window(dates, training_days)
    span = window.first()
    if span is None:
        raise ValueError(f"no trajectories under {silver_path}")
    start, end = span["training_start"], span["training_end"]
    flights = tables.load_trajectories(spark, silver_path, start, end)
    cells = tables.load_grid(spark, silver_path, start, end)
    hours, days = tables.load_states(spark, silver_path, start, end)

    def write(name: str, df: DataFrame) -> None:
        key = ["flight_id"] if "flight_id" in df.columns else ["grid_lat", "grid_lon"]
        tables.write_table(df, f"{gold_path}/{name}", ARTIFACTS[name], sort=key)

    history_path = f"{gold_path}/metadata/versions"
    if root is not None:
        history = published(spark, root)
    else:
        history = load_versions(spark, gold_path) if tables.exists(spark, history_path) else None
    run = 0 if history is None else history.agg(F.coalesce(F.max("model_version"), F.lit(0))).first()[0]
    model_version = f"1.0.{run}"
    write("traffic_density", cellstate.traffic_density(cells, days))
    write("predictions", forecast.forecast(flights, horizons))
    index = stress.stress_index(cells, None, dispersion=cellstate.cell_dispersion(hours))
    write("airspace_stress", stress.with_estimates(index, load_artifact(spark, gold_path, "traffic_density")))

    features = stage(anomaly.flight_features(flights), "features")
    detector = anomaly.fit_detector(features, version=model_version)
    if detector is not None:
        write("anomalies", anomaly.to_anomalies(detector.score_trained(), threshold))
        detector.save(f"{root or gold_path}/models/{anomaly.MODEL_ID}")
    else:  # too few flights to train on: no outliers, and none left from an earlier run
        write("anomalies", spark.createDataFrame([], schemas.struct_type(schemas.ANOMALY)))

    fixed = spark.createDataFrame([(start, end)], "training_start date, training_end date").withColumn(
        "training_days", F.datediff("training_end", "training_start") + 1
    )
    models = registry.model_metadata(fixed, now, detector is not None, model_version)
    tables.write_table(models, f"{gold_path}/metadata/models", schemas.MODEL, None)
    version = registry.next_version(models, history, epoch_date(now), now)
    if root is None:
        tables.write_table(version, history_path, schemas.VERSION, None, mode="append")

    predictions = load_artifact(spark, gold_path, "predictions")
    registry.date_index(predictions).write.mode("overwrite").parquet(f"{gold_path}/metadata/date_index")
    audit = forecast.audit(predictions).withColumns(
        {"date": epoch_date(now), "computed_at": now}
    )
    audit.write.mode("overwrite").parquet(f"{gold_path}/metadata/audit")
    sampled = sampling.thin_tracks(sampling.sample_flights(flights))
    tables.write_table(sampled, f"{gold_path}/sampled_trajectories", schemas.SAMPLED, None)
    return version


def publish_gold(spark: SparkSession, silver_path: str, root: str, keep_runs: int = KEPT_GOLD_RUNS, **build) -> str:
    """Builds Gold in a folder of its own and publishes it as a whole; the folder.

    The last step adds one row to ``published``: the run's version and its folder. Readers resolve that pointer
    (:func:`current`), so they see one run's tables or the next one's, and a run that fails leaves the old answers. Folders
    of older runs than the last ``keep_runs`` go.
    """
    folder = f"{root}/runs/{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    version = build_gold(spark, silver_path, folder, root=root, **build)
    tables.write_table(version.withColumn("folder", F.lit(folder)).coalesce(1), f"{root}/published", schemas.PUBLISHED, None, mode="append")
    kept = published(spark, root).orderBy(F.desc("model_version")).limit(keep_runs).select("folder")
    old = published(spark, root).join(kept, "folder", "left_anti").select("folder").collect()  # one row a run
    for row in old:
        delete_path(spark, row["folder"])
    return folder


def published(spark: SparkSession, root: str) -> DataFrame:
    """The history of published versions, with their folders."""
    if not tables.exists(spark, f"{root}/published"):
        return spark.createDataFrame([], schemas.struct_type(schemas.PUBLISHED))
    return tables.read_table(spark, f"{root}/published", schemas.PUBLISHED)


def current(spark: SparkSession, root: str) -> str:
    """The folder of the latest published run, for :func:`load_artifact` and the other readers."""
    folder = published(spark, root).agg(F.max_by("folder", "model_version")).first()[0]
    if folder is None:
        raise ValueError(f"nothing published under {root}")
    return folder


def load_sampled(spark: SparkSession, gold_path: str) -> DataFrame:
    return tables.read_table(spark, f"{gold_path}/sampled_trajectories", schemas.SAMPLED)


def load_artifact(spark: SparkSession, gold_path: str, name: str) -> DataFrame:
    """A Gold table; without rows when a run produced none."""
    path = f"{gold_path}/{name}"
    if tables.exists(spark, path):
        return tables.read_table(spark, path, ARTIFACTS[name])
    return spark.createDataFrame([], schemas.struct_type(ARTIFACTS[name]))


def load_versions(spark: SparkSession, gold_path: str) -> DataFrame:
    return tables.read_table(spark, f"{gold_path}/metadata/versions", schemas.VERSION)


def gold_stats(spark: SparkSession, gold_path: str) -> DataFrame:
    """Rows per Gold table."""
    counts = [
        load_artifact(spark, gold_path, name).agg(F.lit(name).alias("artifact"), F.count("*").alias("records"))
        for name in ARTIFACTS
    ]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out
