"""Training window, model registry, version history, index of dates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaportrail.defaults import TRAINING_DAYS
from vaportrail.functions.text import flight_date_text
from vaportrail.operators.anomaly import MODEL_ID, MODEL_VERSION

# Forecast model identity, placeholder quality of the outlier model.
FORECAST_MODEL_ID = "traj_pred_001"
PLACEHOLDER_AUC = 0.85


def training_window(dated: DataFrame, days: int = TRAINING_DAYS) -> DataFrame:
    """One row: the last ``days`` days up to the latest date, not before the first date."""
    return (
        dated.agg(F.min("date").alias("first"), F.max("date").alias("training_end"))
        .where(F.col("training_end").isNotNull())
        .select(F.greatest(F.date_sub("training_end", days - 1), "first").alias("training_start"), "training_end")
        .withColumn("training_days", F.datediff("training_end", "training_start") + 1)
    )


def model_metadata(
    window: DataFrame, trained_at: Column, with_detector: bool = True, version: str = MODEL_VERSION
) -> DataFrame:
    """Registry rows of the models trained on ``window``."""
    nothing = F.lit(None).cast("double")
    models = [(FORECAST_MODEL_ID, "trajectory", nothing)]
    if with_detector:
        models.append((MODEL_ID, "anomaly", F.lit(PLACEHOLDER_AUC)))
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("model_id"), F.lit(kind).alias("model_type"), auc.alias("auc_roc"))
            for i, kind, auc in models
        ]
    )
    return window.select("*", F.inline(rows)).select(
        "model_id",
        "model_type",
        F.lit(version).alias("version"),
        trained_at.alias("trained_at"),
        F.col("training_start").alias("training_window_start"),
        F.col("training_end").alias("training_window_end"),
        F.col("training_days").cast("int").alias("training_days"),
        nothing.alias("validation_mae"),
        nothing.alias("validation_rmse"),
        "auc_roc",
    )


def next_version(models: DataFrame, history: DataFrame | None, run_date: Column, trained_at: Column) -> DataFrame:
    """The version row of a run: one more than the highest so far."""
    last = F.lit(0)
    if history is not None:
        last = F.coalesce(history.agg(F.max("model_version")).scalar(), F.lit(0))
    number = (last + 1).cast("int")
    return models.agg(
        F.min("training_window_start").alias("training_start"),
        F.max("training_window_end").alias("training_end"),
        # registration order: forecast model first
        F.reverse(F.sort_array(F.collect_set("model_id"))).alias("models"),
    ).select(
        F.format_string("v%s--%03d", F.date_format(run_date, "yyyyMMdd"), number).alias("data_version"),
        number.alias("model_version"),
        "training_start",
        "training_end",
        trained_at.alias("last_trained"),
        "models",
    )


def date_index(predictions: DataFrame) -> DataFrame:
    """One row: the distinct dates named in flight ids, first and last of them."""
    dates = predictions.select(flight_date_text(F.col("flight_id")).alias("d")).where("d is not null").distinct()
    return dates.agg(
        F.sort_array(F.collect_list("d")).alias("available_dates"),
        F.min("d").alias("first_date"),
        F.max("d").alias("last_date"),
    )


def latest_data_version(history: DataFrame) -> Column:
    return history.agg(F.max_by("data_version", "model_version")).scalar()


def stamped(df: DataFrame, history: DataFrame) -> DataFrame:
    """Adds the current ``data_version`` to every row."""
    return df.withColumn("data_version", latest_data_version(history))
