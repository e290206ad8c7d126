"""Row validity, range filters and de-duplication of state vectors."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaportrail.defaults import ALT_RANGE, LAT_RANGE, LON_RANGE, SPEED_RANGE

REPORT = ["date", "icao24", "timestamp"]


def located() -> Column:
    """Position and time are present."""
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("timestamp").isNotNull()


def valid_report() -> Column:
    """Position and time present and in range; altitude and speed in range when present.

    The range tests on latitude and longitude also reject NaN. All but the altitude's and speed's test for NaN reach the Parquet scan.
    """
    altitude, speed = F.col("altitude"), F.col("velocity")
    return (
        F.col("icao24").isNotNull()
        & located()
        & F.col("latitude").between(*LAT_RANGE)
        & F.col("longitude").between(*LON_RANGE)
        & (altitude.isNull() | F.isnan(altitude) | altitude.between(*ALT_RANGE))
        & (speed.isNull() | F.isnan(speed) | speed.between(*SPEED_RANGE))
    )


def keep_first(df: DataFrame, order: list[str], keys: list[str] = REPORT) -> DataFrame:
    """First row per key in ``order``.

    The rank filter becomes a per-task group limit before the shuffle, so copies of one report collapse where
    they are read, and the shuffle on the full key spreads the reports of a busy aircraft.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def clean_reports(bronze: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Valid reports, one per aircraft and second. Filters run before the choice of the first row."""
    order = order or ["_source_file"]
    return keep_first(bronze.where(valid_report()), order).drop("_source_block", "_source_row", "_malformed")


def rejection() -> Column:
    """Why a report is left out: the first of its faults, null for a valid one."""
    altitude, speed = F.col("altitude"), F.col("velocity")
    outside = lambda c, bounds: ~(c.isNull() | F.isnan(c) | c.between(*bounds))
    missing = lambda c: c.isNull() | F.isnan(c)
    return (
        F.when(F.col("icao24").isNull(), "no aircraft id")
        .when(F.col("timestamp").isNull(), "no time")
        .when(missing(F.col("latitude")) | missing(F.col("longitude")), "no position")
        .when(~(F.col("latitude").between(*LAT_RANGE) & F.col("longitude").between(*LON_RANGE)), "position out of range")
        .when(outside(altitude, ALT_RANGE), "altitude out of range")
        .when(outside(speed, SPEED_RANGE), "speed out of range")
    )


def quarantine(bronze: DataFrame) -> DataFrame:
    """Reports left out by :func:`valid_report`, counted by date and reason."""
    faulty = bronze.select("date", rejection().alias("reason")).where("reason is not null")
    return faulty.groupBy("date", "reason").agg(F.count("*").alias("rows"))


def retention(bronze: DataFrame) -> DataFrame:
    """Rows in, rows kept and percentage kept per date, from one pass that pre-aggregates by report."""
    reports = bronze.groupBy(*REPORT).agg(
        F.count("*").alias("rows"), F.max(F.when(valid_report(), 1).otherwise(0)).alias("kept")
    )
    return (
        reports.groupBy("date")
        .agg(F.sum("rows").alias("rows_in"), F.sum("kept").alias("rows_out"))
        .withColumn("retained_pct", F.col("rows_out") * 100.0 / F.col("rows_in"))
    )
