"""Stored tables of the three layers: partitioned Parquet with enforced schemas."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vaportrail import schemas
from vaportrail.defaults import BRONZE_ROWS_PER_FILE

# Order of reports as they stood in their source file; see append_bronze.
FILE_ORDER = ["_source_file", "_source_block", "_source_row"]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything stored at ``path``; one request to the file system, no listing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_table(
    df: DataFrame,
    path: str,
    schema: str,
    partition: str | None = "date",
    mode: str = "overwrite",
    only_own_partitions: bool = False,
    sort: list[str] | None = None,
    page_rows: int | None = None,
) -> None:
    """Snappy Parquet in the declared schema, one folder per ``partition`` value, each file sorted by ``sort``.

    Overwriting replaces the table, or with ``only_own_partitions`` just those that ``df`` has rows for. Rows are rebalanced by partition value first:
    small partitions end up in few files, and a partition holding much of the data is split over many tasks. ``page_rows`` bounds the rows of
    a page, for tables of few large rows: readers skip pages by their range of the sort columns where a whole file is one row group.
    """
    rows = schemas.conform(df, schema)
    if partition:
        rows = rows.hint("rebalance", partition)
    if sort:  # lets readers skip row groups by these columns
        rows = rows.sortWithinPartitions(*([partition] if partition else []), *sort)
    writer = rows.write.mode(mode).option("compression", "snappy")
    if page_rows:
        writer = writer.option("parquet.page.row.count.limit", page_rows)
    if partition:
        replaced = "dynamic" if only_own_partitions else "static"
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", replaced)
    writer.parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schemas.struct_type(schema)).parquet(path)


def between_dates(df: DataFrame, start=None, end=None, dates: list | None = None) -> DataFrame:
    """Rows of an inclusive date range, or of the ``dates`` named, pruned to their partitions; missing days are simply absent."""
    if dates is not None:
        df = df.where(F.col("date").isin(dates))
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    return df


def stored_files(spark: SparkSession, path: str, dates: list | None = None) -> DataFrame:
    """(date, _source_file) pairs stored under the given dates, or under all; only those partitions are read."""
    if not exists(spark, path):
        return spark.createDataFrame([], "date date, _source_file string")
    stored = read_table(spark, path, schemas.BRONZE)
    if dates is not None:
        stored = stored.where(F.col("date").isin(dates))
    return stored.select("date", "_source_file").distinct()


def not_stored(spark: SparkSession, path: str, files: DataFrame, dated: Column) -> DataFrame:
    """The rows of ``files`` (date, _source_file, ...) that name no stored file.

    A file whose name holds a date is looked up under it. One without is stored under the day of its ingest, so it is
    looked up by name alone, wherever it lies.
    """
    files = files.withColumn("_dated", dated)
    with_date, without = files.where("_dated").drop("_dated"), files.where("not _dated").drop("_dated")
    dates = [r["date"] for r in with_date.select("date").distinct().collect()]
    fresh = with_date.join(stored_files(spark, path, dates), ["date", "_source_file"], "left_anti")
    named = stored_files(spark, path).select("_source_file").distinct()
    return fresh.unionByName(without.join(named, "_source_file", "left_anti").select(*fresh.columns))


def append_bronze(bronze: DataFrame, path: str, rows_per_file: int = BRONZE_ROWS_PER_FILE) -> None:
    """Adds rows under their dates, straight from the scan, without a shuffle.

    Callers choose whole files that are not stored yet (:func:`not_stored`). Rows keep where they stood in their source
    as two numbers: the block of the file, and the place in the scan.
    """
    (
        schemas.conform(bronze.withColumn("_source_row", F.monotonically_increasing_id()), schemas.BRONZE)
        .write.mode("append")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy("date")
        .parquet(path)
    )


def load_bronze(spark: SparkSession, path: str, date=None, start=None, end=None, dates: list | None = None) -> DataFrame:
    """Bronze rows of one date, a range, the dates named, or all; order by :data:`FILE_ORDER` to keep the first of equal reports."""
    return between_dates(read_table(spark, path, schemas.BRONZE), date or start, date or end, dates)


def load_trajectories(spark: SparkSession, silver: str, start=None, end=None, dates: list | None = None) -> DataFrame:
    return between_dates(read_table(spark, f"{silver}/trajectories", schemas.TRAJECTORY), start, end, dates)


def load_grid(spark: SparkSession, silver: str, start=None, end=None, dates: list | None = None) -> DataFrame:
    return between_dates(read_table(spark, f"{silver}/grid_density", schemas.GRID), start, end, dates)


def load_states(spark: SparkSession, silver: str, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """Cell states per hour and per day."""
    hours = read_table(spark, f"{silver}/cell_hours", schemas.CELL_HOURS)
    days = read_table(spark, f"{silver}/cell_days", schemas.CELL_DAYS)
    return between_dates(hours, start, end), between_dates(days, start, end)


def load_ordered_points(spark: SparkSession, silver: str, start=None, end=None) -> DataFrame:
    """Track points in Z-order; :func:`spatial.in_box` reads only what lies near a box."""
    return between_dates(read_table(spark, f"{silver}/points_by_place", schemas.ORDERED_POINT), start, end)


def load_points(spark: SparkSession, silver: str, start=None, end=None, dates: list | None = None) -> DataFrame:
    """Track points in long form; only the ``points`` column (and the ids) are read."""
    from vaportrail.operators.tracks import explode_points

    return explode_points(load_trajectories(spark, silver, start, end, dates), "flight_id", "date")
