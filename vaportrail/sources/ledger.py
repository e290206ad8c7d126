"""The ingest ledger: which files a Bronze table holds, kept in a small table inside its folder.

A file is entered as ``begun`` before its rows are appended and as ``done`` (or ``failed``) afterwards. What an ingest that was
killed in between has left behind is taken out again before the next one starts, so every file is stored once or not at
all. Looking up files costs a read of the ledger, not of Bronze.
"""

import time
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaportrail import schemas
from vaportrail.functions.text import base_name, file_date
from vaportrail.session import delete_path, stage, unstage
from vaportrail.sources import tables

LEDGER = (
    "source_file string, date date, path string, bytes bigint, modified timestamp, signature string, status string, run string, "
    "at bigint, total_rows bigint, malformed_rows bigint, rows_without_id bigint, error string"
)
COUNTS = ["total_rows", "malformed_rows", "rows_without_id"]
FOLDER = "_ledger"  # readers of Bronze pass folders with a leading underscore by


def _where(bronze_path: str) -> str:
    return f"{bronze_path}/{FOLDER}"


def entries(spark: SparkSession, bronze_path: str) -> DataFrame:
    if not tables.exists(spark, _where(bronze_path)):
        return spark.createDataFrame([], schemas.struct_type(LEDGER))
    return spark.read.schema(schemas.struct_type(LEDGER)).parquet(_where(bronze_path))


def enter(rows: DataFrame, bronze_path: str) -> None:
    schemas.conform(rows, LEDGER).coalesce(1).write.mode("append").parquet(_where(bronze_path))


def adopt(spark: SparkSession, bronze_path: str) -> None:
    """Enters the files of a Bronze table that was written without a ledger; one scan, the first time only."""
    if tables.exists(spark, bronze_path) and not tables.exists(spark, _where(bronze_path)):
        stored = file_counts(tables.read_table(spark, bronze_path, schemas.BRONZE))
        enter(stored.withColumns({"status": F.lit("done"), "run": F.lit("adopted"), "at": F.unix_timestamp()}), bronze_path)


def file_counts(bronze: DataFrame) -> DataFrame:
    """Rows per source file and date, malformed ones among them, and rows without an aircraft id."""
    return bronze.groupBy(F.col("_source_file").alias("source_file"), "date").agg(
        F.count("*").alias("total_rows"),
        F.count_if("_malformed").alias("malformed_rows"),
        F.count_if(F.col("icao24").isNull()).alias("rows_without_id"),
    )


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, source_file, date, bytes, modified) of the files in ``folder`` that match; no contents are read.

    The scan passes empty files by, so names come from Spark's file index.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    names = spark.createDataFrame([(unquote(path),) for path in found.inputFiles()], "path string")
    sized = found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    name = base_name(F.col("path"))
    listed = names.join(sized, "path", "left").fillna(0, ["bytes"])
    return listed.select("path", name.alias("source_file"), file_date(name).alias("date"), "bytes", "modified")


def not_done(files: DataFrame, spark: SparkSession, bronze_path: str, name: str = "source_file") -> DataFrame:
    """The rows of ``files`` that name no stored file, on whatever day that was stored."""
    done = entries(spark, bronze_path).where("status = 'done'").select(F.col("source_file").alias(name)).distinct()
    return files.join(done, name, "left_anti")


def _pending(spark: SparkSession, bronze_path: str) -> DataFrame:
    """(source_file, date) of files that a killed run began."""
    held = entries(spark, bronze_path)
    closed = held.where("status <> 'begun'").select("run", "source_file")
    return held.where("status = 'begun'").join(closed, ["run", "source_file"], "left_anti").select("run", "source_file", "date")


def recover(spark: SparkSession, bronze_path: str) -> int:
    """Takes rows of unfinished runs out of Bronze; the number of files concerned.

    Only partitions that hold such rows are written anew. An ingest calls this first; two must not run on one table at a time.
    """
    adopt(spark, bronze_path)
    pending = _pending(spark, bronze_path)
    if not tables.exists(spark, bronze_path) or pending.isEmpty():
        return 0
    pending = stage(pending, "ledger-pending")
    dates = [r["date"] for r in pending.select("date").distinct().collect()]
    names = pending.select(F.col("source_file").alias("_source_file"), "date").distinct()
    stored = tables.read_table(spark, bronze_path, schemas.BRONZE).where(F.col("date").isin(dates))
    torn = [r["date"] for r in stored.join(names, ["_source_file", "date"], "left_semi").select("date").distinct().collect()]
    if torn:
        rest = stored.where(F.col("date").isin(torn)).join(names, ["_source_file", "date"], "left_anti")
        rest = stage(schemas.conform(rest, schemas.BRONZE), "ledger-rest")
        kept = {r["date"] for r in rest.select("date").distinct().collect()}
        if kept:
            tables.write_table(rest, bronze_path, schemas.BRONZE, only_own_partitions=True, sort=tables.FILE_ORDER)
        for date in set(torn) - kept:
            delete_path(spark, f"{bronze_path}/date={date}")
        unstage(rest)
    n = pending.count()
    undone = pending.withColumns({"status": F.lit("failed"), "at": F.unix_timestamp(), "error": F.lit("the ingest was cut short")})
    enter(undone, bronze_path)
    unstage(pending)
    return n


def begin(files: DataFrame, bronze_path: str, run: str | None = None) -> str:
    """Enters files (source_file, date, ...) that are about to be stored; the run's name."""
    run = run or f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
    enter(files.withColumns({"status": F.lit("begun"), "run": F.lit(run), "at": F.unix_timestamp()}), bronze_path)
    return run


def finish(spark: SparkSession, bronze_path: str, run: str, signatures: dict[str, str], errors: dict[str, str]) -> None:
    """Closes a run's files with what Bronze holds of them; ``signatures`` and ``errors`` go by file name."""
    begun = entries(spark, bronze_path).where((F.col("run") == run) & (F.col("status") == "begun"))
    begun = begun.drop("status", "signature", "error", "at", *COUNTS)
    said = [(n, signatures.get(n), errors.get(n)) for n in {*signatures, *errors}]
    said = spark.createDataFrame(said, "source_file string, signature string, error string")
    closed = begun.join(said, "source_file", "left")
    counts = spark.createDataFrame([], f"source_file string, date date, {', '.join(f'{c} bigint' for c in COUNTS)}")
    if tables.exists(spark, bronze_path):
        dates = [r["date"] for r in begun.select("date").distinct().collect()]
        stored = tables.read_table(spark, bronze_path, schemas.BRONZE).where(F.col("date").isin(dates))
        own = begun.select(F.col("source_file").alias("_source_file"))
        counts = file_counts(stored.join(own, "_source_file", "left_semi"))
    closed = closed.join(counts.drop("date"), "source_file", "left").fillna(0, COUNTS)
    status = F.when(F.col("error").isNull(), "done").otherwise("failed")
    enter(closed.withColumns({"status": status, "at": F.unix_timestamp()}), bronze_path)


def report(spark: SparkSession, bronze_path: str, runs: Iterable[str]) -> DataFrame:
    """One row per file of the given runs: its date, its counts, and the error of one that was not stored."""
    closed = entries(spark, bronze_path).where(F.col("run").isin(list(runs)) & F.col("status").isin("done", "failed"))
    return closed.select("source_file", "date", *COUNTS, "error")


def by_date(spark: SparkSession, bronze_path: str) -> DataFrame:
    """(date, files, newest, rows) of what is stored: number of files, when the last came in, and their rows."""
    done = entries(spark, bronze_path).where("status = 'done'")
    return done.groupBy("date").agg(
        F.count("*").alias("files"), F.max("at").alias("newest"), F.sum("total_rows").alias("rows")
    )
