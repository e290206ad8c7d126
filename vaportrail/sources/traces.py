"""Per-aircraft trace files (one JSON document per aircraft-day, possibly gzipped) to Bronze rows."""

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaportrail.functions.geo import midnight_epoch
from vaportrail.functions.text import base_name, to_double
from vaportrail.schemas import BRONZE, conform

# File naming, document shape, where seconds-of-day end and epochs start.
TRACE_GLOB = "trace_full_*.json"
DOCUMENT = "icao string, trace array<array<string>>"
RELATIVE_BELOW = 100000
MIN_POINT_FIELDS = 8


@F.pandas_udf(T.StringType())
def _text(content: pd.Series) -> pd.Series:
    """Text of a file, unzipped if needed; null when it cannot be decoded."""

    def decode(data):
        if data is None:
            return None
        try:
            return (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)).decode("utf-8")
        except (OSError, EOFError, zlib.error, UnicodeDecodeError):
            return None

    return content.map(decode)


def _path_date(path: Column) -> Column:
    parts = F.regexp_extract_all(path, F.lit(r"(?<=/)(\d{4}-\d{2}-\d{2})(?=/)"), F.lit(1))
    return F.try_element_at(parts, F.lit(-1)).try_cast("date")


def dated_path(path: Column) -> Column:
    return _path_date(path).isNotNull()


def path_date(path: Column) -> Column:
    """Last path component that is a date; today when there is none."""
    return F.coalesce(_path_date(path), F.current_date())


def list_traces(spark: SparkSession, folder: str) -> DataFrame:
    """Trace files under ``folder`` or, where there is one, its ``traces`` subfolder: path and content."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", TRACE_GLOB).load(folder)
    )
    below = F.col("path").contains(folder.rstrip("/") + "/traces/")
    if files.where(below).select("path").limit(1).count():
        files = files.where(below)
    return files.select("path", "content")


def decode_traces(files: DataFrame, date: str | None = None) -> DataFrame:
    """Bronze rows from (path, content) rows.

    Only the unzipping is Python; the JSON is parsed and taken apart by Spark. A point is dropped when it has too few
    fields or a field that should be a number is not one (``"ground"`` as altitude).
    """
    name = base_name(F.col("path"))
    day = F.lit(date).cast("date") if date else path_date(F.col("path"))
    docs = files.select(
        name.alias("_source_file"), day.alias("date"), F.from_json(_text("content"), DOCUMENT).alias("doc")
    )
    from_name = F.regexp_replace("_source_file", r"trace_full_|~|\.json$", "")
    first_ts = F.get(F.get("doc.trace", F.lit(0)), F.lit(0)).try_cast("double")
    points = docs.select(
        "_source_file",
        "date",
        F.coalesce("doc.icao", from_name).alias("icao24"),
        F.coalesce(first_ts < RELATIVE_BELOW, F.lit(False)).alias("relative"),
        F.explode("doc.trace").alias("p"),
    ).where(F.size("p") >= MIN_POINT_FIELDS)

    def field(i: int) -> Column:
        return F.get("p", F.lit(i))

    seconds = to_double(field(0)).try_cast("bigint")
    numbers = {"latitude": 1, "longitude": 2, "altitude": 3, "velocity": 4, "heading": 5, "vertical_rate": 7}
    readable = seconds.isNotNull()
    for i in numbers.values():
        readable = readable & (field(i).isNull() | to_double(field(i)).isNotNull())
    extra = F.when(field(8).startswith("{"), field(8))
    ground = F.coalesce(field(6).try_cast("double") != 0, ~F.lower(field(6)).isin("false", ""))
    rows = points.where(readable).select(
        "icao24",
        F.coalesce(F.btrim(F.get_json_object(extra, "$.flight"), F.lit(" \t\r\n")), F.lit("")).alias("callsign"),
        (seconds + F.when(F.col("relative"), midnight_epoch(F.col("date"))).otherwise(F.lit(0))).alias("timestamp"),
        *[to_double(field(i)).alias(c) for c, i in numbers.items()],
        F.when(field(6).isNotNull(), ground).alias("on_ground"),
        F.coalesce(F.get_json_object(extra, "$.squawk"), F.lit("")).alias("squawk"),
        "_source_file",
        F.unix_timestamp().alias("_ingest_ts"),
        "date",
    )
    return conform(rows, BRONZE)


def trace_names(files: DataFrame, date: str | None = None) -> DataFrame:
    """(path, _source_file, date) of trace files; an aircraft has a file of the same name in every date's folder."""
    day = F.lit(date).cast("date") if date else path_date(F.col("path"))
    return files.select("path", base_name(F.col("path")).alias("_source_file"), day.alias("date"))


def trace_stats(files: DataFrame, rows: DataFrame, date: str | None = None) -> DataFrame:
    """One row: files that gave points, files that gave none, points. ``rows`` may be the stored table."""
    per_file = rows.groupBy("date", "_source_file").agg(F.count("*").alias("n"))
    return trace_names(files, date).join(per_file, ["date", "_source_file"], "left").agg(
        F.count("n").alias("files_processed"),
        F.count_if(F.col("n").isNull()).alias("files_failed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
    )
