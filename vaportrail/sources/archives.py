"""Position archives: CSV, gzipped CSV and Parquet files to Bronze rows."""

import csv
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaportrail.functions.text import file_date
from vaportrail.schemas import BRONZE, conform
from vaportrail.sources import ledger
from vaportrail.sources.columns import normalise

PEEK_THREADS = 16
CORRUPT = "_corrupt_record"
# one file a task, one line a batch, and files that cannot be unzipped give no line
HEADER_CONF = {
    "spark.sql.files.maxPartitionBytes": str(1 << 34),
    "spark.sql.files.openCostInBytes": str(1 << 34),
    "spark.sql.files.ignoreCorruptFiles": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
}


def archive_format(path: str) -> str:
    """``csv`` or ``parquet`` by suffix; other suffixes raise ``ValueError``."""
    name = os.path.basename(path.rstrip("/")).lower()
    if name.endswith(".parquet"):
        return "parquet"
    if name.endswith(".csv") or name.endswith(".csv.gz"):
        return "csv"
    if name.endswith(".gz") and "." not in name[:-3]:
        return "csv"
    raise ValueError(f"unsupported file format: {name}")


def read_archive(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of archives that share one header. CSV values stay text, so an id like 000123 keeps its zeros.

    With the header's ``columns`` given, ``_corrupt_record`` holds CSV lines that have more or fewer fields.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = {archive_format(p) for p in paths}
    if len(kinds) != 1:
        raise ValueError("archives of one read must have one format")
    if kinds == {"parquet"}:
        return spark.read.parquet(*paths)
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if columns is None:
        return reader.csv(paths)
    fields = [T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]]
    return reader.schema(T.StructType(fields)).option("columnNameOfCorruptRecord", CORRUPT).csv(paths)


def to_bronze(raw: DataFrame) -> DataFrame:
    """Bronze rows with lineage: source file, block, ingest time, the date named by the file, malformed or not.

    A malformed line keeps the fields it has in their places: surplus ones are cut, missing ones are null.
    """
    malformed = F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)
    tagged = raw.withColumns(
        {
            "_source_file": F.col("_metadata.file_name"),
            "_source_block": F.col("_metadata.file_block_start"),
            "_malformed": malformed,
        }
    ).withColumns({"date": file_date(F.col("_source_file")), "_ingest_ts": F.unix_timestamp()})
    lineage = ["_source_file", "_source_block", "_malformed", "_ingest_ts", "date"]
    return conform(normalise(tagged.drop(CORRUPT), keep=lineage), BRONZE)


def list_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths in ``folder`` that match ``pattern``, empty files included; a listing only, no contents are read."""
    return sorted(r["path"] for r in ledger.listing(spark, folder, pattern).select("path").toLocalIterator())


def header_columns(line: str) -> list[str]:
    """The column names of a header line as the CSV reader makes them: nameless ones by place, repeated ones with it."""
    names = next(csv.reader([line.removeprefix("\ufeff")]), [])
    folded = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if folded.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def csv_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, line) of the first line of each CSV file that has one and can be read: one job, on the executors.

    Every file is a task of its own that ends with its first line, so no more than a buffer of it is read.
    """
    peek = spark.newSession()
    for key, value in HEADER_CONF.items():
        peek.conf.set(key, value)
    lines = peek.read.text(paths).select(
        F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and batch.column(1)[0].as_py():
                return  # a later part of a very large file
            for row in range(batch.num_rows):
                if batch.column(2)[row].as_py().strip():
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(2).slice(row, 1)], names=["source_file", "line"])
                    return

    return lines.mapInArrow(first, "source_file string, line string")


@dataclass
class Batch:
    """Archives ready to read as one DataFrame, and the files that are not."""

    bronze: DataFrame | None
    files: list[str] = field(default_factory=list)
    signatures: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)


def _parquet_columns(spark: SparkSession, paths: list[str]) -> dict[str, list[str] | Exception]:
    """The columns of Parquet archives, from their footers, a few at a time."""

    def footer(path: str):
        try:
            return path, read_archive(spark, path).columns
        except Exception as e:  # any unreadable file must not stop the others
            return path, e

    with ThreadPoolExecutor(PEEK_THREADS) as pool:
        return dict(pool.map(footer, paths))


def open_files(spark: SparkSession, paths: list[str]) -> Batch:
    """One Bronze DataFrame over all files.

    Headers are looked at first: of CSV files by one job. Files with equal headers are then one scan, because a scan names all columns
    by the first file's header. A file whose header cannot be read is reported, not raised.
    """
    by_kind: dict[str, list[str]] = {"csv": [], "parquet": []}
    batch = Batch(None)
    for path in paths:
        try:
            by_kind[archive_format(path)].append(path)
        except ValueError as e:
            batch.errors[os.path.basename(path)] = str(e)
    groups: dict[tuple, list[str]] = {}
    if by_kind["csv"]:
        lines = {r["source_file"]: r["line"] for r in csv_headers(spark, by_kind["csv"]).collect()}  # a line for each path given
        for path in by_kind["csv"]:
            name = os.path.basename(path)
            if name in lines:
                groups.setdefault(("csv", *header_columns(lines[name])), []).append(path)
            else:
                batch.errors[name] = "empty or unreadable file"
    for path, columns in _parquet_columns(spark, by_kind["parquet"]).items():
        if isinstance(columns, Exception):
            batch.errors[os.path.basename(path)] = str(columns).split("\n")[0]
        else:
            groups.setdefault(("parquet", *columns), []).append(path)
    for header, files in groups.items():
        batch.files += files
        batch.signatures |= {os.path.basename(f): ",".join(header) for f in files}
    parts = [to_bronze(read_archive(spark, files, list(header[1:]))) for header, files in groups.items()]
    batch.bronze = reduce(DataFrame.unionByName, parts) if parts else None
    return batch


def read_directory(spark: SparkSession, folder: str, pattern: str = "*.csv*") -> Batch:
    return open_files(spark, list_files(spark, folder, pattern))


file_stats = ledger.file_counts
