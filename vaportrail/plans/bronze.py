"""Raw files to the Bronze table."""

from itertools import batched

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaportrail import schemas
from vaportrail.sources import archives, ledger, tables, traces

FILES_PER_COMMIT = 1000


def ingest_archives(
    spark: SparkSession, folder: str, bronze_path: str, pattern: str = "*.csv*", files_per_commit: int = FILES_PER_COMMIT
) -> DataFrame:
    """Stores every new archive of a folder; one report row per file, with the error of each unreadable one.

    Files stored by an earlier run are not read again, on whatever day that was; the ledger knows them. Files are stored
    ``files_per_commit`` at a time, so the driver holds no more paths than that, and a killed ingest loses no more work.
    """
    ledger.recover(spark, bronze_path)
    fresh = ledger.not_done(ledger.listing(spark, folder, pattern), spark, bronze_path).orderBy("path")
    runs = []
    for files in batched(fresh.toLocalIterator(), files_per_commit):
        runs.append(ledger.begin(spark.createDataFrame(files, fresh.schema), bronze_path))
        batch = archives.open_files(spark, [f["path"] for f in files])
        if batch.bronze is not None:
            tables.append_bronze(batch.bronze, bronze_path)
        ledger.finish(spark, bronze_path, runs[-1], batch.signatures, batch.errors)
    return ledger.report(spark, bronze_path, runs)


def ingest_traces(spark: SparkSession, folder: str, bronze_path: str, date: str | None = None) -> DataFrame:
    """Stores the trace files of a folder; one row: files processed, files failed, points.

    Files stored by an earlier run are not decoded again. Counts come from the stored table.
    """
    files = traces.list_traces(spark, folder)
    named = traces.trace_names(files, date)
    dated = F.lit(True) if date else traces.dated_path(F.col("path"))
    fresh = tables.not_stored(spark, bronze_path, named, dated).select("path")
    tables.append_bronze(traces.decode_traces(files.join(fresh, "path", "left_semi"), date), bronze_path)
    dates = [r["date"] for r in named.select("date").distinct().collect()]
    stored = tables.read_table(spark, bronze_path, schemas.BRONZE).where(F.col("date").isin(dates))
    return traces.trace_stats(files, stored, date)
