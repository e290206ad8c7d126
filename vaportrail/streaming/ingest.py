"""Ingest of newly arrived archives: the streaming checkpoint remembers which files were stored.

The same parsing as the batch ingest, for folders whose files share one header.
"""

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vaportrail.session import stage, unstage
from vaportrail.sources import ledger
from vaportrail.sources.archives import to_bronze
from vaportrail.sources.tables import append_bronze


def ingest_new_files(
    spark: SparkSession, folder: str, bronze_path: str, checkpoint: str, columns: list[str], pattern: str = "*.csv*"
) -> StreamingQuery:
    """Starts a query that stores all files not stored before and then ends.

    ``columns`` are the files' header names, in order. Files go through the ledger of the batch ingest: what a failed batch
    had stored is taken out before it is repeated, and each file is stored once, next to those of the batch ingest.
    """
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (
        spark.readStream.schema(text)
        .option("header", True)
        .option("pathGlobFilter", pattern)
        .option("enforceSchema", False)
        .csv(folder)
    )

    def store(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        ledger.recover(session, bronze_path)
        batch = batch.persist(StorageLevel.DISK_ONLY)  # read for its files, then for its rows
        files = batch.select(F.col("_source_file").alias("source_file"), "date").distinct()
        fresh = stage(ledger.not_done(files, session, bronze_path), "stream-files")
        if not fresh.isEmpty():
            run = ledger.begin(fresh, bronze_path)
            append_bronze(batch.join(fresh.select(F.col("source_file").alias("_source_file")), "_source_file", "left_semi"), bronze_path)
            ledger.finish(session, bronze_path, run, {}, {})
        batch.unpersist()
        unstage(fresh)

    return (
        to_bronze(raw)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
