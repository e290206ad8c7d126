"""Session helper and the shared folder used to cut lineage."""

import atexit
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "vaportrail", master: str | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # collecting a flight's points: stream through sorted rows instead of hashing arrays
        "spark.sql.execution.useObjectHashAggregateExec": "false",
        # do not record a Python call site for every Column expression
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **(conf or {}),
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a one-process session may go without one; it then gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="vaportrail-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/vaportrail/{spark.sparkContext.applicationId}"


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_swept: set[str] = set()


def _sweep_at_exit(spark: SparkSession) -> None:
    """Registers the removal of this application's stages at the end of the driver program."""
    root = stage_root(spark)
    if root in _swept:
        return
    _swept.add(root)

    def sweep() -> None:
        if spark.sparkContext._jsc is not None:  # a stopped session has no file system left to ask
            delete_path(spark, root)

    atexit.register(sweep)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For inputs that several passes read: the work is done once, later passes prune columns of a Parquet
    file, and a lost executor costs a re-read rather than a recomputation. What is staged goes when the driver
    program ends, or with :func:`unstage` as soon as nothing reads it any more.
    """
    spark = df.sparkSession
    _sweep_at_exit(spark)
    path = new_stage_path(spark, name)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._stage_path = path
    return staged


def unstage(*staged: DataFrame) -> None:
    """Deletes stages that no later plan reads."""
    for df in staged:
        delete_path(df.sparkSession, df._stage_path)


def together(spark: SparkSession, *jobs: Callable[[], None]) -> None:
    """Runs jobs that do not read each other's output at the same time, so that the last tasks and the file listings of one leave
    no core idle. An error is raised when all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    for job in running:
        job.result()
