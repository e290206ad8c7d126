"""A corpus from raw documents: toxic ones out, near copies out, benchmark leaks out, secrets masked, sources mixed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaportrail.llm import decontaminate, minhash, mixing, secrets, toxicity
from vaportrail.session import stage


BATCH_ROWS = 1_000  # whole texts that go to a Python worker at a time: it and its executor keep the room of the largest batch
NEAR_COPY_WORDS = 5  # of a shingle; the query op2_near_duplicates by itself takes two


def _small_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of BATCH_ROWS, or of as few as the session already asks for; 0 there is no bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    asked = int(spark.conf.get(name))
    spark.conf.set(name, min(asked, BATCH_ROWS) if asked > 0 else BATCH_ROWS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from labelled documents of this stage's input."""
    _small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(docs, model, prefix="_toxic_").where("_toxic_predicted = 0").select(*docs.columns)


def _told_apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, and the name of a column that tells them apart: the id, or if ids are null or repeated a number.

    Decisions go by row. Numbered rows are stored, so that their numbers stay the same.
    """
    shape = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if shape["rows"] == shape["ids"]:
        return docs, "doc_id"
    name = "row"
    while name in docs.columns:
        name += "_"
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows"), name


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by the sets of their five-word shingles, the row of the smallest id stays, or the first one
    where ids do not tell rows apart.

    Rows with null or repeated ids are judged like all others; texts without words are copies of nothing.
    """
    _small_batches(spark)
    rows, row = _told_apart(docs)
    copies = minhash.near_duplicates(rows, id_col=row, words=NEAR_COPY_WORDS)
    dropped = stage(copies.where(~F.col("kept")).select(row), "pipeline-copies")
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of the benchmark go, whatever their id."""
    rows, row = _told_apart(docs)
    leaks = decontaminate.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    dropped = stage(leaks.select(row).distinct(), "pipeline-leaks")
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked where they stand; every document stays, and its length follows its text."""
    _small_batches(spark)
    found = secrets.scan_versions(docs).where(F.size("findings") > 0)
    # by content, not by id: rows that share an id may have different texts
    finds = stage(found.select(F.col("blob").alias("_blob"), F.col("findings").alias("_findings")).distinct(), "pipeline-secrets")
    marked = docs.withColumn("_own", secrets.address(F.col("text"))).join(finds, F.col("_own") == F.col("_blob"), "left")
    hit = F.col("_findings").isNotNull()
    text = F.when(hit, secrets.redact(F.col("text"), F.col("_findings"))).otherwise(F.col("text"))
    masked = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix: a document once for each time it is taken, with its ``epoch`` and ``epoch_words``."""
    return mixing.take_mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("secrets", mask_secrets),
    ("mix", mix),
]
# the first stage is a trained model
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages; each is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
