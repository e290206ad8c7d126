"""Secret scans over a ledger of text blobs.

Every version of every file is addressed by the SHA-256 of its content. The ledger remembers which rule versions a blob
has been scanned with and what they found, so a scan reads only blobs or rules that are new, and findings reach every
path and version that holds the blob by a join.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaportrail.llm.words import in_slices
from vaportrail.session import new_stage_path, stage


class Rule(NamedTuple):
    """A pattern whose matches, from the left and not overlapping, are findings if ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = [
    # fixed values: the three base kinds, in the order in which equal starts are listed
    Rule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    # a run of 32 or more is always a whole run, and shorter ones are no findings: skip them while searching
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
    # beyond the base kinds: private keys in PEM armour
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
]
# a finding names the rule, with its version, that found it
LEDGER = "blob string, rules array<string>, findings array<struct<start:long,rule:string,stop:long>>"


def find_spans(text: str, rule: Rule) -> list[dict]:
    matches = re.compile(rule.pattern, re.ASCII).finditer(text)  # compiled once: the module remembers patterns
    spans = [(m.start(), m.end()) for m in matches if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [{"start": start, "rule": rule.key, "stop": stop} for start, stop in spans]


def _scan_blobs(blobs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One ledger row per blob: the rules of its ``todo`` and what they found."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key = {r.key: r for r in rules}
        names = ["blob", "rules", "findings"]
        kind = pa.struct([("start", pa.int64()), ("rule", pa.string()), ("stop", pa.int64())])
        for batch in in_slices(batches):
            findings = []
            for text, todo in zip(batch.column(1), batch.column(2), strict=True):
                text = text.as_py() or ""
                findings.append([span for key in todo.as_py() for span in find_spans(text, by_key[key])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(findings, pa.list_(kind))], names=names)

    return blobs.select("blob", "text", "todo").mapInArrow(scan, LEDGER)


def address(text: Column) -> Column:
    """Content address; a null text is the empty blob."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def update_ledger(
    versions: DataFrame, ledger: str, key_col: str, text_col: str = "text", rules: list[Rule] = RULES
) -> DataFrame:
    """Scans what the ledger has not seen, appends it, and returns (key, blob) of all versions.

    Of equal blobs one version's text is read for the scan: the one with the smallest key. Blobs the ledger knows under
    all given rules are not scanned again. Texts move once, by blob and key, so copies of one text are not gathered.
    """
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(r.key) for r in rules])
    keyed = versions.select(versions[key_col].alias("key"), address(versions[text_col]).alias("blob"))
    addressed = stage(keyed, "secrets-versions")
    firsts = addressed.groupBy("blob").agg(F.min("key").alias("key"))
    seen = (
        spark.read.schema(LEDGER)
        .parquet(ledger)
        .select("blob", F.explode("rules").alias("rule"))
        .groupBy("blob")
        .agg(F.collect_set("rule").alias("seen"))
        if _exists(spark, ledger)
        else spark.createDataFrame([], "blob string, seen array<string>")
    )
    todo = (
        firsts.join(seen, "blob", "left")
        .withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
        .where(F.size("todo") > 0)
        .select("blob", "key", "todo")
    )
    texts = versions.select(
        versions[key_col].alias("key"), versions[text_col].alias("text"), address(versions[text_col]).alias("blob")
    )
    on = (texts["blob"] == todo["blob"]) & texts["key"].eqNullSafe(todo["key"])
    unseen = texts.join(todo, on).select(texts["blob"], "text", "todo")
    _scan_blobs(unseen, rules).write.mode("append").parquet(ledger)
    return addressed


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def blob_findings(spark, ledger: str, rules: list[Rule] = RULES) -> DataFrame:
    """(blob, findings) of blobs with findings of the given rules in their given versions, once each, by start and kind.

    A blob may have several ledger rows: one for each time that rules were new, or repeats from equal rows of input.
    """
    order, kinds = F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(r.kind) for r in rules])
    number = (F.array_position(order, F.col("f.rule")) - 1).cast("int")
    return (
        spark.read.schema(LEDGER)
        .parquet(ledger)
        .where(F.size("findings") > 0)
        .select("blob", F.explode("findings").alias("f"))
        .where(F.array_contains(order, F.col("f.rule")))
        .select("blob", "f.start", number.alias("kind_no"), F.get(kinds, number).alias("kind"), "f.stop")
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set(F.struct("start", "kind_no", "kind", "stop"))).alias("findings"))
    )


def scan_versions(
    versions: DataFrame, key_col: str = "doc_id", text_col: str = "text", ledger: str | None = None, rules: list[Rule] = RULES
) -> DataFrame:
    """(key, blob, findings) of every row: spans in code points, by start, then kind; empty where nothing was found.

    ``ledger`` is the folder of the ledger; without one, a new ledger is begun in the shared folder. A rule changes its
    version whenever its pattern changes.

    Null texts are the empty blob, null keys and repeated rows come out as they came in, an empty table gives none; other
    columns are ignored. Texts are scanned whole, whatever their length.
    """
    spark = versions.sparkSession
    ledger = ledger or new_stage_path(spark, "secrets-ledger")
    addressed = update_ledger(versions, ledger, key_col, text_col, rules)
    found = blob_findings(spark, ledger, rules)
    none = F.array().cast(found.schema["findings"].dataType)
    return addressed.join(found, "blob", "left").select(
        F.col("key").alias(key_col), "blob", F.coalesce("findings", none).alias("findings")
    )


def spans_text(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(
        F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ","
    )


def redact(text: Column, findings: Column, mask: str = "[secret]") -> Column:
    """The text with every finding masked; overlapping findings become one mask."""
    none = F.array().cast("array<struct<start:long,stop:long>>")
    joined = F.aggregate(
        findings,
        none,
        lambda done, f: F.when(
            (F.size(done) > 0) & (f["start"] < F.element_at(done, -1)["stop"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1)["start"].alias("start"),
                        F.greatest(F.element_at(done, -1)["stop"], f["stop"]).alias("stop"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(f["start"].alias("start"), f["stop"].alias("stop"))))),
    )
    last_first = F.reverse(joined)
    length = F.length(text)
    return F.aggregate(
        last_first,
        text,
        lambda t, f: F.concat(
            F.substring(t, F.lit(1), f["start"].cast("int")),
            F.lit(mask),
            F.substring(t, (f["stop"] + 1).cast("int"), length + F.length(F.lit(mask)) * F.size(joined)),
        ),
    )
