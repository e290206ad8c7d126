"""Consecutive numbers over a sort order without sorting all rows in one task.

Rows are sorted by ranges of the order, which Spark draws so that they are about equal whatever the values look like. Each range
is numbered on its own and counted; what lies before a range is a running sum over one row a range.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaportrail.session import stage

# an increasing id is the number of its partition, then the row in it
ROW_BITS = 33


def flight_bases(starts: DataFrame) -> DataFrame:
    """Per date and aircraft, how many flights of the date belong to smaller aircraft ids.

    Counted per aircraft first, so the window of a date has one row per aircraft seen that day: a 24-bit address
    space is its upper bound, however many reports there are.
    """
    before = Window.partitionBy("date").orderBy("icao24").rowsBetween(Window.unboundedPreceding, -1)
    seen = [F.bit_xor(c).isNotNull() for c in starts.columns if c == "_whole"]  # true; see with_flight_numbers
    counts = starts.groupBy("date", "icao24").agg(F.count("*").alias("n"), *[c.alias("_seen") for c in seen])
    counts = counts.where("_seen") if seen else counts
    return counts.select("date", "icao24", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def in_ranges(df: DataFrame, order: str) -> DataFrame:
    """``df`` stored in ranges of ``order``, with ``range`` and ``place``, the 0-based row in the sorted range."""
    at = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(order).sortWithinPartitions(order)
    numbered = ordered.withColumns({"range": F.shiftright(at, ROW_BITS), "place": at.bitwiseAND(F.lit((1 << ROW_BITS) - 1))})
    return stage(numbered, "numbered")


def range_bases(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds ``base`` to (range, n): the sum of ``n`` over all earlier ranges. There is one row for each range."""
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum(n).over(before), F.lit(0)))


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """Adds ``row_no``, the 0-based position in the order of the unique text column ``order``.

    Reads ``df`` twice, once for a sample of ``order``.
    """
    stored = in_ranges(df, order)
    bases = range_bases(stored.groupBy("range").agg(F.count("*").alias("n"))).drop("n")
    # as many rows as the shuffle has partitions
    numbered = stored.join(F.broadcast(bases), "range").withColumn("row_no", F.col("base") + F.col("place"))
    return numbered.drop("range", "place", "base")
