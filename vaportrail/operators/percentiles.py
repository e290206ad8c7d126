"""Exact percentiles (linear interpolation between order statistics) at any size, of all values or of each group.

All wanted ranks of all groups are narrowed together. Each rank has an interval of values that holds it; one pass counts the
values of every interval in bins, and the bin with the rank becomes the interval. After a few passes little is left of the values
near each rank, and that is sorted. The number of passes does not depend on the number of ranks or groups.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaportrail.session import stage, unstage

BAND = 1_000_000  # values of an interval that are sorted
BINS = 1024
BROADCAST_GROUPS = 10_000


def _ranks(q: float, n: Column) -> tuple[Column, Column, Column]:
    """The two order statistics around a percentile, from 0, and the share of the second."""
    place = F.lit(float(q)) * (n - 1)
    return F.floor(place), F.ceil(place), place - F.floor(place)


def _in_intervals(values: DataFrame, intervals: DataFrame, group: list[str]) -> DataFrame:
    """Each value with each interval (rank, low, high, below, inside) of its group that holds it."""
    fields = ["rank", "low", "high", "below", "inside"]
    held = intervals.groupBy(*group).agg(F.collect_list(F.struct(*fields)).alias("intervals"))  # a few ranks for each group
    if held.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        held = F.broadcast(held)
    inside = F.filter("intervals", lambda i: F.col("x").between(i["low"], i["high"]))
    return values.join(held, group).select(*group, "x", F.explode(inside).alias("i")).select(*group, "x", "i.*")


def _narrowed(values: DataFrame, open_ranks: DataFrame, group: list[str], bins: int) -> DataFrame:
    """One turn: the intervals' bins that hold the ranks. A bin's ends are values, so an interval of two values always splits."""
    half = lambda c: F.col(c) / 2  # noqa: E731  differences of very large numbers stay finite
    share = (half("x") - half("low")) / (half("high") - half("low"))
    placed = _in_intervals(values, open_ranks, group).withColumn(
        "bin", F.least(F.lit(bins - 1), F.floor(share * bins).cast("int"))
    )
    counted = placed.groupBy(*group, "rank", "bin").agg(
        F.first("below").alias("below"), F.count("*").alias("inside"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    # at most ``bins`` rows for each rank
    earlier = Window.partitionBy(*group, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("below", F.col("below") + F.coalesce(F.sum("inside").over(earlier), F.lit(0)))
    holds = (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("inside"))
    return counted.where(holds).select(*group, "rank", "low", "high", "below", "inside")


def group_percentiles(
    df: DataFrame, column: str, qs: list[float], group: list[str], band: int = BAND, bins: int = BINS
) -> DataFrame:
    """(group columns..., n, percentiles): for each group the number of values and their percentiles ``qs`` (0..1), in order.

    Reads ``df`` once a turn: pass a stored table. Null, NaN and infinite values take no part; groups without others give no row. A null
    in the group columns takes no part either.
    """
    x = F.col(column).cast("double")
    values = df.select(*group, x.alias("x")).where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sizes = values.groupBy(*group).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    sizes = stage(sizes, "percentile-sizes")
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(*_ranks(q, F.col("n"))[:2]) for q in qs])))
    ranks = sizes.select(
        *group, F.explode(wanted).alias("rank"), "low", "high", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside")
    )
    ranks = stage(ranks, "percentile-ranks")
    is_open = (F.col("inside") > band) & (F.col("low") < F.col("high"))
    while not (waiting := ranks.where(is_open)).isEmpty():
        narrower = stage(ranks.where(~is_open).unionByName(_narrowed(values, waiting, group, bins)), "percentile-ranks")
        unstage(ranks)
        ranks = narrower
    settled = ranks.where("low = high").select(*group, "rank", F.col("low").alias("x"))
    ordered = Window.partitionBy(*group, "rank").orderBy("x")  # ``band`` rows at most
    near = _in_intervals(values, ranks.where("low < high"), group).withColumn("at", F.row_number().over(ordered) - 1 + F.col("below"))
    found = settled.unionByName(near.where("at = rank").select(*group, "rank", "x"))
    by_rank = found.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def percentile(q: float) -> Column:
        first, second, share = _ranks(q, F.col("n"))
        low, high = F.element_at("at", first), F.element_at("at", second)
        return low + (high - low) * share

    return sizes.join(by_rank, group).select(*group, "n", F.array(*[percentile(q) for q in qs]).alias("percentiles"))


def exact_percentiles(df: DataFrame, column: str, qs: list[float], band: int = BAND) -> list[float | None]:
    """Percentiles ``qs`` (0..1) of a double column of a stored table; None where it has no values."""
    found = group_percentiles(df.select(F.lit(0).alias("all"), column), column, qs, ["all"], band).first()
    return [None] * len(qs) if found is None else found["percentiles"]
