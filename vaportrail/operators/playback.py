"""Where flights were at many moments: one sorted sweep over points and moments together.

Points and moments of a flight are put in one time order. The last point before and the first point after each moment are
carried along that order, so the cost grows with points plus moments, not with their product. A flight's time is cut into
slices, and what stands at a slice's edges is carried over, so no window holds more than a slice of one flight. Flights that are under
way at none of the moments are left out before their points are unpacked.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaportrail.defaults import PLAYBACK_SLICE_SEC
from vaportrail.functions.geo import initial_bearing
from vaportrail.session import stage

FIELDS = ["ts", "lat", "lon", "alt_ft", "heading_deg"]


def between_points(before: Column, after: Column, t: Column) -> dict[str, Column]:
    """Position at ``t`` between two points: linear, heading along the line; on a point, that point as stored."""
    moving = before["ts"] < after["ts"]
    share = (t - before["ts"]) / (after["ts"] - before["ts"])
    at = {c: F.when(moving, before[c] + (after[c] - before[c]) * share).otherwise(before[c]) for c in ("lat", "lon", "alt_ft")}
    bearing = initial_bearing(before["lat"], before["lon"], after["lat"], after["lon"])
    return at | {"heading_deg": F.when(moving, bearing).otherwise(before["heading_deg"])}


def spans(flights: DataFrame) -> DataFrame:
    """(flight_id, first, last) of every flight with points, which are in time order."""
    stamps = F.col("points.ts")  # the only column of the points that is read
    first, last = F.get(stamps, F.lit(0)), F.try_element_at(stamps, F.lit(-1))
    return flights.where(F.size(stamps) > 0).select("flight_id", first.alias("first"), last.alias("last"))


def moments_of(flight_spans: DataFrame, moments: DataFrame, slice_sec: int) -> DataFrame:
    """(flight_id, t) of the moments ``t`` within each flight's span. Flights meet moments slice by slice."""
    cut = lambda x: F.floor(x / slice_sec)
    slices = F.explode(F.sequence(cut(F.col("first")), cut(F.col("last"))))
    active = flight_spans.select("*", slices.alias("slice"))
    timed = moments.select(F.col("t").cast("double").alias("t")).where("t is not null").distinct()
    timed = timed.withColumn("slice", cut(F.col("t")))
    met = active.join(timed, "slice").where((F.col("t") >= F.col("first")) & (F.col("t") <= F.col("last")))
    return met.select("flight_id", "t")


def playback(flights: DataFrame, moments: DataFrame, slice_sec: int = PLAYBACK_SLICE_SEC) -> DataFrame:
    """(flight_id, t, lat, lon, alt_ft, heading_deg) of every flight that is under way at each of the ``moments`` (column ``t``).

    Moments may be any number, in any order; repeated ones count once. Flights without points give no row. Reads ``flights`` twice, once for
    the spans alone. What is asked of which flight is stored, so that its size is known when the flights are picked.
    """
    met = stage(moments_of(spans(flights), moments, slice_sec), "moments")
    under_way = flights.join(met.select("flight_id").distinct(), "flight_id", "left_semi")
    point = F.struct(*[F.col(f"p.{c}").alias(c) for c in FIELDS])
    cut = F.floor(F.col("t") / slice_sec).alias("slice")
    seen = under_way.select("flight_id", F.explode("points").alias("p")).select(
        "flight_id", F.col("p.ts").cast("double").alias("t"), F.lit(False).alias("asked"), point.alias("p")
    )
    asked = met.select(
        "flight_id", "t", F.lit(True).alias("asked"), F.lit(None).cast(seen.schema["p"].dataType).alias("p")
    )
    rows = seen.unionByName(asked).select("*", cut)
    own = ["flight_id", "slice"]
    edges = rows.groupBy(*own).agg(F.min_by("p", F.col("p.ts")).alias("first"), F.max_by("p", F.col("p.ts")).alias("last"))
    by_slice = Window.partitionBy("flight_id").orderBy("slice")
    edges = edges.select(
        *own,
        F.last("last", True).over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
        F.first("first", True).over(by_slice.rowsBetween(1, Window.unboundedFollowing)).alias("coming"),
    )
    order = Window.partitionBy(*own).orderBy("t", "asked")
    swept = rows.withColumns(
        {
            "before": F.last("p", True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "after": F.first("p", True).over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    ).where("asked")
    held = swept.join(edges, own).select(
        "flight_id", "t", F.coalesce("before", "carried").alias("before"), F.coalesce("after", "coming").alias("after")
    )
    # a point at the very moment comes before it in the order
    held = held.withColumn("after", F.when(F.col("before.ts") == F.col("t"), F.col("before")).otherwise(F.col("after")))
    at = between_points(F.col("before"), F.col("after"), F.col("t"))
    return held.select("flight_id", "t", *[c.alias(name) for name, c in at.items()])


def frames(start: float, end: float, step: float, spark) -> DataFrame:
    """Moments (``t``) from ``start`` to ``end``, ``step`` seconds apart, for :func:`playback`."""
    n = int((end - start) // step) + 1 if end >= start else 0
    return spark.range(n).select((F.col("id") * float(step) + float(start)).alias("t"))
