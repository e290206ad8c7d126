"""Reports to flights: gap segmentation, fill, regular resampling, per-flight features.

Every window here is keyed by date and aircraft (or a finer key), so one shuffle serves them all. After
de-duplication an aircraft has at most one report per second, hence at most 86,400 rows per date: no window
group grows with the data set.
"""

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from vaportrail.defaults import MAX_GAP_SEC, RESAMPLE_STEP_SEC
from vaportrail.functions.geo import haversine_nm, heading_difference
from vaportrail.operators import flown
from vaportrail.operators.numbering import flight_bases
from vaportrail.functions.text import flight_id
from vaportrail.schemas import POINT

register_pickle_by_value(flown)

AIRCRAFT_DAY = ["date", "icao24"]
FLIGHT = ["date", "icao24", "seg_start"]
# report column -> track point field
MEASURES = {
    "latitude": "lat",
    "longitude": "lon",
    "altitude": "alt_ft",
    "velocity": "speed_kts",
    "heading": "heading_deg",
    "vertical_rate": "vrate_fpm",
}
POINT_FIELDS = ["ts", *MEASURES.values()]

_EVER = (Window.unboundedPreceding, Window.unboundedFollowing)
_SO_FAR = (Window.unboundedPreceding, Window.currentRow)
# per-flight numbers that ride along from reports to points
_CARRIED = ["seg_idx", "flight_no"]


def _carried(df: DataFrame) -> list[str]:
    return [c for c in _CARRIED if c in df.columns]


def segment(reports: DataFrame, max_gap: int = MAX_GAP_SEC) -> DataFrame:
    """Split each aircraft-day where the gap exceeds ``max_gap``; one-report segments are dropped.

    Adds ``seg_start`` (first timestamp) and ``seg_idx`` (0-based number among the kept segments of the aircraft-day).
    """
    by_time = Window.partitionBy(*AIRCRAFT_DAY).orderBy("timestamp")
    so_far = by_time.rowsBetween(*_SO_FAR)
    ts = F.col("timestamp")
    opens = F.coalesce(ts - F.lag(ts).over(by_time) > max_gap, F.lit(True))
    closes = F.coalesce(F.lead(ts).over(by_time) - ts > max_gap, F.lit(True))
    return (
        reports.withColumns({"_opens": opens, "_closes": closes})
        .withColumns(
            {
                "seg_start": F.last(F.when(F.col("_opens"), ts), ignorenulls=True).over(so_far),
                "seg_idx": F.count(F.when(F.col("_opens") & ~F.col("_closes"), 1)).over(so_far) - 1,
            }
        )
        .where(~(F.col("_opens") & F.col("_closes")))
        .drop("_opens", "_closes")
    )


def segment_starts(segmented: DataFrame, *more: Column) -> DataFrame:
    """One row per kept segment."""
    return segmented.where(F.col("timestamp") == F.col("seg_start")).select(*FLIGHT, "seg_idx", *more)


def filled(segmented: DataFrame) -> dict:
    """Each measure with gaps closed: last value so far in the segment, else the segment's first value."""
    flight = Window.partitionBy(*FLIGHT).orderBy("timestamp")
    return {
        c: F.coalesce(
            F.last(c, ignorenulls=True).over(flight.rowsBetween(*_SO_FAR)),
            F.first(c, ignorenulls=True).over(flight.rowsBetween(*_EVER)),
        )
        for c in MEASURES
    }


def fill(segmented: DataFrame) -> DataFrame:
    return segmented.withColumns(filled(segmented))


def _legs(segmented: DataFrame, step: int) -> DataFrame:
    """Each report with the ticks ``_from`` to ``_to`` up to the next one, its values and their slopes; those without a tick are left out.

    Segments shorter than one step keep their reports as they are.
    """
    flight = Window.partitionBy(*FLIGHT).orderBy("timestamp")
    whole = flight.rowsBetween(*_EVER)
    ts, start = F.col("timestamp"), F.col("seg_start")
    rows = segmented.select(
        *FLIGHT,
        *_carried(segmented),
        "timestamp",
        *MEASURES,
        F.first("callsign").over(whole).alias("callsign"),
        F.first("on_ground").over(whole).alias("on_ground"),
        F.lead("timestamp").over(flight).alias("_next_ts"),
        (F.max("timestamp").over(whole) - start < step).alias("_short"),
        *[c.alias(f"_fill_{name}") for name, c in filled(segmented).items()],
    )
    span = F.col("_next_ts") - ts
    slopes = {
        f"_slope_{c}": F.coalesce((F.lead(f"_fill_{c}").over(flight) - F.col(f"_fill_{c}")) / span, F.lit(0.0))
        for c in MEASURES
    }
    until = F.coalesce(F.col("_next_ts") - 1, ts)
    first_tick = F.when(F.col("_short"), ts).otherwise(ts + F.pmod(start - ts, F.lit(step)))
    last_tick = F.when(F.col("_short"), ts).otherwise(until - F.pmod(until - start, F.lit(step)))
    return (
        rows.withColumns({**slopes, "_from": first_tick, "_to": last_tick})
        .where("_from <= _to")
        .select(
            *FLIGHT,
            *_carried(segmented),
            "callsign",
            "on_ground",
            "timestamp",
            *[F.when(F.col("_short"), F.col(c)).otherwise(F.col(f"_fill_{c}")).alias(c) for c in MEASURES],
            *slopes,
            "_from",
            "_to",
        )
    )


def _ticks(first: Column, last: Column, step: int) -> Column:
    return F.sequence(first, last, F.lit(step).cast("bigint"))


def resample(segmented: DataFrame, step: int = RESAMPLE_STEP_SEC) -> DataFrame:
    """Track points every ``step`` seconds from the segment start, linearly interpolated.

    Each report expands to the ticks between it and the next one, so no join is needed. Segments shorter than one
    step keep their reports as they are. Headings are interpolated as plain numbers.
    """
    ticked = _legs(segmented, step).withColumn("ts", F.explode(_ticks(F.col("_from"), F.col("_to"), step)))
    return ticked.select(
        *FLIGHT,
        *_carried(segmented),
        "callsign",
        "on_ground",
        "ts",
        *[
            (F.col(f"_slope_{c}") * (F.col("ts") - F.col("timestamp")) + F.col(c)).alias(field)
            for c, field in MEASURES.items()
        ],
    )


def resampled_tracks(segmented: DataFrame, step: int = RESAMPLE_STEP_SEC) -> DataFrame:
    """:func:`trajectories` of :func:`resample`.

    Reports are gathered and then expanded, so what is sorted grows with the reports, not with the many more points. The
    points of many flights are worked out at a time (:mod:`flown`).
    """
    fields = ["timestamp", "_from", "_to", *MEASURES, *[f"_slope_{c}" for c in MEASURES]]
    gathered = (
        _legs(segmented, step)
        .groupBy(*FLIGHT)
        .agg(
            *[F.first(c).alias(c) for c in _carried(segmented)],
            F.coalesce(F.first("callsign"), F.lit("")).alias("callsign"),
            F.sort_array(F.collect_list(F.struct(*fields))).alias("legs"),
        )
    )
    return _flights_by(flown.expander(step, MEASURES), gathered)


def steps(points: DataFrame, key: list[str] = FLIGHT) -> DataFrame:
    """Adds what happened since the previous point of the flight: distance, turn, and climb / descent starts.

    A turn compares with the last known heading. A missing vertical rate counts as level.
    """
    flight = Window.partitionBy(*key).orderBy("ts")
    earlier = flight.rowsBetween(Window.unboundedPreceding, -1)
    rate = F.coalesce(F.col("vrate_fpm"), F.lit(0.0))
    # one window value each; the formulas below use some of them several times
    before = points.withColumns(
        {
            "_lat": F.lag("lat").over(flight),
            "_lon": F.lag("lon").over(flight),
            "_rate": F.lag(rate).over(flight),
            "_heading": F.last("heading_deg", ignorenulls=True).over(earlier),
        }
    )
    was = F.col("_rate")
    return before.withColumns(
        {
            "step_nm": haversine_nm(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")),
            "turn_deg": heading_difference(F.col("_heading"), F.col("heading_deg")),
            "climb_start": F.coalesce((was <= 0) & (rate > 500), F.lit(False)).cast("int"),
            "descent_start": F.coalesce((was >= 0) & (rate < -500), F.lit(False)).cast("int"),
        }
    ).drop("_lat", "_lon", "_rate", "_heading")


def _flights_by(work, gathered: DataFrame) -> DataFrame:
    """What ``work`` makes of rows that end in a flight's callsign and its legs or points. It is sent along, so executors need no copy of it."""
    kept = [f"{name} {kind}" for name, kind in gathered.dtypes[:-1]]
    return gathered.mapInArrow(work, ", ".join([*kept, f"points array<{POINT}>", flown.FEATURES]))


def trajectories(points: DataFrame) -> DataFrame:
    """One row per flight: its points in time order and its features. A flight is one row by definition."""
    gathered = points.groupBy(*FLIGHT).agg(
        *[F.first(c).alias(c) for c in _carried(points)],
        F.coalesce(F.first("callsign"), F.lit("")).alias("callsign"),
        F.sort_array(F.collect_list(F.struct(*POINT_FIELDS))).alias("points"),
    )
    return _flights_by(flown.summer, gathered)


def with_flight_numbers(segmented: DataFrame) -> DataFrame:
    """Adds ``flight_no`` to segmented reports: flights of a date, counted in aircraft, then time order.

    The join key equals the shuffle key of the windows above, so the reports are not moved again; the other side has
    one slim row per aircraft-day and is hashed partition by partition, never broadcast.

    Both sides come from one scan and one shuffle of the reports: the counting side also needs what a flight is made of,
    by a hash of it, so that its plan up to the shuffle by aircraft-day equals the other's and Spark runs it once.
    """
    whole = F.xxhash64(*[c for c in ("timestamp", "callsign", *MEASURES) if c in segmented.columns]).alias("_whole")
    bases = flight_bases(segment_starts(segmented, whole)).hint("shuffle_hash")
    return (
        segmented.join(bases, AIRCRAFT_DAY)
        .withColumn("flight_no", F.col("base") + F.col("seg_idx"))
        .drop("base", "seg_idx")
    )


def with_flight_ids(numbered: DataFrame) -> DataFrame:
    """Turns ``flight_no`` into the text ``flight_id``. Numbers sort and shuffle cheaper, so this comes last."""
    return numbered.withColumn(
        "flight_id", flight_id(F.col("icao24"), F.col("date"), F.col("flight_no"))
    ).drop("flight_no")


def build_points(reports: DataFrame, max_gap: int = MAX_GAP_SEC, step: int = RESAMPLE_STEP_SEC) -> DataFrame:
    """Clean reports to resampled track points with flight numbers."""
    return resample(with_flight_numbers(segment(reports, max_gap)), step)


def build_trajectories(reports: DataFrame, max_gap: int = MAX_GAP_SEC, step: int = RESAMPLE_STEP_SEC) -> DataFrame:
    """Clean reports to flights with ids; the same as :func:`trajectories` of :func:`build_points`, without a sort of the points."""
    return with_flight_ids(resampled_tracks(with_flight_numbers(segment(reports, max_gap)), step))


def explode_points(flights: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per track point, with the ``keep`` columns of its flight."""
    return flights.select(*keep, F.explode("points").alias("p")).select(*keep, "p.*")
