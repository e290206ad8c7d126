"""Track points in Z-order: a box query reads a few ranges of keys instead of whole days.

Latitude and longitude are cut into fine steps, and the bits of the two step numbers are interleaved to one key. Points
stored in order of that key keep neighbours in the same row groups, whose minimum and maximum key let a scan skip the others.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 13  # of each step number
STEPS_PER_DEGREE = 16  # 5,760 steps around the globe
BOX_CELLS = 8  # a box is covered by about so many squares each way


def _step(x: Column, lowest: float) -> Column:
    """Number of the step that holds ``x``; what lies outside goes to the first or last one, missing values to the first."""
    number = F.floor((x - lowest) * STEPS_PER_DEGREE)
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), number)), F.lit(0)).cast("int")


def z_key(lat: Column, lon: Column) -> Column:
    """Interleaved bits of the two step numbers, latitude above longitude."""
    bit = lambda x, i: F.shiftright(x, i).bitwiseAND(F.lit(1))
    y, x = _step(lat, -90.0), _step(lon, -180.0)
    parts = [F.shiftleft(bit(v, i), 2 * i + above) for i in range(BITS) for v, above in ((y, 1), (x, 0))]
    key = parts[0]
    for part in parts[1:]:
        key = key.bitwiseOR(part)
    return key


def interleave(y: int, x: int) -> int:
    return sum((y >> i & 1) << 2 * i + 1 | (x >> i & 1) << 2 * i for i in range(BITS))


def key_ranges(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> list[tuple[int, int]]:
    """Ranges of keys, both ends included, that hold every point of a box, edges included; a little around it too."""

    def steps(low: float, high: float, lowest: float) -> tuple[int, int]:
        number = lambda v: min((1 << BITS) - 1, max(0, int((v - lowest) * STEPS_PER_DEGREE // 1)))
        return number(low), number(high)

    (y0, y1), (x0, x1) = steps(min_lat, max_lat, -90.0), steps(min_lon, max_lon, -180.0)
    level = 0
    while max(y1 - y0, x1 - x0) >> level >= BOX_CELLS:
        level += 1

    def squares() -> Iterator[int]:
        for y in range(y0 >> level, (y1 >> level) + 1):
            for x in range(x0 >> level, (x1 >> level) + 1):
                yield interleave(y, x) << 2 * level

    ranges: list[tuple[int, int]] = []
    for first in sorted(squares()):
        last = first + (1 << 2 * level) - 1
        if ranges and ranges[-1][1] == first - 1:
            ranges[-1] = ranges[-1][0], last
        else:
            ranges.append((first, last))
    return ranges


def in_box(points: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> DataFrame:
    """Points of a Z-ordered table (column ``z_key``) inside a box, edges included. The key ranges reach the scan."""
    held = F.lit(False)
    for low, high in key_ranges(min_lat, max_lat, min_lon, max_lon):
        held = held | F.col("z_key").between(low, high)
    exact = F.col("lat").between(min_lat, max_lat) & F.col("lon").between(min_lon, max_lon)
    return points.where(held & exact)


def planes_in_box(
    points: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float, flight: tuple[str, ...] = ("flight_id",)
) -> DataFrame:
    """Flights with a point inside the box and the altitude at the first such point."""
    inside = in_box(points, min_lat, max_lat, min_lon, max_lon)
    return inside.groupBy(*flight).agg(F.min_by("alt_ft", "ts").alias("alt_ft"))
