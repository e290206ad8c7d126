"""Geometry and time as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vaportrail.defaults import GRID_DEG

# Fixed values.
EARTH_RADIUS_NM = 3440.065
KM_PER_NM = 1.852
KM_PER_DEGREE = 111.0
MIN_COS_LAT = 0.001


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in nautical miles."""
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    h = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return F.lit(EARTH_RADIUS_NM) * (F.lit(2.0) * F.atan2(F.sqrt(h), F.sqrt(1 - h)))


def heading_difference(h1: Column, h2: Column) -> Column:
    """Smallest angle between two headings, 0..180."""
    turn = F.abs(h1 - h2) % 360
    return F.least(turn, 360 - turn)


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2, 0..360."""
    dlon, a, b = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    east = F.sin(dlon) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dlon)
    return (F.degrees(F.atan2(east, north)) + 360) % 360


def cell_index(x: Column, resolution: float = GRID_DEG) -> Column:
    """Number of the cell holding ``x``, counted from zero degrees; ties go to the even cell."""
    return F.rint(x / F.lit(resolution)).cast("int")


def cell_centre(index: Column, resolution: float = GRID_DEG) -> Column:
    return index.cast("double") * F.lit(resolution)


def snap_to_grid(x: Column, resolution: float = GRID_DEG) -> Column:
    """Centre of the cell holding ``x``; zero is never negative."""
    return cell_centre(cell_index(x, resolution), resolution)


def hour_of_day(ts: Column) -> Column:
    """UTC hour of an epoch second, whatever the session time zone."""
    return F.pmod(F.floor(ts / 3600), F.lit(24)).cast("int")


def epoch_date(ts: Column) -> Column:
    """UTC date of an epoch second, whatever the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int"))


def midnight_epoch(day: Column) -> Column:
    """Epoch second at which a UTC date starts."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400


def zero_if_missing(x: Column) -> Column:
    return F.coalesce(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def dead_reckon(
    lat: Column, lon: Column, alt: Column, speed_kts: Column, heading_deg: Column, vrate_fpm: Column, horizon: Column
) -> dict[str, Column]:
    """Constant-velocity position after ``horizon`` seconds, as named columns."""
    lat, lon, alt = zero_if_missing(lat), zero_if_missing(lon), zero_if_missing(alt)
    heading = F.radians(zero_if_missing(heading_deg))
    deg_per_sec = zero_if_missing(speed_kts) * KM_PER_NM / (KM_PER_DEGREE * 3600)
    travelled = deg_per_sec * horizon
    shrink = F.greatest(F.cos(F.radians(lat)), F.lit(MIN_COS_LAT))
    return {
        "lat": lat + travelled * F.cos(heading),
        "lon": lon + travelled * F.sin(heading) / shrink,
        "alt_ft": alt + zero_if_missing(vrate_fpm) * (horizon / 60.0),
        "confidence": F.greatest(F.lit(0.3), 1.0 - horizon / 600.0),
    }


def lateral_error_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar error: degrees times sixty, longitude not shrunk."""
    dlat, dlon = lat1 - lat2, lon1 - lon2
    return F.sqrt(dlat * dlat + dlon * dlon) * 60


def in_region(
    lat: Column,
    lon: Column,
    min_lat: float | None = None,
    max_lat: float | None = None,
    min_lon: float | None = None,
    max_lon: float | None = None,
) -> Column:
    """Bounding-box predicate; a missing or zero bound means the edge of the world."""
    return lat.between(min_lat or -90.0, max_lat or 90.0) & lon.between(min_lon or -180.0, max_lon or 180.0)


def slider_time(position: float | Column, start: Column, end: Column) -> Column:
    """Timestamp at a 0..100 slider position."""
    return start + (F.lit(position) / 100.0) * (end - start)
