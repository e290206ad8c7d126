"""Which input column plays which Bronze role."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaportrail.functions.text import to_double, to_epoch, to_flag

# Accepted header names per Bronze column; the first one present wins, case ignored.
ALIASES = {
    "icao24": ["icao24", "icao", "hex", "aircraft_id"],
    "callsign": ["callsign", "call", "flight"],
    "timestamp": ["time", "timestamp", "ts", "epoch"],
    "latitude": ["lat", "latitude", "position_lat"],
    "longitude": ["lon", "longitude", "lng", "position_lon"],
    "altitude": ["baroaltitude", "altitude", "alt", "geoaltitude", "baro_altitude"],
    "velocity": ["velocity", "speed", "groundspeed", "gs"],
    "heading": ["heading", "track", "trk"],
    "vertical_rate": ["vertrate", "vertical_rate", "vs", "vert_rate", "vrate"],
    "on_ground": ["onground", "on_ground", "ground"],
    "squawk": ["squawk", "transponder"],
}


def detect_columns(columns: list[str]) -> dict[str, str]:
    """Bronze column -> input column, for those found."""
    by_name = {c.strip().lower(): c for c in columns}
    found = {role: next((by_name[n] for n in names if n in by_name), None) for role, names in ALIASES.items()}
    return {role: c for role, c in found.items() if c is not None}


def normalise(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Typed Bronze columns from any input with recognisable headers, plus the ``keep`` columns as they are.

    Text that is no number becomes null; missing callsigns and squawks become empty; units are not converted.
    """
    found = detect_columns([c for c in df.columns if c not in (keep or [])])

    def source(role: str):
        return F.col(f"`{found[role]}`") if role in found else F.lit(None).cast("string")

    text = {role: F.coalesce(source(role).cast("string"), F.lit("")) for role in ("callsign", "squawk")}
    numbers = ("latitude", "longitude", "altitude", "velocity", "heading", "vertical_rate")
    columns = {
        "icao24": source("icao24").cast("string"),
        "callsign": text["callsign"],
        "timestamp": to_epoch(source("timestamp")),
        **{role: to_double(source(role)) for role in numbers},
        "on_ground": to_flag(source("on_ground")),
        "squawk": text["squawk"],
    }
    return df.select(*[c.alias(name) for name, c in columns.items()], *(keep or []))
