"""Text parsing as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(text: Column) -> Column:
    """Number in a text, else null. NaN counts as missing; Java's ``12d`` / ``12f`` spellings do not count as numbers."""
    text = text.cast("string")
    value = F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))
    return F.nanvl(value, F.lit(None).cast("double"))


def to_epoch(text: Column) -> Column:
    """Epoch seconds, fractions cut off."""
    return F.coalesce(text.cast("string").try_cast("bigint"), to_double(text).try_cast("bigint"))


def to_flag(text: Column) -> Column:
    """Tri-state boolean from its usual spellings."""
    # Accepted spellings.
    spelling = F.lower(text.cast("string"))
    return F.when(spelling.isin("true", "1", "t"), True).when(spelling.isin("false", "0", "f"), False)


def file_date_text(name: Column) -> Column:
    """Date in a file name: ``YYYY-MM-DD`` anywhere, else the first eight digits; null when neither is there."""
    dashed = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1)
    digits = F.regexp_extract(name, r"(\d{8})", 1)
    return F.when(dashed != "", dashed).when(
        digits != "", F.concat_ws("-", digits.substr(1, 4), digits.substr(5, 2), digits.substr(7, 2))
    )


def file_date(name: Column) -> Column:
    """Partition date of a file; today when the name has no valid one."""
    return F.coalesce(file_date_text(name).try_cast("date"), F.current_date())


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def flight_id(icao24: Column, day: Column, number: Column) -> Column:
    """``aircraft_date_number``, the number padded to four digits but never cut."""
    digits = number.cast("string")
    padded = F.when(number < 10000, F.lpad(digits, 4, "0")).otherwise(digits)
    return F.concat_ws("_", icao24, day.cast("string"), padded)


def flight_date_text(fid: Column) -> Column:
    """Second part of a flight id."""
    return F.get(F.split(fid, "_"), F.lit(1))
