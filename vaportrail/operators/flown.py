"""The reports of a flight to its points and features, many flights at a time.

Spark gathers the reports of each flight (:mod:`tracks`); what is left is arithmetic on each row, done here on whole Arrow batches:
expanding the ticks between two reports, and summing up what happens from point to point. A batch is cut so that no piece has many more points
than ``PIECE_POINTS``, or one flight, which its date bounds.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vaportrail.functions.geo import EARTH_RADIUS_NM

PIECE_POINTS = 250_000
FEATURES = (
    "duration_sec bigint, distance_nm double, max_alt_ft double, avg_speed_kts double, heading_change_total double, "
    "climb_count int, descent_count int"
)


def pieces(points: np.ndarray, most: int = PIECE_POINTS) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, number) whose ``points`` add up to about ``most``."""
    run = np.cumsum(points) // most
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    for first, end in zip(starts, np.append(starts[1:], len(points))):
        yield int(first), int(end - first)


def ticks_of(legs: pa.ListArray, step: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """The columns of all legs, the number of ticks of each, and the number of legs of each flight; a flight has at least one."""
    columns = legs.flatten()
    columns = dict(zip([f.name for f in columns.type], columns.flatten()))
    span = columns["_to"].to_numpy() - columns["_from"].to_numpy()
    return columns, span // step + 1, pc.list_value_length(legs).to_numpy()


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def positions(columns: dict, ticks: np.ndarray, step: int, measures: dict[str, str]) -> tuple[np.ndarray, dict, dict]:
    """Time of each tick, and by point field its values and where they are missing: a report's value plus slope times time passed."""
    leg = np.repeat(np.arange(len(ticks)), ticks)
    place = np.arange(len(leg)) - starts_of(ticks)[leg]
    ts = columns["_from"].to_numpy()[leg] + place * step
    passed = (ts - columns["timestamp"].to_numpy()[leg]).astype(float)
    values, missing = {}, {}
    for measure, field in measures.items():
        known, slope = columns[measure], columns[f"_slope_{measure}"]
        values[field] = slope.to_numpy(zero_copy_only=False)[leg] * passed + known.to_numpy(zero_copy_only=False)[leg]
        missing[field] = known.is_null().to_numpy(zero_copy_only=False)[leg]
    return ts, values, missing


def features(ts: np.ndarray, values: dict, missing: dict, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Features of flights of ``sizes`` points that follow one another. What a step counts for is as in :func:`tracks.steps`.

    A NaN is above all numbers, as in Spark.
    """
    starts, here = starts_of(sizes), np.arange(len(ts))
    start, flight = np.repeat(starts, sizes), np.repeat(np.arange(len(sizes)), sizes)
    before = np.maximum(here - 1, start)
    inner = here > start
    total = lambda x: np.bincount(flight, x, len(sizes))  # noqa: E731  one after the other, as a sum over the flight's points
    count = lambda hit: np.add.reduceat(hit * 1, starts)
    with np.errstate(invalid="ignore"):
        lat, lon = np.radians(values["lat"]), np.radians(values["lon"])
        half_dlat = np.sin(np.radians(values["lat"] - values["lat"][before]) / 2)
        half_dlon = np.sin(np.radians(values["lon"] - values["lon"][before]) / 2)
        shrink = np.cos(lat)
        h = half_dlat * half_dlat + shrink[before] * shrink * half_dlon * half_dlon
        moved = EARTH_RADIUS_NM * (2.0 * np.arctan2(np.sqrt(h), np.sqrt(1 - h)))
        unplaced = missing["lat"] | missing["lon"]
        moved[~inner | unplaced | unplaced[before]] = 0.0

        heading, unknown = values["heading_deg"], missing["heading_deg"]
        last_known = np.maximum.accumulate(np.where(unknown, -1, here))[before]
        turned = np.fmod(np.abs(heading[last_known] - heading), 360)
        turned = np.minimum(turned, 360 - turned)
        turned[~inner | unknown | (last_known < start)] = 0.0

        rate = np.where(missing["vrate_fpm"], 0.0, values["vrate_fpm"])
        was, odd = rate[before], np.isnan(rate)
        climbs = inner & (was <= 0) & ((rate > 500) | odd)
        descents = inner & ((was >= 0) | odd[before]) & (rate < -500)

        top = np.maximum.reduceat(np.where(missing["alt_ft"], -np.inf, values["alt_ft"]), starts)
        timed = count(~missing["speed_kts"])
        speeds = total(np.where(missing["speed_kts"], 0.0, values["speed_kts"]))
    return {
        "duration_sec": ts[starts + sizes - 1] - ts[starts],
        "distance_nm": total(moved),
        "max_alt_ft": np.where(np.logical_and.reduceat(missing["alt_ft"], starts), 0.0, top),
        "avg_speed_kts": np.where(timed > 0, speeds / np.maximum(timed, 1), 0.0),
        "heading_change_total": total(turned),
        "climb_count": count(climbs).astype("int32"),
        "descent_count": count(descents).astype("int32"),
    }


def finished(batch: pa.RecordBatch, points: pa.ListArray, ts: np.ndarray, values: dict, missing: dict, sizes: np.ndarray) -> pa.RecordBatch:
    """``batch`` with ``points`` in place of its last column, and the features."""
    kept = {name: batch.column(name) for name in batch.schema.names[:-1]}
    found = {name: pa.array(x) for name, x in features(ts, values, missing, sizes).items()}
    return pa.RecordBatch.from_pydict({**kept, "points": points, **found})


def expanded(batch: pa.RecordBatch, step: int, measures: dict[str, str]) -> pa.RecordBatch:
    """Rows that end in ``legs``, as flights."""
    columns, ticks, legs = ticks_of(batch.column("legs"), step)
    sizes = np.add.reduceat(ticks, starts_of(legs))
    ts, values, missing = positions(columns, ticks, step, measures)
    fields = [pa.array(ts), *[pa.array(values[f], mask=missing[f], from_pandas=False) for f in values]]
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    points = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["ts", *values]))
    return finished(batch, points, ts, values, missing, sizes)


def summed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows that end in ``points``, as flights."""
    points = batch.column("points")
    found = points.flatten()
    columns = dict(zip([f.name for f in found.type], found.flatten()))
    ts = columns.pop("ts").to_numpy()
    values = {f: x.to_numpy(zero_copy_only=False) for f, x in columns.items()}
    missing = {f: x.is_null().to_numpy(zero_copy_only=False) for f, x in columns.items()}
    return finished(batch, points, ts, values, missing, pc.list_value_length(points).to_numpy())


def expander(step: int, measures: dict[str, str]):
    """For ``mapInArrow``: rows that end in ``legs``, at least one each, to flights."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, ticks, legs = ticks_of(batch.column("legs"), step)
            for first, number in pieces(np.add.reduceat(ticks, starts_of(legs))):
                yield expanded(batch.slice(first, number), step, measures)

    return expand


def summer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: rows that end in ``points``, at least one each, to flights."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for first, number in pieces(pc.list_value_length(batch.column("points")).to_numpy()):
            yield summed(batch.slice(first, number))
