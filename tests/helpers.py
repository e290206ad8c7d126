"""Small inputs for tests."""

import datetime

DAY = datetime.date(2026, 1, 15)
MIDNIGHT = 1768435200  # 2026-01-15 00:00 UTC
REPORT = (
    "icao24 string, callsign string, timestamp bigint, latitude double, longitude double, altitude double, "
    "velocity double, heading double, vertical_rate double, on_ground boolean, squawk string, _source_file string, "
    "_ingest_ts bigint, date date"
)


def report(ts, icao="abc123", lat=10.0, lon=20.0, alt=1000.0, spd=200.0, hdg=90.0, vr=0.0, src="a", day=DAY, call="X1"):
    return (icao, call, ts, lat, lon, alt, spd, hdg, vr, False, "", src, 0, day)


def frame(spark, rows):
    return spark.createDataFrame(rows, REPORT)


def points_of(spark, rows, **kw):
    from vaportrail.operators import tracks

    return tracks.resample(tracks.segment(frame(spark, rows)), **kw)


FLIGHT = (
    "flight_id string, callsign string, date date, points array<struct<ts:bigint,lat:double,lon:double,alt_ft:double,"
    "speed_kts:double,heading_deg:double,vrate_fpm:double>>"
)


def flight(fid, points, call="X1", day=DAY):
    """``points``: (ts, lat, lon, alt, speed, heading, vrate) tuples."""
    return (fid, call, day, points)
