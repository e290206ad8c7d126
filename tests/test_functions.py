import math

import pytest
from pyspark.sql import functions as F

from vaportrail.functions import geo, labels, text


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("x, cell", [(0.25, 0.0), (0.75, 1.0), (-0.1, 0.0), (-0.75, -1.0), (30.3, 30.5)])
def test_grid_snap_half_even(spark, x, cell):
    got = one(spark, geo.snap_to_grid(F.lit(x)).alias("c"))["c"]
    assert got == cell and math.copysign(1, got) == (1 if cell >= 0 else -1)


def test_haversine_quarter_circle(spark):
    got = one(spark, geo.haversine_nm(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)))[0]
    assert got == pytest.approx(3440.065 * math.pi / 2)


@pytest.mark.parametrize("a, b, d", [(350.0, 10.0, 20.0), (10.0, 350.0, 20.0), (0.0, 180.0, 180.0), (90.0, 90.0, 0.0)])
def test_heading_difference(spark, a, b, d):
    assert one(spark, geo.heading_difference(F.lit(a), F.lit(b)))[0] == d


@pytest.mark.parametrize("to, bearing", [((1.0, 0.0), 0.0), ((0.0, 1.0), 90.0), ((-1.0, 0.0), 180.0), ((0.0, -1.0), 270.0)])
def test_bearing(spark, to, bearing):
    got = one(spark, geo.initial_bearing(F.lit(0.0), F.lit(0.0), F.lit(to[0]), F.lit(to[1])))[0]
    assert got == pytest.approx(bearing)


def test_hour_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = one(spark, geo.hour_of_day(F.lit(1766685600)), geo.epoch_date(F.lit(1766685600)).cast("string"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == (18, "2025-12-25")


def test_dead_reckoning(spark):
    at = geo.dead_reckon(*[F.lit(v) for v in (60.0, 10.0, 5000.0, 399600 / 1.852 / 600, 90.0, 600.0)], F.lit(60))
    row = one(spark, *[c.alias(n) for n, c in at.items()])
    assert row["lat"] == pytest.approx(60.0)
    assert row["lon"] == pytest.approx(10.0 + 0.1 / math.cos(math.radians(60)), abs=1e-9)
    assert row["alt_ft"] == 5600.0 and row["confidence"] == pytest.approx(0.9)
    none = F.lit(None).cast("double")
    row = one(spark, *[c.alias(n) for n, c in geo.dead_reckon(none, none, none, none, none, none, F.lit(600)).items()])
    assert tuple(row) == (0.0, 0.0, 0.0, 0.3)


@pytest.mark.parametrize("x, level", [(24.99, "low"), (25.0, "medium"), (50.0, "high"), (75.0, "critical")])
def test_risk_edges(spark, x, level):
    assert one(spark, labels.risk_level(F.lit(x)))[0] == level


@pytest.mark.parametrize("x, label", [(0.49, "High"), (0.5, "Medium"), (2.0, "Low")])
def test_confidence_edges(spark, x, label):
    assert one(spark, labels.confidence_label(F.lit(x)))[0] == label


@pytest.mark.parametrize("t, v", [("TRUE", True), ("t", True), ("0", False), ("F", False), ("1.0", None), (None, None)])
def test_flag_text(spark, t, v):
    assert one(spark, text.to_flag(F.lit(t).cast("string")))[0] is v


@pytest.mark.parametrize(
    "t, v", [("1.5", 1.5), (" 2 ", 2.0), ("1e3", 1000.0), ("ground", None), ("12d", None), ("nan", None), ("", None)]
)
def test_number_text(spark, t, v):
    assert one(spark, text.to_double(F.lit(t)))[0] == v


def test_epoch_text_is_cut(spark):
    assert one(spark, text.to_epoch(F.lit("1768435200.9")))[0] == 1768435200
    assert one(spark, text.to_epoch(F.lit("soon")))[0] is None


@pytest.mark.parametrize(
    "name, date",
    [
        ("2026-01-15.csv.gz", "2026-01-15"),
        ("states_2026-01-15.csv", "2026-01-15"),
        ("feed_20260115.csv.gz", "2026-01-15"),
        ("nodate.csv", None),
    ],
)
def test_file_date(spark, name, date):
    assert one(spark, text.file_date_text(F.lit(name)))[0] == date


def test_flight_number_is_not_cut(spark):
    row = one(spark, text.flight_id(F.lit("abc"), F.lit("2026-01-15").cast("date"), F.lit(12345)))
    assert row[0] == "abc_2026-01-15_12345"


def test_what_if_is_clipped(spark):
    assert one(spark, labels.what_if_density(F.lit(0.8), 200))[0] == 1.0
    assert one(spark, labels.what_if_stress(F.lit(40.0), 50))[0] == 20.0


def test_region_falls_back_to_world(spark):
    assert one(spark, geo.in_region(F.lit(-80.0), F.lit(10.0), 0, None, None, 0))[0] is True
    assert one(spark, geo.in_region(F.lit(-80.0), F.lit(10.0), -40.0))[0] is False
