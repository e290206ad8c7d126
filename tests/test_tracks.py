import datetime
import math
import random

import numpy as np
import pytest
from helpers import DAY, MIDNIGHT, frame, points_of, report
from pyspark.sql import functions as F

from vaportrail.operators import clean, flown, tracks


def test_filters_run_before_the_first_row_is_kept(spark):
    rows = [report(MIDNIGHT, lat=None, src="a"), report(MIDNIGHT, alt=5.0, src="b"), report(MIDNIGHT, alt=6.0, src="c")]
    kept = clean.clean_reports(frame(spark, rows)).collect()
    assert [(r["_source_file"], r["altitude"]) for r in kept] == [("b", 5.0)]


def test_ranges_and_missing_values(spark):
    nan = float("nan")
    rows = [
        report(1, alt=None, spd=None), report(2, alt=nan), report(3, alt=-1000.0), report(4, alt=60000.5),
        report(5, spd=700.0), report(6, spd=-1.0), report(7, lat=90.0), report(8, lat=90.1), report(9, lat=nan),
        report(10, lon=-180.5), report(11, icao=None), report(None),
    ]
    assert sorted(r["timestamp"] for r in clean.clean_reports(frame(spark, rows)).collect()) == [1, 2, 3, 5, 7]


def test_retention(spark):
    rows = [report(1), report(1), report(2, lat=None), report(3)]
    got = clean.retention(frame(spark, rows)).first()
    assert (got["rows_in"], got["rows_out"], got["retained_pct"]) == (4, 2, 50.0)


def test_copies_collapse_before_the_shuffle(spark):
    plan = clean.clean_reports(frame(spark, [report(1)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_gap_edge_and_single_reports(spark):
    ts = [0, 300, 601, 1000, 1001]  # gap 300 stays, 301 splits off a single report, 399 starts a new segment
    seg = tracks.segment(frame(spark, [report(MIDNIGHT + t) for t in ts]))
    got = sorted((r["timestamp"] - MIDNIGHT, r["seg_start"] - MIDNIGHT, r["seg_idx"]) for r in seg.collect())
    assert got == [(0, 0, 0), (300, 0, 0), (1000, 1000, 1), (1001, 1000, 1)]


def test_midnight_splits(spark):
    next_day = DAY + datetime.timedelta(days=1)
    rows = [report(MIDNIGHT + 86380), report(MIDNIGHT + 86390)]
    rows += [report(MIDNIGHT + 86400, day=next_day), report(MIDNIGHT + 86410, day=next_day)]
    ids = tracks.build_trajectories(frame(spark, rows)).select("flight_id").collect()
    assert sorted(r[0] for r in ids) == ["abc123_2026-01-15_0000", "abc123_2026-01-16_0000"]


@pytest.mark.parametrize(
    "ts, ticks", [([0, 4], [0, 4]), ([0, 25], [0, 10, 20]), ([0, 20], [0, 10, 20]), ([0, 9], [0, 9]), ([0, 10], [0, 10])]
)
def test_ticks(spark, ts, ticks):
    pts = points_of(spark, [report(MIDNIGHT + t, alt=float(t)) for t in ts]).orderBy("ts").collect()
    assert [p["ts"] - MIDNIGHT for p in pts] == ticks
    assert [p["alt_ft"] for p in pts] == [float(t) for t in ticks]


def test_short_segment_keeps_missing_values(spark):
    pts = points_of(spark, [report(0, alt=None), report(4, alt=7.0)]).orderBy("ts").collect()
    assert [p["alt_ft"] for p in pts] == [None, 7.0]


def test_heading_is_interpolated_as_a_number(spark):
    pts = points_of(spark, [report(0, hdg=350.0), report(20, hdg=10.0)]).orderBy("ts").collect()
    assert [p["heading_deg"] for p in pts] == [350.0, 180.0, 10.0]


def test_fill_forward_then_backward(spark):
    rows = [report(t, alt=a) for t, a in [(0, None), (10, 5.0), (20, None), (30, 9.0), (40, None)]]
    got = tracks.fill(tracks.segment(frame(spark, rows))).orderBy("timestamp").collect()
    assert [r["altitude"] for r in got] == [5.0, 5.0, 5.0, 9.0, 9.0]


def test_all_missing_altitude(spark):
    from vaportrail.operators import forecast, grid, stress

    rows = [report(MIDNIGHT + 10 * i, alt=None) for i in range(12)]
    pts = points_of(spark, rows)
    cells = grid.grid_density(pts)
    assert cells.first()["avg_altitude_ft"] is None
    assert stress.stress_index(cells, pts).first()["components"]["maneuver_variance_component"] == 0.0
    flights = tracks.build_trajectories(frame(spark, rows))
    assert flights.first()["max_alt_ft"] == 0.0
    assert forecast.forecast(flights).first()["predicted_points"][0]["alt_ft"] == 0.0


def test_resample_matches_numpy_on_random_tracks(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for plane in range(12):
        ts = sorted(rng.sample(range(0, 20_000), 120))
        alts = [None if rng.random() < 0.2 else rng.uniform(0, 40_000) for _ in ts]
        rows += [report(MIDNIGHT + t, icao=f"a{plane:05d}", alt=a) for t, a in zip(ts, alts)]
        cuts = [0] + [i + 1 for i in range(len(ts) - 1) if ts[i + 1] - ts[i] > 300] + [len(ts)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo < 2:
                continue
            t, a = np.array(ts[lo:hi]), list(alts[lo:hi])
            grid = np.arange(t[0], t[-1] + 1, 10)
            if len(grid) < 2:
                grid, values = t, np.array([np.nan if x is None else x for x in a])
            else:
                for i in range(1, len(a)):
                    a[i] = a[i - 1] if a[i] is None else a[i]
                known = next((x for x in a if x is not None), np.nan)
                a = [known if x is None else x for x in a]
                values = np.interp(grid, t, np.array(a, dtype=float))
            for g, v in zip(grid, values):
                want[(f"a{plane:05d}", MIDNIGHT + int(g))] = v
    rng.shuffle(rows)
    got = {(r["icao24"], r["ts"]): r["alt_ft"] for r in points_of(spark, rows).collect()}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert (got[key] is None and np.isnan(value)) or got[key] == pytest.approx(value, rel=1e-12)


def test_climbs_descents_turns_and_distance(spark):
    vr = [0.0, 600.0, 0.0, -600.0, None, 501.0]
    hdg = [350.0, None, 10.0, 10.0, 10.0, 20.0]
    rows = [(DAY, "abc123", 0, 10 * i, 0.0, i * 1.0, 1000.0, 100.0, h, v) for i, (h, v) in enumerate(zip(hdg, vr))]
    pts = spark.createDataFrame(
        rows,
        "date date, icao24 string, seg_start bigint, ts bigint, lat double, lon double, alt_ft double, speed_kts double, "
        "heading_deg double, vrate_fpm double",
    ).withColumns({"callsign": F.lit("X1"), "seg_idx": F.lit(0)})
    f = tracks.trajectories(pts).first()
    assert (f["climb_count"], f["descent_count"]) == (2, 1)
    assert f["heading_change_total"] == pytest.approx(30.0)
    assert f["distance_nm"] == pytest.approx(5 * 3440.065 * np.pi / 180)


def test_numbers_count_kept_segments_in_aircraft_order(spark):
    rows = [report(t, icao="b") for t in (0, 5, 1000, 2000, 2005)] + [report(t, icao="a") for t in (50, 55)]
    rows += [report(t, icao="c") for t in (1, 2)]
    got = tracks.with_flight_ids(tracks.with_flight_numbers(tracks.segment(frame(spark, rows)))).select("seg_start", "flight_id").distinct().collect()
    assert sorted((r["flight_id"], r["seg_start"]) for r in got) == [
        ("a_2026-01-15_0000", 50), ("b_2026-01-15_0001", 0), ("b_2026-01-15_0002", 2000), ("c_2026-01-15_0003", 1),
    ]


def test_hot_aircraft_and_copies_give_the_same_result(spark):
    """One aircraft has a third of all rows, and one report a third again as copies."""
    rng = random.Random(1)
    base = [report(MIDNIGHT + t, icao="aaaaaa", alt=float(t % 977)) for t in range(0, 6000, 2)]
    base += [report(MIDNIGHT + rng.randrange(80_000), icao=f"b{i % 300:05d}") for i in range(3000)]
    hot = base + [report(MIDNIGHT, icao="aaaaaa", alt=1.0, src="z") for _ in range(3000)]
    hot = spark.createDataFrame(hot, frame(spark, []).schema)
    plain = spark.createDataFrame(base, hot.schema)
    results = [
        sorted(
            (r["flight_id"], r["n"], round(r["max_alt_ft"], 6))
            for r in tracks.build_trajectories(clean.clean_reports(df))
            .select("flight_id", F.size("points").alias("n"), "max_alt_ft")
            .collect()
        )
        for df in (plain, hot)
    ]
    assert results[0] == results[1] and len(results[0]) > 1


def test_result_does_not_depend_on_partitioning(spark):
    rng = random.Random(3)
    rows = [report(MIDNIGHT + rng.randrange(80_000), icao=f"b{i % 40:05d}", alt=rng.uniform(0, 9e3)) for i in range(2000)]
    seen = []
    for n in (1, 13):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = frame(spark, rows).repartition(n)
        flights = tracks.build_trajectories(clean.clean_reports(df, ["_source_file", "altitude"]))
        seen.append(sorted((r["flight_id"], r["distance_nm"], len(r["points"])) for r in flights.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert seen[0] == seen[1]


def test_flights_read_their_reports_once(spark, tmp_path):
    from vaportrail.operators import clean
    from vaportrail.sources import tables

    path = str(tmp_path / "bronze")
    tables.append_bronze(frame(spark, [report(MIDNIGHT + t) for t in range(0, 300, 10)]), path)
    flights = tracks.build_trajectories(clean.clean_reports(tables.load_bronze(spark, path), tables.FILE_ORDER))
    assert flights.count() == 1 and flights.collect()
    plan = flights._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def test_flights_are_built_without_a_sort_of_their_points(spark):
    """As many rows as reports are gathered, and the flights are those of the long points."""
    rng = random.Random(7)
    some = lambda x: None if rng.random() < 0.2 else x
    rows = [
        report(MIDNIGHT + rng.randrange(40_000), f"b{i % 9:05d}", rng.uniform(-80, 80), rng.uniform(-170, 170), some(rng.uniform(0, 4e4)),
               some(rng.uniform(0, 600)), some(rng.uniform(0, 360)), some(rng.choice([-900.0, 0.0, 900.0])))
        for i in range(4000)
    ]
    rows += [report(MIDNIGHT + t, "short", alt=None, spd=None, hdg=h) for t, h in ((0, None), (3, 20.0), (7, 50.0))]
    reports = clean.clean_reports(frame(spark, rows), ["_source_file", "latitude"])
    flights = tracks.build_trajectories(reports)
    plan = flights._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    by_id = lambda df: {r["flight_id"]: r for r in df.collect()}
    got, want = by_id(flights), by_id(tracks.with_flight_ids(tracks.trajectories(tracks.build_points(reports))))
    assert got.keys() == want.keys() and len(got) > 30
    for key, r in want.items():
        assert r["points"] == got[key]["points"] and r == got[key]
    # what the steps say, flight by flight
    long = tracks.with_flight_ids(tracks.steps(tracks.build_points(reports)))
    summed = long.groupBy("flight_id").agg(
        F.sum("step_nm").alias("nm"), F.sum("turn_deg").alias("turn"), F.sum("climb_start").alias("up"), F.sum("descent_start").alias("down"),
        F.max("alt_ft").alias("alt"), F.avg("speed_kts").alias("speed"), (F.max("ts") - F.min("ts")).alias("sec"),
    )
    for key, r in by_id(summed).items():
        f = got[key]
        assert f["distance_nm"] == pytest.approx(r["nm"] or 0.0) and f["heading_change_total"] == pytest.approx(r["turn"] or 0.0)
        assert (f["climb_count"], f["descent_count"], f["duration_sec"]) == (r["up"], r["down"], r["sec"])
        assert f["max_alt_ft"] == (r["alt"] or 0.0) and f["avg_speed_kts"] == pytest.approx(r["speed"] or 0.0)


def odd_reports(rng, planes=12, n=60):
    """Reports with gaps, values that are missing or not numbers, steps over the poles, and flights of a few seconds."""
    pick = lambda *xs: xs[rng.randrange(len(xs))]
    rows = []
    for i in range(planes):
        ts, absent = MIDNIGHT + i, rng.randrange(6)
        for _ in range(n):
            ts += pick(1, 2, 3, 7, 20, 61, 290, 301)
            seen = lambda k, x: None if absent == k or rng.random() < 0.2 else float("nan") if rng.random() < 0.01 else x
            rows.append(
                report(ts, f"a{i:05d}", rng.uniform(-90, 90), rng.uniform(-180, 180), seen(1, rng.uniform(0, 4e4)), seen(2, rng.uniform(0, 600)),
                       seen(3, rng.uniform(0, 360)), seen(4, pick(-900.0, 0.0, 900.0)), call=pick("X1", None))
            )
    return rows


def walked(points):
    """The features of a flight, point by point."""
    above = lambda x, y: x > y or x != x  # noqa: E731  a NaN is above all numbers
    nm = turned = speeds = 0.0
    timed, ups, downs, top, was, course, rate = 0, 0, 0, None, None, None, None
    for p in points:
        now = p["vrate_fpm"] or 0.0
        if was is not None:
            a, b, c, d = (math.radians(x) for x in (was["lat"], p["lat"], p["lat"] - was["lat"], p["lon"] - was["lon"]))
            h = math.sin(c / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(d / 2) ** 2
            nm += 3440.065 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))
            ups += rate <= 0 and above(now, 500)
            downs += (above(rate, 0) or rate == 0) and now < -500
        if p["heading_deg"] is not None:
            if course is not None:
                turn = math.fmod(abs(course - p["heading_deg"]), 360)
                turned += turn if turn != turn else min(turn, 360 - turn)
            course = p["heading_deg"]
        if p["speed_kts"] is not None:
            speeds, timed = speeds + p["speed_kts"], timed + 1
        if p["alt_ft"] is not None and (top is None or above(p["alt_ft"], top)):
            top = p["alt_ft"]
        was, rate = p, now
    return [points[-1]["ts"] - points[0]["ts"], nm, top or 0.0, speeds / timed if timed else 0.0, turned, ups, downs]


def test_flights_expanded_in_batches_are_those_of_the_long_points(spark):
    reports = frame(spark, odd_reports(random.Random(8)))
    found = tracks.build_trajectories(reports)
    long = tracks.with_flight_ids(tracks.build_points(reports))
    assert found.dtypes == tracks.with_flight_ids(tracks.trajectories(tracks.build_points(reports))).dtypes
    known = {}
    for p in long.orderBy("flight_id", "ts").collect():
        known.setdefault(p["flight_id"], []).append(p)
    flights = found.collect()
    assert {r["flight_id"] for r in flights} == known.keys() and len(flights) > 50
    features = ["duration_sec", "distance_nm", "max_alt_ft", "avg_speed_kts", "heading_change_total", "climb_count", "descent_count"]
    for r in flights:
        points = known[r["flight_id"]]
        # a NaN equals no other, so texts are compared
        assert repr([tuple(p) for p in r["points"]]) == repr([tuple(p[c] for c in tracks.POINT_FIELDS) for p in points])
        assert [r[c] for c in features] == pytest.approx(walked(points), rel=1e-9, abs=1e-9, nan_ok=True)
        assert r["callsign"] == (points[0]["callsign"] or "")


def test_batches_are_cut_by_points():
    sizes = np.array([3, 3, 1, 9, 1, 1, 1, 1])
    cut = list(flown.pieces(sizes, 4))
    assert len(cut) > 2 and sum(n for _, n in cut) == len(sizes)
    assert [first for first, _ in cut] == [0, *np.cumsum([n for _, n in cut])[:-1]]
    assert all(sizes[a : a + n].sum() <= 4 + 9 for a, n in cut)


def test_the_points_of_a_flight_are_not_walked_one_by_one(spark):
    found = tracks.build_trajectories(frame(spark, odd_reports(random.Random(9), 2, 5)))
    asked = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in asked and "lambdafunction" not in asked
