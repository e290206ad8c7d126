"""Stored layers: time index, cell states, changed dates, published runs, playback and row numbers by ranges."""

import datetime
import random
import threading

import pytest
from helpers import DAY, FLIGHT, MIDNIGHT, flight, frame, report
from pyspark.sql import functions as F

from vaportrail.operators import cellstate, grid, numbering, percentiles, playback, sampling, spatial, stress, timetravel
from vaportrail.plans import bronze, gold, silver
from vaportrail.session import together
from vaportrail.sources import ledger, tables

NEXT = DAY + datetime.timedelta(days=1)


def fleet(n=20, day=DAY, midnight=MIDNIGHT, hours=(0, 3, 9), src="a", shift=0.0):
    rows = []
    for i in range(n):
        for h in hours:
            for t in range(0, 300 + 20 * i, 30):
                ts = midnight + h * 3600 + t
                rows.append(report(ts, f"a{i:05d}", 10 + i % 5 * 0.7 + t * 1e-4 + shift, 20.0 + i % 3, 1000.0 + 37 * i + t, 200.0 + i, float((i * 40 + t) % 360), 0.0, src, day))
    return rows


@pytest.fixture(scope="module")
def layers(spark, tmp_path_factory):
    b, s = (str(tmp_path_factory.mktemp("layers") / n) for n in ("b", "s"))
    tables.append_bronze(frame(spark, fleet() + fleet(12, NEXT, MIDNIGHT + 86400)), b)
    silver.build_silver(spark, b, s)
    return b, s


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- time index


def test_time_index_says_what_the_points_say(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        stamps = sorted({MIDNIGHT + rng.randrange(86400) for _ in range(rng.randrange(0, 6))})
        rows.append(flight(f"f{i}", [(ts, 1.0, 1.0, None, None, None, None) for ts in stamps]))
    rows.append(flight("odd", [(-5, 1.0, 1.0, None, None, None, None), (0, 1.0, 1.0, None, None, None, None)]))
    flights = spark.createDataFrame(rows, FLIGHT)
    indexed = sampling.with_time_index(flights)
    for r in indexed.collect():
        stamps = [p["ts"] for p in r["points"] if p["ts"] > 0]
        hours = {ts // 3600 % 24 for ts in stamps}
        assert (r["first_ts"], r["last_ts"]) == ((min(stamps), max(stamps)) if stamps else (None, None))
        assert (r["first_hour"], r["last_hour"]) == ((min(hours), max(hours)) if hours else (None, None))
        assert r["hours"] == sum(1 << h for h in hours)
    assert sampling.time_range(indexed).first() == sampling.time_range(flights).first()
    for hour in range(24):
        cut = lambda df: sorted((r["flight_id"], len(r["points"])) for r in sampling.hour_tracks(df, hour, 1).collect())
        assert cut(indexed) == cut(flights)


def test_the_time_range_reads_no_points_and_hours_reach_the_scan(spark, layers):
    stored = tables.load_trajectories(spark, layers[1])
    asked = plan(sampling.time_range(stored))
    assert "points" not in asked.split("ReadSchema")[1] and "first_ts" in asked
    cut = plan(sampling.hour_tracks(stored, 9))
    assert "LessThanOrEqual(first_hour,9)" in cut and "GreaterThanOrEqual(last_hour,9)" in cut
    assert sampling.hour_tracks(stored, 9).count() == 32 and sampling.hour_tracks(stored, 10).count() == 0


def test_hours_of_the_time_index_are_worked_out_once(spark):
    indexed = sampling.with_time_index(spark.createDataFrame([], FLIGHT))
    assert indexed._jdf.queryExecution().optimizedPlan().toString().count("3600") == 1


# --- cell states


def rounded(df, digits=6):
    def value(x):
        return round(x, digits) if isinstance(x, float) else tuple(map(value, x)) if isinstance(x, tuple) else x

    columns = sorted(df.columns)
    return sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=str)


def assert_states_equal_the_direct_answer(spark, silver_path):
    cells, points = tables.load_grid(spark, silver_path), tables.load_points(spark, silver_path)
    hours, days = tables.load_states(spark, silver_path)
    assert rounded(cellstate.cell_dispersion(hours)) == rounded(grid.cell_dispersion(points))
    assert rounded(grid.with_centre(cellstate.cell_history(days))) == rounded(grid.cell_history(cells))
    assert rounded(cellstate.traffic_density(cells, days)) == rounded(grid.traffic_density(cells))
    merged = stress.stress_index(cells, None, dispersion=cellstate.cell_dispersion(hours))
    assert rounded(merged) == rounded(stress.stress_index(cells, points))


def test_states_of_days_merge_to_the_direct_answer_also_after_a_day_is_replaced(spark, tmp_path):
    b, s = str(tmp_path / "b"), str(tmp_path / "s")
    tables.append_bronze(frame(spark, fleet() + fleet(12, NEXT, MIDNIGHT + 86400)), b)
    silver.build_silver(spark, b, s)
    assert_states_equal_the_direct_answer(spark, s)
    before = tables.load_states(spark, s, DAY, DAY)[0].collect()
    tables.append_bronze(frame(spark, fleet(25, NEXT, MIDNIGHT + 86400, (5, 9), "late", 0.4)), b)
    silver.build_silver(spark, b, s, NEXT, NEXT)
    assert_states_equal_the_direct_answer(spark, s)
    assert sorted(map(str, tables.load_states(spark, s, DAY, DAY)[0].collect())) == sorted(map(str, before))


def test_states_far_from_zero_keep_their_digits(spark):
    day = [("2026-01-15", 1, 1e9), ("2026-01-15", 1, 1e9 + 1), ("2026-01-16", 1, 1e9 + 2), ("2026-01-16", 1, 1e9 + 4)]
    rows = spark.createDataFrame(day, "date string, k int, x double")
    states = rows.groupBy("date", "k").agg(*cellstate._moments({"x": "x"}))
    got = cellstate.merged(states, ["k"], ["x"]).first()
    assert (got["n"], got["x_mean"], got["x_m2"]) == (4, 1e9 + 1.75, 8.75)


def test_cells_without_tracks_get_the_estimate(spark, layers):
    _, s = layers
    cells = tables.load_grid(spark, s)
    hours, days = tables.load_states(spark, s)
    density = cellstate.traffic_density(cells, days)
    index = stress.stress_index(cells, None, dispersion=cellstate.cell_dispersion(hours))
    assert rounded(stress.with_estimates(index, density)) == rounded(index)
    some = index.where("hour <> 3")
    filled = stress.with_estimates(some, density)
    assert filled.columns == index.columns and rounded(filled.where("hour <> 3")) == rounded(some)
    keys = ["grid_lat", "grid_lon", "hour"]
    bare = density.where("hour = 3").groupBy(*keys).agg(F.avg("density_score").alias("density_score"), F.min("date").alias("date"))
    want = stress.stress_estimate(bare).select(*keys, "stress_index", "risk_level")
    got = filled.where("hour = 3").select(*keys, "stress_index", "risk_level")
    assert rounded(got) == rounded(want) and got.count() > 0


# --- changed dates


def archive(folder, name, rows):
    lines = [f"{r[2]},{r[0]},{r[3]},{r[4]},{r[6]},{r[7]},{r[8]},{r[1]},false,,{r[5]}" for r in rows]
    head = "time,icao24,lat,lon,velocity,heading,vertrate,callsign,onground,squawk,baroaltitude"
    (folder / name).write_text("\n".join([head, *lines]) + "\n")


def test_only_changed_dates_are_built_and_a_bad_one_stops_no_other(spark, tmp_path):
    raw, b, s = tmp_path / "raw", str(tmp_path / "b"), str(tmp_path / "s")
    raw.mkdir()
    archive(raw, "2026-01-15.csv", fleet(6))
    archive(raw, "2026-01-16.csv", fleet(4, NEXT, MIDNIGHT + 86400))
    bronze.ingest_archives(spark, str(raw), b)
    first = silver.build_changed(spark, b, s).collect()
    assert [(str(r["date"]), r["files"], r["flights"], r["error"]) for r in first] == [("2026-01-15", 1, 18, None), ("2026-01-16", 1, 12, None)]
    assert silver.build_changed(spark, b, s).count() == 0
    # the second day gets another archive, a third day cannot be read
    archive(raw, "more_2026-01-16.csv", fleet(2, NEXT, MIDNIGHT + 86400, (12,), "late"))
    archive(raw, "2026-01-17.csv", fleet(3, NEXT + datetime.timedelta(days=1), MIDNIGHT + 2 * 86400))
    bronze.ingest_archives(spark, str(raw), b)
    for part in (tmp_path / "b" / "date=2026-01-17").glob("part-*"):
        good = part.read_bytes()
        part.write_bytes(b"PAR1 no longer PAR1")
    second = {str(r["date"]): r for r in silver.build_changed(spark, b, s).collect()}
    assert set(second) == {"2026-01-16", "2026-01-17"}
    assert second["2026-01-16"]["flights"] == 14 and second["2026-01-16"]["error"] is None
    assert second["2026-01-17"]["error"] and second["2026-01-17"]["flights"] is None
    flights = lambda: {str(r["date"]): r["count"] for r in tables.load_trajectories(spark, s).groupBy("date").count().collect()}
    assert flights() == {"2026-01-15": 18, "2026-01-16": 14}
    # once it is mended it is built, alone
    part.write_bytes(good)
    for crc in (tmp_path / "b" / "date=2026-01-17").glob(".*.crc"):
        crc.unlink()
    assert [str(r["date"]) for r in silver.build_changed(spark, b, s).collect()] == ["2026-01-17"]
    assert flights() == {"2026-01-15": 18, "2026-01-16": 14, "2026-01-17": 9}
    assert ledger.by_date(spark, b).count() == 3


def test_many_changed_dates_are_written_at_once_as_one_by_one(spark, tmp_path, monkeypatch):
    raw, b, s, alone = tmp_path / "raw", str(tmp_path / "b"), str(tmp_path / "s"), str(tmp_path / "alone")
    raw.mkdir()
    days = [(DAY + datetime.timedelta(days=i), MIDNIGHT + i * 86400) for i in range(5)]
    for i, (day, midnight) in enumerate(days):
        archive(raw, f"{day}.csv", fleet(i + 2, day, midnight))
    bronze.ingest_archives(spark, str(raw), b)
    write, written = tables.write_table, []
    monkeypatch.setattr(tables, "write_table", lambda df, path, *a, **k: (written.append(path), write(df, path, *a, **k)))
    built = silver.build_changed(spark, b, s).collect()
    assert len(written) == 4  # four tables, however many dates
    counts = []
    for day, _ in days:
        counts.append(silver.build_silver(spark, b, alone, day, day))
    assert [(r["flights"], r["cells"]) for r in built] == counts
    for table in ("trajectories", "grid_density", "cell_hours", "cell_days"):
        both = [spark.read.parquet(f"{root}/{table}") for root in (s, alone)]
        assert both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()


def test_densities_and_hour_states_are_written_at_the_same_time(spark, layers, tmp_path, monkeypatch):
    write, meeting = tables.write_table, threading.Barrier(2, timeout=60)

    def met(df, path, *a, **k):
        if path.endswith(("grid_density", "cell_hours")):
            meeting.wait()  # breaks when one of them waits for the other to end
        return write(df, path, *a, **k)

    monkeypatch.setattr(tables, "write_table", met)
    flights, cells = silver.build_silver(spark, layers[0], str(tmp_path / "s"))
    assert flights == spark.read.parquet(f"{tmp_path}/s/trajectories").count()
    assert cells == spark.read.parquet(f"{tmp_path}/s/grid_density").count() > 0


def test_an_error_of_jobs_that_run_together_is_raised(spark):
    done = []
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1 // 0, lambda: done.append(spark.range(5).count()))
    assert done == [5]


def test_hours_skip_pages_of_a_date(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(silver, "FLIGHTS_PER_PAGE", 10)
    hourly = [(f"{i:06x}", h) for h in range(24) for i in range(10)]
    rows = [report(MIDNIGHT + 3600 * h + 100 + t, icao) for icao, h in hourly for t in (0, 60)]
    source, out = str(tmp_path / "b"), str(tmp_path / "s")
    tables.append_bronze(frame(spark, rows), source)
    silver.build_silver(spark, source, out)
    cut = sampling.hour_tracks(tables.load_trajectories(spark, out), 19)
    executed = cut._jdf.queryExecution().executedPlan()
    assert executed.executeCollect() is not None
    assert executed.collectLeaves().head().metrics().apply("numOutputRows").value() < 60
    assert cut.count() == 10 and len(hourly) == spark.read.parquet(f"{out}/trajectories").count()


def test_a_date_built_to_nothing_counts_nothing(spark, layers, tmp_path):
    b, s = layers
    out = str(tmp_path / "again")
    assert silver.build_dates(spark, b, out, [DAY, NEXT])[DAY][0] > 0
    empty = silver.build_dates(spark, b, out, [DAY, NEXT], max_gap=0)  # every report is a segment of its own
    assert [(flights, error) for flights, _, error in empty.values()] == [(0, None), (0, None)]


def test_observed_counts_are_those_of_the_tables(spark, layers, tmp_path):
    b, s = layers
    out = str(tmp_path / "again")
    assert silver.build_silver(spark, b, out) == (tables.load_trajectories(spark, s).count(), tables.load_grid(spark, s).count())


# --- published runs


def test_a_run_that_fails_leaves_the_old_answers(spark, layers, tmp_path, monkeypatch):
    root = str(tmp_path / "gold")
    with pytest.raises(ValueError):
        gold.current(spark, root)
    first = gold.publish_gold(spark, layers[1], root)
    old = rounded(gold.load_artifact(spark, first, "traffic_density"))
    monkeypatch.setattr(stress, "stress_index", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        gold.publish_gold(spark, layers[1], root, training_days=1)
    assert gold.current(spark, root) == first and gold.published(spark, root).count() == 1
    assert rounded(gold.load_artifact(spark, gold.current(spark, root), "traffic_density")) == old
    monkeypatch.undo()
    second = gold.publish_gold(spark, layers[1], root, training_days=1)
    assert gold.current(spark, root) == second
    assert rounded(gold.load_artifact(spark, second, "traffic_density")) != old
    third = gold.publish_gold(spark, layers[1], root)
    assert not tables.exists(spark, first) and tables.exists(spark, second)
    assert rounded(gold.load_artifact(spark, third, "traffic_density")) == old
    rows = gold.published(spark, root).orderBy("model_version").collect()
    assert [r["model_version"] for r in rows] == [1, 2, 3] and rows[2]["data_version"].endswith("--003")


# --- playback


def test_playback_is_the_position_at_every_moment(spark):
    rng = random.Random(7)
    rows = []
    for i in range(25):
        stamps = sorted({rng.randrange(0, 4000) for _ in range(rng.randrange(0, 12))})
        rows.append(
            flight(f"f{i}", [(ts, rng.uniform(-80, 80), rng.uniform(-170, 170), rng.choice([None, 5.0, 9.0]), 1.0, rng.uniform(0, 360), 0.0) for ts in stamps])
        )
    flights = spark.createDataFrame(rows, FLIGHT)
    known = [p[0] for r in rows for p in r[3]][:20]
    moments = [*known, *(rng.uniform(-100, 4100) for _ in range(60)), 1800.0, 1800.0, None]
    asked = spark.createDataFrame([(t if t is None else float(t),) for t in moments], "t double")
    got = {(r["flight_id"], r["t"]): r for r in playback.playback(flights, asked, slice_sec=300).collect()}
    times = F.array(*[F.lit(float(t)) for t in sorted({t for t in moments if t is not None})])
    each = flights.where(F.size("points") > 0).select("flight_id", "points", F.explode(times).alias("t"))
    active = each.where((F.col("t") >= F.col("points")[0]["ts"]) & (F.col("t") <= F.element_at("points", -1)["ts"]))
    at = active.select("flight_id", "t", timetravel.position_at(F.col("points"), F.col("t")).alias("at"))
    want = {(r["flight_id"], r["t"]): r["at"] for r in at.collect()}
    assert set(got) == set(want) and len(want) > 200
    for key, at in want.items():
        mine = got[key]
        for c in ("lat", "lon", "alt_ft", "heading_deg"):
            assert mine[c] == pytest.approx(at[c]) if at[c] is not None else mine[c] is None


def test_playback_of_nothing(spark):
    flights = spark.createDataFrame([flight("a", [])], FLIGHT)
    assert playback.playback(flights, playback.frames(0, 100, 10, spark)).count() == 0
    assert playback.frames(0, 100, 10, spark).count() == 11 and playback.frames(5, 4, 1, spark).count() == 0


def test_playback_unpacks_only_flights_under_way(spark, tmp_path):
    tracks = [flight(f"f{i}", [(1000 * i + ts, 1.0, 2.0, 3.0, 4.0, 5.0, 0.0) for ts in range(100)]) for i in range(50)]
    path = str(tmp_path / "flights")
    spark.createDataFrame(tracks, FLIGHT).write.parquet(path)
    shown = playback.playback(spark.read.parquet(path), spark.createDataFrame([(7050.5,), (9000.0,), (9500.0,)], "t double"))
    unpacked = plan(shown).split("Generate explode(points")[1:]
    assert unpacked and all("LeftSemi" in below for below in unpacked)
    assert sorted((r["flight_id"], r["t"]) for r in shown.collect()) == [("f7", 7050.5), ("f9", 9000.0)]


def test_spans_read_only_the_time_of_points(spark, tmp_path):
    path = str(tmp_path / "flights")
    spark.createDataFrame([flight("a", [(1, 1.0, 2.0, 3.0, 4.0, 5.0, 0.0), (9, 1.0, 2.0, 3.0, 4.0, 5.0, 0.0)])], FLIGHT).write.parquet(path)
    spans = playback.spans(spark.read.parquet(path))
    assert "points:array<struct<ts:bigint>>" in plan(spans) and [tuple(r) for r in spans.collect()] == [("a", 1, 9)]


# --- row numbers


def test_ranges_are_even_whatever_the_ids_share(spark):
    ids = [f"sameprefix{i:06d}" for i in random.Random(1).sample(range(10**6), 40_000)]
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(i,) for i in ids], "k string").repartition(8)
        sizes = sorted(r["count"] for r in numbering.in_ranges(df, "k").groupBy("range").count().collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
        got = {r["k"]: r["row_no"] for r in numbering.number_rows(df, "k").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    assert got == {k: n for n, k in enumerate(sorted(ids))}


# --- percentiles


@pytest.mark.parametrize("band", [0, 10**6])
def test_percentiles_of_every_group(spark, band):
    rng = random.Random(5)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(500)],
        "ties": [1.0] * 300 + [2.0] * 5 + [7.5] * 100,
        "wide": [10.0 ** rng.randrange(-3, 4) for _ in range(200)] + ([-1.7e308, 1.7e308] if band else []),
        "one": [4.0],
        "two": [4.0, -2.0],
        "none": [float("nan"), None, float("inf")],
    }
    rows = [(g, x) for g, values in groups.items() for x in values]
    rng.shuffle(rows)
    qs = [0.0, 0.05, 0.5, 0.9, 0.99, 1.0]
    got = percentiles.group_percentiles(spark.createDataFrame(rows, "g string, x double"), "x", qs, ["g"], band, bins=64).collect()
    assert {r["g"] for r in got} == set(groups) - {"none"}
    for r in got:
        values = sorted(groups[r["g"]])
        for q, mine in zip(qs, r["percentiles"], strict=True):
            place = q * (len(values) - 1)
            low, high = values[int(place)], values[min(len(values) - 1, int(place) + 1)]
            assert mine == pytest.approx(low + (high - low) * (place - int(place)))


def test_turns_do_not_depend_on_the_number_of_ranks(spark, monkeypatch):
    turns = []
    narrowed = percentiles._narrowed
    monkeypatch.setattr(percentiles, "_narrowed", lambda *a: turns.append(1) or narrowed(*a))
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"), (F.col("id") % 7).alias("g"))
    for qs in ([0.5], [i / 20 for i in range(21)]):
        turns.clear()
        percentiles.group_percentiles(df, "x", qs, ["g"], band=10, bins=32).collect()
        assert len(turns) == 2


# --- Z-order


def test_keys_interleave_and_ranges_hold_every_point_of_the_box(spark):
    rng = random.Random(11)
    places = [(rng.uniform(-95, 95), rng.uniform(-185, 185)) for _ in range(300)] + [(None, 1.0), (float("nan"), 1.0), (90.0, 180.0), (-90.0, -180.0)]
    df = spark.createDataFrame(places, "lat double, lon double").withColumn("z_key", spatial.z_key(F.col("lat"), F.col("lon")))
    rows = df.collect()
    for r in rows[:300]:
        y, x = (min(8191, max(0, int((v - low) * 16 // 1))) for v, low in ((r["lat"], -90), (r["lon"], -180)))
        assert r["z_key"] == spatial.interleave(y, x)
    for _ in range(40):
        (a, b), (c, e) = sorted((rng.uniform(-90, 90), rng.uniform(-90, 90))), sorted((rng.uniform(-180, 180), rng.uniform(-180, 180)))
        ranges = spatial.key_ranges(a, b, c, e)
        assert len(ranges) <= 81 and all(h < low for (_, h), (low, _) in zip(ranges, ranges[1:], strict=False))
        for r in rows[:300]:
            if a <= r["lat"] <= b and c <= r["lon"] <= e:
                assert any(low <= r["z_key"] <= high for low, high in ranges)
    box = (rows[0]["lat"], rows[0]["lat"] + 30, rows[0]["lon"], rows[0]["lon"] + 30)  # the point is on the edge
    want = sorted(str(r) for r in rows[:300] if box[0] <= r["lat"] <= box[1] and box[2] <= r["lon"] <= box[3])
    assert sorted(map(str, spatial.in_box(df, *box).collect())) == want and want


def test_a_small_box_skips_most_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "z")
    rng = F.rand(seed=3), F.rand(seed=4)
    points = spark.range(400_000).select(
        F.format_string("f%05d", F.col("id") % 5000).alias("flight_id"), F.col("id").alias("ts"),
        (rng[0] * 40 + 20).alias("lat"), (rng[1] * 60 - 120).alias("lon"), F.lit(1.0).alias("alt_ft"), F.lit(DAY).alias("date"),
    )
    points = points.withColumn("z_key", spatial.z_key(F.col("lat"), F.col("lon")))
    ordered = points.repartitionByRange(4, "z_key").sortWithinPartitions("z_key")
    ordered.write.option("parquet.block.size", 256 << 10).parquet(path)
    box = (30.0, 31.0, -100.0, -98.5)
    ranges = spatial.key_ranges(*box)
    read = total = 0
    for part in (tmp_path / "z").glob("part-*"):
        meta = pq.ParquetFile(part).metadata
        column = next(i for i in range(meta.num_columns) if meta.schema.column(i).name == "z_key")
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(column).statistics
            total += 1
            read += any(stats.min <= high and stats.max >= low for low, high in ranges)
    assert total >= 20 and read <= total / 4
    stored = spark.read.parquet(path)
    assert "GreaterThanOrEqual(z_key," in plan(spatial.in_box(stored, *box))
    inside = F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:])
    assert spatial.in_box(stored, *box).count() == stored.where(inside).count() > 0
