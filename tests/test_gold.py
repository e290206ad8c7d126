import numpy as np
import pytest
from helpers import DAY, FLIGHT, MIDNIGHT, flight
from pyspark.sql import functions as F

from vaportrail.operators import anomaly, forecast, grid, live, numbering, percentiles, registry, sampling, stress, timetravel
from vaportrail.session import stage


def line(n, t0=MIDNIGHT, step=10, lat0=10.0, alt=1000.0):
    return [(t0 + i * step, lat0 + i * 0.01, 20.0, alt, 216.0, 0.0, 0.0) for i in range(n)]


def flights(spark, *rows):
    return spark.createDataFrame(list(rows), FLIGHT)


def grid_rows(spark, rows):
    return spark.createDataFrame(rows, "date date, hour int, grid_lat double, grid_lon double, flight_count bigint, point_count bigint")


def test_density_percentile(spark):
    rows = [(DAY, h, 1.0, 2.0, n, n) for h, n in enumerate([1, 1, 1, 9])] + [(DAY, 0, 5.0, 5.0, 7, 7)]
    got = {(r["grid_lat"], r["hour"]): r for r in grid.traffic_density(grid_rows(spark, rows)).collect()}
    std = np.std([1, 1, 1, 9], ddof=1)
    assert got[(1.0, 3)]["density_percentile"] == pytest.approx(50 + 15 * (9 - 3) / std)
    assert got[(1.0, 0)]["density_score"] == pytest.approx(1 / 9)
    assert (got[(5.0, 0)]["density_score"], got[(5.0, 0)]["density_percentile"]) == (1.0, 1.0)


def test_stress_without_density_uses_default(spark):
    pts = spark.createDataFrame(
        [(MIDNIGHT, 0.0, 0.0, 0.0, 0.0, 0.0), (MIDNIGHT + 1, 0.0, 0.0, 40000.0, 800.0, 720.0)],
        "ts bigint, lat double, lon double, alt_ft double, speed_kts double, heading_deg double",
    )
    cells = grid_rows(spark, [(DAY, 5, 9.0, 9.0, 4, 4)])
    row = stress.stress_index(cells, pts).first()
    assert row["components"]["density_component"] == 0.5
    assert row["stress_index"] == pytest.approx(0.5 * 40 + 35 + 20) and row["risk_level"] == "critical"


def test_stress_estimate(spark):
    d = grid_rows(spark, [(DAY, 5, 9.0, 9.0, 4, 4)]).withColumn("density_score", F.lit(1.0))
    row = stress.stress_estimate(d).first()
    assert row["stress_index"] == pytest.approx(40 + 0.6 * 20 + 0.45 * 25 + 0.15 * 15) and row["risk_level"] == "high"


def test_cell_border_belongs_to_both_cells(spark):
    pts = spark.createDataFrame(
        [("f", 1, 0.25, 0.0, 5.0), ("f", 2, 0.3, 0.0, 9.0), ("g", 1, 0.25, 0.25, 3.0)],
        "flight_id string, ts bigint, lat double, lon double, alt_ft double",
    )
    cells = spark.createDataFrame([(a, b) for a in (0.0, 0.5) for b in (0.0, 0.5)], "grid_lat double, grid_lon double")
    got = sorted(tuple(r) for r in grid.planes_in_cells(pts, cells).select("grid_lat", "grid_lon", "flight_id", "alt_ft").collect())
    assert got == [
        (0.0, 0.0, "f", 5.0), (0.0, 0.0, "g", 3.0), (0.0, 0.5, "g", 3.0),
        (0.5, 0.0, "f", 5.0), (0.5, 0.0, "g", 3.0), (0.5, 0.5, "g", 3.0),
    ]


def test_forecast_on_a_straight_line(spark):
    out = forecast.forecast(flights(spark, flight("f_1", line(40)), flight("g_1", line(9)))).orderBy("horizon_sec").collect()
    assert [(r["flight_id"], r["horizon_sec"]) for r in out] == [("f_1", 60), ("f_1", 120), ("f_1", 300)]
    assert out[0]["prediction_ts"] == MIDNIGHT + 200
    assert out[0]["actual_points"][0]["ts"] == MIDNIGHT + 260
    assert out[0]["error_metrics"]["mae_lateral_nm"] == pytest.approx(abs(216 * 1.852 / 399600 * 60 - 0.06) * 60)
    assert out[2]["actual_points"] == [] and out[2]["error_metrics"] is None


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
@pytest.mark.parametrize("band", [0, 10_000])
def test_percentiles_match_numpy(spark, n, band):
    values = np.random.default_rng(n).normal(size=n).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = percentiles.exact_percentiles(df, "x", [0.05, 0.5, 0.9, 0.0, 1.0], band=band)
    assert got == pytest.approx(np.percentile(values, [5, 50, 90, 0, 100]))


def test_percentiles_with_heavy_ties(spark):
    values = [1.0] * 700 + [2.0] * 290 + [3.0] * 10
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert percentiles.exact_percentiles(df, "x", [0.5, 0.7, 0.99], band=0) == pytest.approx(np.percentile(values, [50, 70, 99]))


def test_audit(spark):
    preds = spark.createDataFrame(
        [({"mae_lateral_nm": v},) if v is not None else (None,) for v in (0.1, 0.2, 0.3, 2.0, None)],
        "error_metrics struct<mae_lateral_nm:double>",
    )
    row = forecast.audit(preds).first()
    assert tuple(row) == (4, 0.65, 0.25, 1.49, "Medium")
    assert forecast.audit(preds.where("error_metrics is null")).count() == 0


def feature_rows(spark, n, outliers):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n + outliers):
        x = rng.normal([600, 50, 30000, 400, 90, 2, 2], [60, 5, 2000, 20, 20, 1, 1])
        if i >= n:
            x = x + np.array([6000, 900, 0, 0, 5000, 40, 40])
        rows.append((f"f{i:05d}", DAY, *[float(v) for v in x]))
    df = spark.createDataFrame(rows, "flight_id string, date date, " + ", ".join(f"{f} double" for f in anomaly.FEATURES))
    return df.withColumn("location", F.expr("named_struct('lat', 0.0D, 'lon', 0.0D, 'alt_ft', 0.0D)"))


def test_forest_ranks_planted_outliers_first(spark):
    df = stage(feature_rows(spark, 600, 6), "t")
    scored = anomaly.fit_detector(df).score(df).orderBy(F.col("anomaly_score").desc()).collect()
    assert {r["flight_id"] for r in scored[:6]} == {f"f{i:05d}" for i in range(600, 606)}
    assert all(0 <= r["anomaly_score"] <= 1 for r in scored)
    flagged = sum(r["anomaly_score"] > 0.5 for r in scored) / len(scored)
    assert 0.03 <= flagged <= 0.06


def test_forest_is_the_same_for_any_partitioning_and_after_reload(spark, tmp_path):
    df = feature_rows(spark, 150, 3)
    scores = []
    for n in (1, 7):
        part = stage(df.repartition(n), "t")
        model = anomaly.fit_detector(part)
        scores.append({r["flight_id"]: r["anomaly_score"] for r in model.score(part).collect()})
    assert scores[0] == pytest.approx(scores[1])
    for _ in range(2):  # a second save replaces the first
        model.save(str(tmp_path / "m"))
    other = anomaly.fit_detector(part, trees=5, version="1.0.1")
    other.save(str(tmp_path / "m"))
    assert {r["flight_id"]: r["anomaly_score"] for r in model.score_trained().collect()} == pytest.approx(scores[1])
    again = anomaly.Detector.load(spark, str(tmp_path / "m")).score(part)
    assert {r["flight_id"]: r["anomaly_score"] for r in again.collect()} == pytest.approx(scores[1])


def test_every_tree_draws_its_own_rows(spark):
    from vaportrail.operators import forest

    df = spark.range(20_000).select(F.format_string("f%05d", "id").alias("flight_id"), F.rand(1).alias("x"))
    dealt = forest.tree_samples(df, "flight_id", 20_000, trees=10, size=32).collect()
    sizes = np.bincount([r["tree"] for r in dealt])
    assert list(sizes) == [32] * 10 and 280 < len({r["flight_id"] for r in dealt})
    # the threshold only saves ranking: without it the same rows are drawn
    everything = forest.tree_samples(df, "flight_id", 1, trees=10, size=32).collect()
    assert {(r["tree"], r["flight_id"]) for r in everything} == {(r["tree"], r["flight_id"]) for r in dealt}
    own = forest.tree_samples(df.limit(100), "flight_id", 100, trees=10, size=32)
    assert {r["tree"]: r["n"] for r in own.groupBy("tree").agg(F.countDistinct("flight_id").alias("n")).collect()} == {i: 32 for i in range(10)}


def test_too_few_flights_train_nothing(spark):
    assert anomaly.fit_detector(feature_rows(spark, 99, 0)) is None


def test_explanation_takes_the_first_of_equals(spark):
    df = feature_rows(spark, 1, 0).select("flight_id", "date", "location", *[F.lit(2.0).alias(f) for f in anomaly.FEATURES])
    stats = {f: (F.lit(0.0), F.lit(1.0)) for f in anomaly.FEATURES}
    row = anomaly.with_explanation(df, stats).first()
    assert row["explanation"]["primary_factor"] == "unusual_duration_sec" and row["anomaly_type"] == "behavior"
    assert row["explanation"]["deviation_pct"] == 200.0


def test_constant_feature_scales_by_one(spark):
    df = feature_rows(spark, 5, 0).withColumn("climb_count", F.lit(3.0))
    got = {r["feature"]: r for r in anomaly.scaler(df).collect()}
    assert (got["climb_count"]["mean"], got["climb_count"]["scale"]) == (3.0, 1.0)


def test_row_numbers_follow_text_order(spark):
    ids = [f"{a}_{i:03d}" for a in ("ab", "abc", "zz9999", "0f", "abcdefgh") for i in range(7)]
    got = numbering.number_rows(spark.createDataFrame([(i,) for i in ids], "k string"), "k").collect()
    assert {r["k"]: r["row_no"] for r in got} == {k: n for n, k in enumerate(sorted(ids))}


@pytest.mark.parametrize("n, expect", [(5, 5), (399, 399), (400, 200), (1000, 200)])
def test_flight_sample_size(spark, n, expect):
    df = spark.range(n).select(F.format_string("a%06d", "id").alias("flight_id"))
    assert sampling.sample_flights(df).count() == expect
    assert sampling.sample_flights(df, hard_limit=True).count() == min(expect, 200)


def test_thinning(spark):
    thin = sampling.thin_tracks(flights(spark, flight("a", line(45)), flight("b", line(4)), flight("c", line(20))))
    got = {r["flight_id"]: [(p["ts"] - MIDNIGHT) // 10 for p in r["points"]] for r in thin.collect()}
    assert got == {"a": [0, 20, 40, 44]}


def test_hour_cut(spark):
    t = MIDNIGHT + 3600 - 20
    got = sampling.hour_tracks(flights(spark, flight("a", line(5, t0=t)), flight("b", line(3, t0=t))), 1).collect()
    assert [(r["flight_id"], len(r["points"])) for r in got] == [("a", 3)]


@pytest.mark.parametrize(
    "t, lat, heading", [(-5, 10.0, 7.0), (0, 10.0, 7.0), (5, 10.5, 0.0), (10, 11.0, 8.0), (15, 11.0, 90.0), (99, 11.0, 9.0)]
)
def test_position_at(spark, t, lat, heading):
    pts = [(0, 10.0, 20.0, 0.0, 0.0, 7.0, 0.0), (10, 11.0, 20.0, 0.0, 0.0, 8.0, 0.0), (20, 11.0, 21.0, 0.0, 0.0, 9.0, 0.0)]
    at = timetravel.position_at(F.col("points"), F.lit(float(t)))
    row = flights(spark, flight("a", pts)).select(at.alias("at")).first()["at"]
    assert row["lat"] == pytest.approx(lat) and row["heading_deg"] == pytest.approx(heading, abs=0.2)


def test_planes_at_keeps_to_the_quota(spark):
    rows = [flight(f"f{i:03d}", line(12)) for i in range(20)]
    anomalies = spark.createDataFrame([(f"f{i:03d}",) for i in range(0, 20, 2)], "flight_id string")
    got = timetravel.planes_at(flights(spark, *rows), anomalies, t=MIDNIGHT + 55, anomalous=3, normal=4).collect()
    assert sorted(r["flight_id"] for r in got if r["is_anomaly"]) == ["f000", "f002", "f004"]
    assert sorted(r["flight_id"] for r in got if not r["is_anomaly"]) == ["f001", "f003", "f005", "f007"]
    assert {len(r["trail"]) for r in got} == {6}


def test_live_planes(spark):
    preds = forecast.forecast(flights(spark, flight("a", line(100)), flight("b", line(12))))
    anomalies = spark.createDataFrame([("a", "route", 0.9, ("c",)), ("b", "speed", 0.8, ("c",))],
                                      "flight_id string, anomaly_type string, anomaly_score double, explanation struct<context:string>")
    got = {r["flight_id"]: r for r in live.live_planes(preds, anomalies).collect()}
    assert got["a"]["is_anomaly"] and len(got["a"]["actual_path"]) == 3 and got["a"]["deviation"] is not None
    assert got["a"]["heading_deg"] == pytest.approx(0.0)
    assert not got["b"]["is_anomaly"] and got["b"]["actual_path"] is None and got["b"]["heading_deg"] == 0.0
    assert live.live_planes(preds, anomalies, limit=1).count() == 1


def test_training_window_and_versions(spark):
    days = spark.sql("select explode(sequence(date'2026-01-01', date'2026-01-20')) as date")
    row = registry.training_window(days).first()
    assert (str(row["training_start"]), row["training_days"]) == ("2026-01-06", 15)
    assert registry.training_window(days, 99).first()["training_days"] == 20
    models = registry.model_metadata(registry.training_window(days), F.lit(5))
    run = F.lit("2026-01-21").cast("date")
    one = registry.next_version(models, None, run, F.lit(5))
    two = registry.next_version(models, one, run, F.lit(6))
    assert one.first()["data_version"] == "v20260121--001" and two.first()["data_version"] == "v20260121--002"
    assert two.first()["models"] == ["traj_pred_001", "anomaly_001"]


def test_a_tree_splits_values_that_are_next_to_each_other(spark):
    """The random threshold may be rounded up to the larger one."""
    import math

    from vaportrail.operators import forest

    low = 0.1
    rows = [(tree, key, x) for tree in range(20) for key, x in (("a", low), ("b", math.nextafter(low, 1.0)))]
    nodes = forest.grow_forest(spark.createDataFrame(rows, "tree int, key string, x double"), "key", ["x"], 2).collect()
    sizes = sorted((n["tree"], n["size"]) for n in nodes if n["feature"] < 0)
    assert sizes == [(tree, 1) for tree in range(20) for _ in range(2)]
