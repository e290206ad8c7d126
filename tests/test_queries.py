"""Registered queries against their SQL, at the smallest scale (the checker runs all of them at larger ones)."""

import pytest

from workload.compare import compare, connect
from workload.registry import QUERIES

SAMPLE = [
    "f7_clean", "f7_quarantine", "b5_lineage_checks", "b7_file_report", "b8_bronze_append_twice", "b10_trace_stats", "f6_dedup", "f7_retention", "w1_segments", "w3_resample", "w4_steps", "w5_flight_ids", "a1_grid_density", "a7_features",
    "m7_forecast", "a8_audit", "a5_stress", "j6_planes_in_cell", "m1_scaler", "b4_normalise", "b9_traces", "q2_density",
    "q8_planes_at", "q9_live_planes", "s13_position_at",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf_dir, con, name):
    fn, sql = QUERIES[name]
    status, detail = compare(fn(spark, sf_dir), con, sql)
    assert status in ("exact", "close"), detail


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_deviation_is_of_all_flights(spark, sf_dir, monkeypatch):
    """j8_deviation asks for every flight, whatever the display cap of live_planes."""
    from vaportrail.operators import live

    asked, live_planes = [], live.live_planes
    monkeypatch.setattr(live, "live_planes", lambda p, a, limit=1: asked.append(limit) or live_planes(p, a, limit))
    QUERIES["j8_deviation"][0](spark, sf_dir).collect()
    assert asked == [None]


def test_planted_outliers_build_the_flights_once(spark, sf_dir, monkeypatch):
    from workload import queries_gold

    plans, stage = {}, queries_gold.stage
    monkeypatch.setattr(
        queries_gold, "stage", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and stage(df, name)
    )
    QUERIES["m5_planted_outliers"][0](spark, sf_dir)
    assert "Window" in plans.pop("features") and not any("Window" in plan for plan in plans.values())
