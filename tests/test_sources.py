import gzip
import json

import pytest
from helpers import MIDNIGHT, frame, report
from pyspark.sql import functions as F

from vaportrail import schemas
from vaportrail.plans import bronze, gold, silver, views
from vaportrail.sources import archives, columns, ledger, tables, traces
from vaportrail.streaming.ingest import ingest_new_files

HEAD = "time,icao24,lat,lon,velocity,heading,vertrate,callsign,onground,squawk,baroaltitude"


def csv_line(ts, icao="000123", alt="1000"):
    return f"{ts},{icao},10.5,20.5,200,90,0,UAL1,true,0042,{alt}"


@pytest.fixture
def folder(tmp_path):
    f = tmp_path / "in"
    f.mkdir()
    with gzip.open(f / "2026-01-15.csv.gz", "wt") as out:
        out.write("\n".join([HEAD, csv_line(MIDNIGHT), csv_line(MIDNIGHT + 10, alt="ground")]) + "\n")
    (f / "states_2026-01-15.csv").write_text("Hex,Lon,LAT,epoch\nabc,1.0,2.0,7.9\n")
    (f / "feed_20260116.csv.gz").write_bytes(gzip.compress(b"ts,lat,lng,icao,vs\n5,1,2,def,notanumber\n"))
    (f / "bad_2026-01-17.csv.gz").write_bytes(b"\x1f\x8bnot really gzip")
    (f / "empty_2026-01-17.csv").write_text("")
    return f


def test_detection_takes_the_first_alias_ignoring_case():
    assert columns.detect_columns(["ALT", "BaroAltitude", "epoch", "Time", "x"]) == {"timestamp": "Time", "altitude": "BaroAltitude"}


def test_unsupported_suffix(spark):
    with pytest.raises(ValueError):
        archives.archive_format("/x/y.xlsx")
    assert archives.archive_format("/x/2026-01-15.CSV.GZ") == archives.archive_format("dump.gz") == "csv"


def test_directory_ingest_isolates_bad_files(spark, folder, tmp_path):
    out = str(tmp_path / "bronze")
    got = {r["source_file"]: r for r in bronze.ingest_archives(spark, str(folder), out).collect()}
    assert {k: v["total_rows"] for k, v in got.items()} == {
        "2026-01-15.csv.gz": 2, "states_2026-01-15.csv": 1, "feed_20260116.csv.gz": 1,
        "bad_2026-01-17.csv.gz": 0, "empty_2026-01-17.csv": 0,
    }
    assert got["bad_2026-01-17.csv.gz"]["error"] and got["empty_2026-01-17.csv"]["error"]
    rows = {(r["_source_file"], r["timestamp"]): r for r in tables.load_bronze(spark, out).collect()}
    first = rows[("2026-01-15.csv.gz", MIDNIGHT)]
    assert (first["icao24"], first["altitude"], first["on_ground"], first["squawk"]) == ("000123", 1000.0, True, "0042")
    assert rows[("2026-01-15.csv.gz", MIDNIGHT + 10)]["altitude"] is None
    other = rows[("states_2026-01-15.csv", 7)]
    assert (other["icao24"], other["latitude"], other["longitude"], other["callsign"]) == ("abc", 2.0, 1.0, "")
    assert rows[("feed_20260116.csv.gz", 5)]["vertical_rate"] is None
    # both archives of one date are there, and a second run adds nothing
    assert tables.load_bronze(spark, out, date="2026-01-15").count() == 3
    bronze.ingest_archives(spark, str(folder), out)
    assert tables.load_bronze(spark, out).count() == 4


def test_malformed_lines_and_missing_ids_are_counted(spark, tmp_path):
    f = tmp_path / "odd"
    f.mkdir()
    lines = [HEAD, csv_line(MIDNIGHT), csv_line(MIDNIGHT + 1) + ",7,8", "5,abc,1.0", csv_line(MIDNIGHT + 2, icao="")]
    (f / "2026-01-15.csv").write_text("\n".join(lines) + "\n")
    got = bronze.ingest_archives(spark, str(f), str(tmp_path / "bronze")).first()
    assert (got["total_rows"], got["malformed_rows"], got["rows_without_id"]) == (4, 2, 1)


def test_header_names_are_those_of_the_csv_reader(spark, tmp_path):
    for i, line in enumerate(["a,b", "a,,c", "a,A,b", '"x, y",z', "\ufeffa,b"]):
        (tmp_path / f"{i}.csv").write_text(f"\n{line}\n1,2,3\n")
        want = [c.removeprefix("\ufeff") for c in archives.read_archive(spark, str(tmp_path / f"{i}.csv")).columns]
        assert archives.header_columns(line) == want


def test_two_thousand_files_are_a_few_jobs(spark, tmp_path):
    f, out = tmp_path / "many", str(tmp_path / "bronze")
    f.mkdir()
    (f / "a b%20.csv").write_text("")
    for i in range(2000):
        head = HEAD if i % 2 else "epoch,HEX,lat,lon"
        line = csv_line(MIDNIGHT + i) if i % 2 else f"{MIDNIGHT + i},abc,1,2"
        (f / f"{i}_2026-01-{15 + i % 3}.csv").write_text(f"{head}\n{line}\n")
    spark.sparkContext.setJobGroup("many files", "")
    got = bronze.ingest_archives(spark, str(f), out)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many files"))
    spark.sparkContext.setJobGroup("others", "")
    assert jobs < 60
    assert got.agg(F.count("*"), F.sum("total_rows"), F.count("error")).first()[:] == (2001, 2000, 1)
    assert tables.load_bronze(spark, out).agg(F.count("*"), F.countDistinct("_source_file")).first()[:] == (2000, 2000)
    signatures = ledger.entries(spark, out).where("status = 'done'").groupBy("signature").count().collect()
    assert sorted(r["count"] for r in signatures) == [1000, 1000]


class Killed(Exception):
    pass


@pytest.mark.parametrize("moment", ["before", "half", "after"])
def test_a_killed_ingest_adds_nothing_twice(spark, folder, tmp_path, monkeypatch, moment):
    out, whole = str(tmp_path / "bronze"), str(tmp_path / "whole")
    (folder / "feed.csv").write_text("\n".join([HEAD, csv_line(MIDNIGHT)]) + "\n")  # undated
    early = tmp_path / "early"
    early.mkdir()
    (early / "first_2026-01-15.csv").write_text("\n".join([HEAD, csv_line(MIDNIGHT + 5)]) + "\n")
    for path in (out, whole):
        bronze.ingest_archives(spark, str(early), path)
    append = tables.append_bronze

    def killed(rows, path):
        if moment == "half":  # the files of a job that was committed in part
            append(rows.where("altitude is not null"), path)
        elif moment == "after":
            append(rows, path)
        raise Killed

    monkeypatch.setattr(tables, "append_bronze", killed)
    with pytest.raises(Killed):
        bronze.ingest_archives(spark, str(folder), out)
    monkeypatch.undo()
    bronze.ingest_archives(spark, str(folder), whole)
    report = bronze.ingest_archives(spark, str(folder), out)
    assert {r["source_file"]: r["total_rows"] for r in report.collect() if not r["error"]} == {
        "2026-01-15.csv.gz": 2, "states_2026-01-15.csv": 1, "feed_20260116.csv.gz": 1, "feed.csv": 1
    }
    columns_ = [c for c in tables.load_bronze(spark, out).columns if c not in ("_ingest_ts", "_source_row", "_source_block")]
    rows = lambda path: sorted(map(str, tables.load_bronze(spark, path).select(*columns_).collect()))
    assert rows(out) == rows(whole) and len(rows(out)) == 6
    assert bronze.ingest_archives(spark, str(folder), out).where("error is null").count() == 0


def test_undated_files_are_stored_once_whatever_the_day(spark, tmp_path):
    f, out = tmp_path / "undated", str(tmp_path / "bronze")
    f.mkdir()
    (f / "feed.csv").write_text("\n".join([HEAD, csv_line(MIDNIGHT), csv_line(MIDNIGHT + 1)]) + "\n")
    batch = archives.open_files(spark, [str(f / "feed.csv")])
    # as if it had been stored the day before
    tables.append_bronze(batch.bronze.withColumn("date", F.date_sub(F.current_date(), 1)), out)
    assert bronze.ingest_archives(spark, str(f), out).count() == 0
    assert tables.load_bronze(spark, out).count() == 2


def test_trace_statistics_keep_dates_apart(spark, tmp_path):
    point = [10, 1, 2, 3000, 5, 5, 0, 0, None]
    for day, body in (("2026-01-15", {"trace": [point] * 4}), ("2026-01-16", None)):
        folder = tmp_path / "in" / day
        folder.mkdir(parents=True)
        (folder / "trace_full_a1.json").write_bytes(json.dumps(body).encode() if body else b"{broken")
    out = str(tmp_path / "bronze")
    for _ in range(2):
        assert tuple(bronze.ingest_traces(spark, str(tmp_path / "in"), out).first()) == (1, 1, 4)
    assert tables.load_bronze(spark, out).count() == 4


def test_first_row_of_a_file_wins(spark, tmp_path):
    f = tmp_path / "one"
    f.mkdir()
    (f / "2026-01-15.csv").write_text("\n".join([HEAD] + [csv_line(MIDNIGHT, alt=str(a)) for a in (3, 1, 2)]) + "\n")
    out = str(tmp_path / "bronze")
    bronze.ingest_archives(spark, str(f), out)
    from vaportrail.operators.clean import clean_reports

    kept = clean_reports(tables.load_bronze(spark, out), tables.FILE_ORDER).collect()
    assert [r["altitude"] for r in kept] == [3.0]
    assert "_source_row" not in kept[0].asDict()


def test_bronze_schema_is_enforced(spark, folder, tmp_path):
    out = str(tmp_path / "bronze")
    bronze.ingest_archives(spark, str(folder), out)
    stored = spark.read.parquet(out)
    want = {f.name: f.dataType for f in schemas.struct_type(schemas.BRONZE).fields}
    assert {f.name: f.dataType for f in stored.schema.fields} == want


def trace(name, body, zipped=False):
    raw = body if isinstance(body, bytes) else json.dumps(body).encode()
    return name, gzip.compress(raw) if zipped else raw


def test_traces(spark, tmp_path):
    day = tmp_path / "2026-01-15" / "traces" / "23"
    day.mkdir(parents=True)
    ok = [0.9, 1.0, 2.0, 3000, 250.5, 90, 1, -64, {"flight": "UAL1  ", "squawk": "1200"}, "adsb", 3100]
    files = dict(
        [
            trace("trace_full_a1b2c3.json", {"icao": "a1b2c3", "trace": [ok, [10, 1, 2, "ground", 5, 5, 0, 0, None], [11, 1, 2]]}),
            trace("trace_full_~ddeeff.json", {"trace": [[1768435260.7, 1, 2, None, None, None, None, None, None, 5]]}, True),
            trace("trace_full_empty.json", {"icao": "e", "trace": []}),
            trace("trace_full_bad.json", b"{not json"),
            trace("trace_full_trunc.json", gzip.compress(b"{}")[:8]),
        ]
    )
    for name, content in files.items():
        (day / name).write_bytes(content)
    (day / "other.json").write_text("{}")
    out = str(tmp_path / "bronze")
    stats = bronze.ingest_traces(spark, str(tmp_path / "2026-01-15"), out).first()
    assert tuple(stats) == (2, 3, 2)
    rows = {r["icao24"]: r for r in tables.load_bronze(spark, out).collect()}
    a = rows["a1b2c3"]
    assert (a["timestamp"], a["altitude"], a["callsign"], a["squawk"], a["on_ground"]) == (MIDNIGHT, 3000.0, "UAL1", "1200", True)
    d = rows["ddeeff"]
    assert (d["timestamp"], d["altitude"], d["callsign"], d["on_ground"], str(d["date"])) == (1768435260, None, "", None, "2026-01-15")


def test_overwrite_of_all_or_of_own_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    days = spark.sql("select explode(sequence(date'2026-01-01', date'2026-01-03')) as date, 'f' as flight_id")

    def dates():
        return sorted(str(r["date"]) for r in tables.read_table(spark, path, "flight_id string, date date").collect())

    tables.write_table(days, path, "flight_id string, date date")
    one = days.where("date = date'2026-01-02'")
    tables.write_table(one, path, "flight_id string, date date", only_own_partitions=True)
    assert len(dates()) == 3
    tables.write_table(one, path, "flight_id string, date date")
    assert dates() == ["2026-01-02"]


def test_date_pruning_reaches_the_scan(spark, folder, tmp_path):
    out = str(tmp_path / "bronze")
    bronze.ingest_archives(spark, str(folder), out)
    from vaportrail.operators.clean import valid_report

    df = tables.load_bronze(spark, out, date="2026-01-15").where(valid_report()).select("icao24", "timestamp")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "GreaterThanOrEqual(latitude,-90.0)" in plan
    assert "squawk" not in plan


def test_streaming_ingest_stores_each_file_once(spark, tmp_path):
    f = tmp_path / "in"
    f.mkdir()
    out, mark = str(tmp_path / "bronze"), str(tmp_path / "mark")
    names = HEAD.split(",")
    for n in (15, 16):
        (f / f"2026-01-{n}.csv").write_text("\n".join([HEAD, csv_line(MIDNIGHT)]) + "\n")
        ingest_new_files(spark, str(f), out, mark, names).awaitTermination(120)
    # the batch ingest finds nothing left to do
    assert bronze.ingest_archives(spark, str(f), out).count() == 0
    got = spark.read.parquet(out).groupBy("date").count().orderBy("date").collect()
    assert [(str(r["date"]), r["count"]) for r in got] == [("2026-01-15", 1), ("2026-01-16", 1)]


def test_layers_end_to_end(spark, tmp_path):
    rows = []
    for i in range(130):
        rows += [
            report(MIDNIGHT + i * 60 + t, icao=f"a{i:05d}", lat=10 + i * 0.01 + t * 1e-4, alt=1000.0 + 50 * i, vr=600.0 * (t // 50 % 2))
            for t in range(0, 600, 12)
        ]
    b, s, g = (str(tmp_path / n) for n in ("b", "s", "g"))
    tables.append_bronze(frame(spark, rows), b)
    silver.build_silver(spark, b, s)
    stats = silver.silver_stats(spark, b, s).first()
    assert (stats["bronze_records"], stats["clean_records"], stats["trajectory_count"]) == (6500, 6500, 130)
    for _ in range(2):
        gold.build_gold(spark, s, g)
    counts = {r["artifact"]: r["records"] for r in gold.gold_stats(spark, g).collect()}
    assert counts["predictions"] == 390 and counts["traffic_density"] == stats["density_cells"]
    versions = gold.load_versions(spark, g)
    assert sorted(r["model_version"] for r in versions.collect()) == [1, 2]
    models = tables.read_table(spark, f"{g}/metadata/models", schemas.MODEL)
    meta = views.metadata(models, versions, spark.read.parquet(f"{g}/metadata/date_index")).first()
    assert meta["data_version"].endswith("--002") and meta["date_range"]["start"] == "2026-01-15"
    assert [m["model_id"] for m in meta["models"]] == ["anomaly_001", "traj_pred_001"]
    pred = views.predictions(gold.load_artifact(spark, g, "predictions"), date="2026-01-15", horizon=60, limit=7)
    assert pred.count() == 7
    plan = pred._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(horizon_sec,60)" in plan
    sampled = tables.read_table(spark, f"{g}/sampled_trajectories", schemas.SAMPLED)
    assert views.trajectories(sampled, hour=0).count() > 0
    quality = views.prediction_quality(spark.read.parquet(f"{g}/metadata/audit"), versions).first()
    assert quality["model_version"] == 2 and quality["sample_count"] > 0
    stamped = views.stamped(views.density(gold.load_artifact(spark, g, "traffic_density"), hour=0), versions)
    assert {r["data_version"] for r in stamped.select("data_version").distinct().collect()} == {meta["data_version"]}
