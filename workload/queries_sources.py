"""Sources and sinks: derived tables are written to the shared folder in the raw formats and ingested back."""

import gzip

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vaportrail.functions import text
from vaportrail.functions.geo import epoch_date, midnight_epoch
from vaportrail.plans import bronze, gold, silver
from vaportrail.session import new_stage_path, stage
from vaportrail.sources import archives, columns, tables, traces
from workload import derived
from workload.ctes import build
from workload.registry import query
from workload.rounding import r

BRONZE_SQL = """icao24, callsign, ts AS timestamp, lat AS latitude, lon AS longitude, alt AS altitude, spd AS velocity, hdg AS heading,
  vr AS vertical_rate, on_ground, squawk"""
BRONZE_COLS = [
    "icao24", "callsign", "timestamp", "latitude", "longitude", "altitude", "velocity", "heading", "vertical_rate",
    "on_ground", "squawk",
]
HEADERS = {
    "icao24": "icao24", "callsign": "callsign", "timestamp": "time", "latitude": "lat", "longitude": "lon",
    "altitude": "baroaltitude", "velocity": "velocity", "heading": "heading", "vertical_rate": "vertrate",
    "on_ground": "onground", "squawk": "squawk",
}


def raw_files(spark, d):
    return derived.raw_reports(spark, d).select(*[F.col(c).alias(h) for c, h in HEADERS.items()])


@query("b1_csv_gz_archive", build(f"SELECT {BRONZE_SQL} FROM sv", "sv"))
def b1(spark, d):
    folder = new_stage_path(spark, "csv")
    raw_files(spark, d).write.option("header", True).option("compression", "gzip").csv(folder)
    return archives.read_directory(spark, folder).bronze.select(*BRONZE_COLS)


@query("b1_parquet_archive", build(f"SELECT {BRONZE_SQL} FROM sv", "sv"))
def b1_parquet(spark, d):
    folder = new_stage_path(spark, "parquet")
    raw_files(spark, d).write.parquet(folder)
    return archives.read_directory(spark, folder, "*.parquet").bronze.select(*BRONZE_COLS)


@query(
    "b2_b7_mixed_headers",
    build("SELECT icao24, ts AS timestamp, lat AS latitude, alt AS altitude, squawk FROM sv UNION ALL SELECT icao24, ts, lat, alt, '' FROM sv", "sv"),
)
def b2_b7(spark, d):
    """Two header styles in different column order, one without squawk, ingested together."""
    folder = new_stage_path(spark, "mixed")
    full = raw_files(spark, d)
    other = full.select(
        F.col("baroaltitude").alias("ALT"), F.col("lat").alias("position_lat"), F.col("time").alias("Epoch"),
        F.col("icao24").alias("hex"),
    )
    full.write.option("header", True).csv(folder)
    other.write.mode("append").option("header", True).csv(folder)
    return archives.read_directory(spark, folder).bronze.select("icao24", "timestamp", "latitude", "altitude", "squawk")


@query(
    "b4_normalise",
    build(
        """SELECT icao24, callsign, ts AS timestamp, CASE WHEN event_id % 11 = 0 THEN NULL ELSE alt END AS altitude,
  CASE lower(ground_text) WHEN 'true' THEN true WHEN 'false' THEN false WHEN 'f' THEN false END AS on_ground, coalesce(squawk, '') AS squawk,
  NULL::DOUBLE AS heading FROM raw""",
        "raw",
    ),
)
def b4(spark, d):
    raw = derived.raw_reports(spark, d)
    eid = ((F.col("timestamp") - derived.EPOCH0) / 4).cast("bigint")
    odd = raw.select(
        F.col("icao24").alias("HEX"), F.col("callsign").alias("Flight"),
        F.concat(F.col("timestamp").cast("string"), F.lit(".75")).alias("EPOCH"),
        F.when(eid % 11 == 0, "ground").otherwise(F.col("altitude").cast("string")).alias("Alt"),
        F.col("on_ground").alias("Ground"), F.col("squawk").alias("Transponder"),
    )
    typed = columns.normalise(odd)
    return typed.select("icao24", "callsign", "timestamp", "altitude", "on_ground", "squawk", "heading")


@query("b5_lineage")
def b5(spark, d):
    folder = new_stage_path(spark, "csv")
    raw_files(spark, d).write.option("header", True).csv(folder)
    return archives.file_stats(archives.read_directory(spark, folder).bronze)


@query("b5_lineage_checks", build("SELECT count(*) AS rows, 0::BIGINT AS unnamed, true AS one_time_each FROM sv", "sv"))
def b5_checks(spark, d):
    """Every row names its file, and a file's rows share one ingest time."""
    folder = new_stage_path(spark, "csv")
    raw_files(spark, d).write.option("header", True).csv(folder)
    rows = archives.read_directory(spark, folder).bronze
    files = rows.groupBy("_source_file").agg(F.count("*").alias("n"), F.countDistinct("_ingest_ts").alias("times"))
    return files.agg(
        F.sum("n").alias("rows"), F.count_if(F.col("_source_file").isNull()).alias("unnamed"), (F.max("times") == 1).alias("one_time_each")
    )


@query(
    "b7_file_report",
    build(
        """SELECT count(*) AS total_rows, count(*) FILTER (event_id % 13 = 0) AS malformed_rows,
  count(*) FILTER (event_id % 17 = 0) AS rows_without_id, 0::BIGINT AS errors FROM raw""",
        "raw",
    ),
)
def b7_report(spark, d):
    """Lines with a field too many and rows without an aircraft id are stored and counted."""
    folder, out = new_stage_path(spark, "odd"), new_stage_path(spark, "bronze")
    eid = ((F.col("time") - derived.EPOCH0) / 4).cast("bigint")
    odd = raw_files(spark, d).withColumns(
        {
            "icao24": F.when(eid % 17 != 0, F.col("icao24")),
            "squawk": F.when(eid % 13 == 0, F.lit("1200,surplus")).otherwise(F.coalesce("squawk", F.lit("0000"))),
        }
    )
    odd.write.option("header", True).option("quote", "").csv(folder)
    report = bronze.ingest_archives(spark, folder, out)
    return report.agg(
        *[F.sum(c).alias(c) for c in ("total_rows", "malformed_rows", "rows_without_id")], F.count("error").alias("errors")
    )


@query(
    "b6_file_date",
    build(
        """SELECT name, CASE WHEN regexp_matches(name, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN regexp_extract(name, '[0-9]{4}-[0-9]{2}-[0-9]{2}')
  WHEN regexp_matches(name, '[0-9]{8}') THEN substr(regexp_extract(name, '[0-9]{8}'), 1, 4) || '-' || substr(regexp_extract(name, '[0-9]{8}'), 5, 2) || '-' || substr(regexp_extract(name, '[0-9]{8}'), 7, 2)
  END AS file_date, count(*) AS n FROM (
  SELECT CASE ts // 4 % 4 WHEN 0 THEN date::VARCHAR || '.csv.gz' WHEN 1 THEN 'states_' || date::VARCHAR || '.csv'
    WHEN 2 THEN 'feed_' || strftime(date, '%Y%m%d') || '.csv.gz' ELSE 'nodate.csv' END AS name FROM sv) GROUP BY ALL""",
        "sv",
    ),
)
def b6(spark, d):
    kind = (F.col("timestamp") / 4).cast("bigint") % 4
    day = F.col("date").cast("string")
    name = (
        F.when(kind == 0, F.concat(day, F.lit(".csv.gz")))
        .when(kind == 1, F.concat(F.lit("states_"), day, F.lit(".csv")))
        .when(kind == 2, F.concat(F.lit("feed_"), F.date_format("date", "yyyyMMdd"), F.lit(".csv.gz")))
        .otherwise("nodate.csv")
    )
    named = derived.state_vectors(spark, d).select(name.alias("name"))
    return named.groupBy("name", text.file_date_text(F.col("name")).alias("file_date")).agg(F.count("*").alias("n"))


def stored_bronze(spark, d, times=1):
    path = new_stage_path(spark, "bronze")
    rows = derived.state_vectors(spark, d)
    for _ in range(times):
        files = rows.select("date", "_source_file").distinct()
        fresh = tables.not_stored(spark, path, files, F.lit(True))
        tables.append_bronze(rows.join(fresh, ["date", "_source_file"], "left_semi"), path)
    return path


@query("b8_bronze_append_twice", build(f"SELECT {BRONZE_SQL}, date, src AS _source_file FROM sv", "sv"))
def b8(spark, d):
    """Storing the same files a second time adds nothing."""
    path = stored_bronze(spark, d, times=2)
    return tables.load_bronze(spark, path).select(*BRONZE_COLS, "date", "_source_file")


@query("b8_ingest_ledger", build(f"SELECT {BRONZE_SQL} FROM sv", "sv"))
def b8_ledger(spark, d):
    """A folder that grows between ingests, looked at three times: the ledger lets every file in once."""
    folder, path = new_stage_path(spark, "growing"), new_stage_path(spark, "bronze")
    raw = raw_files(spark, d)
    late = F.xxhash64("icao24") % 2 == 0
    raw.where(late).select(*sorted(raw.columns)).write.option("header", True).csv(folder)
    bronze.ingest_archives(spark, folder, path)
    raw.where(~late).write.mode("append").option("header", True).option("compression", "gzip").csv(folder)
    for _ in range(2):
        bronze.ingest_archives(spark, folder, path, files_per_commit=3)
    return tables.load_bronze(spark, path).select(*BRONZE_COLS)


@query(
    "b12_load_date",
    build(f"SELECT {BRONZE_SQL} FROM sv WHERE date = DATE '2025-12-25'", "sv"),
)
def b12(spark, d):
    return tables.load_bronze(spark, stored_bronze(spark, d), date="2025-12-25").select(*BRONZE_COLS)


@F.pandas_udf(T.BinaryType())
def _zip(content: pd.Series) -> pd.Series:
    return content.map(lambda b: gzip.compress(b, mtime=0))


def trace_files(spark, d):
    """One trace document per aircraft-day, as (path, content); every second aircraft's is gzipped.

    Error events report ``"ground"`` as altitude; every aircraft-day also gets one point that is too short.
    """
    rep = derived.state_vectors(spark, d)

    def js(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))

    alt = F.when(F.col("callsign").startswith("ERROR"), F.lit('"ground"')).otherwise(js("altitude"))
    extra = F.concat(F.lit('{"flight":"'), F.col("callsign"), F.lit(' ","squawk":"'), F.col("squawk"), F.lit('"}'))
    point = F.concat(
        F.lit("["),
        F.concat_ws(
            ",", (F.col("timestamp") - midnight_epoch(F.col("date"))).cast("string"), js("latitude"), js("longitude"),
            alt, js("velocity"), js("heading"), F.when(F.col("on_ground"), "1").otherwise("0"), js("vertical_rate"),
            F.when(F.col("squawk") == "", "null").otherwise(extra),
        ),
        F.lit("]"),
    )
    docs = rep.groupBy("date", "icao24").agg(F.concat_ws(",", F.collect_list(point)).alias("pts"))
    body = F.encode(F.concat(F.lit('{"trace":['), F.col("pts"), F.lit(",[1,2,3]]}")), "utf-8")
    odd = F.substring("icao24", -1, 1).cast("int") % 2 == 1
    return docs.select(
        F.concat_ws(
            "", F.lit("/data/"), F.col("date").cast("string"), F.lit("/traces/trace_full_~"), "icao24", F.lit(".json")
        ).alias("path"),
        F.when(odd, _zip(body)).otherwise(body).alias("content"),
    )


TRACE_SQL = """SELECT icao24, CASE WHEN squawk = '' THEN '' ELSE callsign END AS callsign, ts AS timestamp, lat AS latitude, lon AS longitude,
  alt AS altitude, spd AS velocity, hdg AS heading, vr AS vertical_rate, coalesce(on_ground, false) AS on_ground, squawk, date,
  'trace_full_~' || icao24 || '.json' AS _source_file FROM sv WHERE NOT starts_with(callsign, 'ERROR')"""


@query("b9_traces", build(TRACE_SQL, "sv"))
def b9(spark, d):
    return traces.decode_traces(trace_files(spark, d)).drop("_ingest_ts", "_source_block", "_source_row", "_malformed")


@query(
    "b10_trace_stats",
    build(
        f"""SELECT count(n) AS files_processed, count(*) - count(n) AS files_failed, sum(n)::BIGINT AS total_records FROM
  (SELECT DISTINCT date, icao24, 'trace_full_~' || icao24 || '.json' AS f FROM sv) LEFT JOIN (SELECT date, _source_file AS f, count(*) AS n
  FROM ({TRACE_SQL}) WHERE icao24 NOT LIKE '%7' GROUP BY date, f) USING (date, f)""",
        "sv",
    ),
)
def b10(spark, d):
    """All dates, an aircraft's file having the same name in each; those of some aircraft cannot be decoded."""
    broken = F.col("path").endswith("7.json")
    cut = F.when(broken, F.expr("substring(content, 1, 9)")).otherwise(F.col("content"))
    files = stage(trace_files(spark, d).withColumn("content", cut), "traces")
    return traces.trace_stats(files, traces.decode_traces(files))


def stored_silver(spark, d):
    path = new_stage_path(spark, "silver")
    source = stored_bronze(spark, d)
    silver.build_silver(spark, source, path)
    return source, path


@query(
    "b14_silver_sink",
    build(
        "SELECT date, hour, grid_lat, grid_lon, flight_count, point_count, round(avg_altitude_ft, 6) AS avg_altitude_ft, round(avg_speed_kts, 6) AS avg_speed_kts FROM grid",
        "grid",
    ),
)
def b14(spark, d):
    _, path = stored_silver(spark, d)
    return tables.load_grid(spark, path).select(
        "date", F.col("hour").cast("int").alias("hour"), "grid_lat", "grid_lon", "flight_count", "point_count",
        r("avg_altitude_ft"), r("avg_speed_kts"),
    )


@query(
    "b15_load_range",
    build(
        "SELECT flight_id, callsign, n_points, duration_sec, round(distance_nm, 5) AS distance_nm FROM flights WHERE date BETWEEN DATE '2025-12-26' AND DATE '2025-12-28'",
        "flights",
    ),
)
def b15(spark, d):
    _, path = stored_silver(spark, d)
    return tables.load_trajectories(spark, path, "2025-12-26", "2025-12-28").select(
        "flight_id", "callsign", F.size("points").alias("n_points"), "duration_sec", r("distance_nm", 5)
    )


@query("b17_points_only", build("SELECT date, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM points GROUP BY date", "points"))
def b17(spark, d):
    _, path = stored_silver(spark, d)
    pts = tables.load_points(spark, path)
    return pts.groupBy("date").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(
    "a14_silver_stats",
    build(
        """SELECT s.date, bronze_records, clean_records, trajectory_count, density_cells FROM (SELECT date, count(*) AS bronze_records FROM sv GROUP BY date) s
  JOIN (SELECT date, count(*) AS clean_records FROM clean GROUP BY date) c USING (date) JOIN (SELECT date, count(*) AS trajectory_count FROM ids GROUP BY date) i USING (date)
  JOIN (SELECT date, count(*) AS density_cells FROM grid GROUP BY date) g USING (date)""",
        "clean",
        "ids",
        "grid",
    ),
)
def a14(spark, d):
    source, path = stored_silver(spark, d)
    return silver.silver_stats(spark, source, path)


@query(
    "b16_gold_sink",
    build(
        """SELECT 'traffic_density' AS artifact, count(*) AS records FROM density UNION ALL SELECT 'predictions', count(*) FROM pred
  UNION ALL SELECT 'airspace_stress', count(*) FROM stress""",
        "density",
        "pred",
        "stress",
    ),
)
def b16(spark, d):
    """Row counts of the Gold tables written by the whole job (the outlier count has no SQL)."""
    _, path = stored_silver(spark, d)
    out = new_stage_path(spark, "gold")
    gold.build_gold(spark, path, out)
    return gold.gold_stats(spark, out).where("artifact <> 'anomalies'")
