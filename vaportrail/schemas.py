"""Table schemas. Every sink casts to these, so column types never depend on the data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "struct<ts:bigint,lat:double,lon:double,alt_ft:double,speed_kts:double,heading_deg:double,vrate_fpm:double>"
SAMPLED_POINT = "struct<ts:bigint,lat:double,lon:double,alt_ft:double,speed_kts:double,heading_deg:double>"

BRONZE = (
    "icao24 string, callsign string, timestamp bigint, latitude double, longitude double, altitude double, "
    "velocity double, heading double, vertical_rate double, on_ground boolean, squawk string, "
    "_source_file string, _ingest_ts bigint, _source_block bigint, _source_row bigint, _malformed boolean, date date"
)
TRAJECTORY = (
    f"flight_id string, icao24 string, callsign string, date date, points array<{POINT}>, duration_sec bigint, "
    "distance_nm double, max_alt_ft double, avg_speed_kts double, heading_change_total double, "
    "climb_count int, descent_count int, first_ts bigint, last_ts bigint, first_hour tinyint, last_hour tinyint, hours int"
)
ORDERED_POINT = "flight_id string, ts bigint, lat double, lon double, alt_ft double, z_key int, date date"
COMMIT = "date date, files bigint, newest bigint, rows bigint, at bigint, flights bigint, cells bigint, error string"
GRID = (
    "date date, hour tinyint, grid_lat double, grid_lon double, flight_count bigint, point_count bigint, "
    "avg_altitude_ft double, avg_speed_kts double"
)
# Mergeable state of a cell: number, mean and sum of squared differences from the mean.
CELL_HOURS = (
    "date date, hour tinyint, lat_index int, lon_index int, n bigint, alt_mean double, alt_m2 double, "
    "heading_mean double, heading_m2 double, speed_mean double, speed_m2 double"
)
CELL_DAYS = (
    "date date, lat_index int, lon_index int, n bigint, flights_mean double, flights_m2 double, points_mean double, "
    "points_m2 double, max_flights bigint"
)
DENSITY = (
    "date date, hour tinyint, grid_lat double, grid_lon double, density_score double, "
    "density_percentile double, yoy_change_pct double"
)
PREDICTION = (
    "flight_id string, prediction_ts bigint, horizon_sec int, "
    "predicted_points array<struct<ts:bigint,lat:double,lon:double,alt_ft:double,confidence:double>>, "
    "actual_points array<struct<ts:bigint,lat:double,lon:double,alt_ft:double>>, "
    "error_metrics struct<mae_lateral_nm:double,mae_vertical_ft:double,mae_temporal_sec:double>, date date"
)
ANOMALY = (
    "flight_id string, anomaly_type string, anomaly_score double, detected_at_ts bigint, "
    "explanation struct<primary_factor:string,deviation_pct:double,baseline_value:double,"
    "observed_value:double,context:string>, location struct<lat:double,lon:double,alt_ft:double>, date date"
)
STRESS = (
    "date date, hour tinyint, grid_lat double, grid_lon double, stress_index double, "
    "components struct<density_component:double,maneuver_variance_component:double,"
    "heading_conflict_component:double,anomaly_component:double>, risk_level string"
)
MODEL = (
    "model_id string, model_type string, version string, trained_at bigint, training_window_start date, "
    "training_window_end date, training_days int, validation_mae double, validation_rmse double, auc_roc double"
)
VERSION = (
    "data_version string, model_version int, training_start date, training_end date, "
    "last_trained bigint, models array<string>"
)
PUBLISHED = f"{VERSION}, folder string"
SAMPLED = f"flight_id string, points array<{SAMPLED_POINT}>"


def struct_type(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select and cast exactly the columns of ``ddl``; a column the input lacks becomes null."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in struct_type(ddl).fields
        ]
    )
