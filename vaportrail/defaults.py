"""Default parameters. Results depend on them."""

TRAINING_DAYS = 15
BRONZE_ROWS_PER_FILE = 5_000_000  # a few hundred megabytes
FLIGHTS_PER_PAGE = 128  # of a stored file, sorted by first hour: what an hour filter reads at least
RESAMPLE_STEP_SEC = 10
MAX_GAP_SEC = 300
GRID_DEG = 0.5
HORIZONS_SEC = (60, 120, 300)
ANOMALY_THRESHOLD = 0.7
FOREST_TREES = 100
FOREST_SUBSAMPLE = 256
FOREST_CONTAMINATION = 0.05
FOREST_SEED = 42
MIN_TRAINING_FLIGHTS = 100
MIN_FORECAST_POINTS = 10
SAMPLE_FLIGHTS = 200
SAMPLE_EVERY = 20
TRAIL_SEC = 300
PLAYBACK_SLICE_SEC = 3600
KEPT_GOLD_RUNS = 2
QUOTA_ANOMALY = 50
QUOTA_NORMAL = 50
MAX_LIVE_PLANES = 1500
MAX_PATH_PAIRS = 200

# Valid ranges: degrees, feet, knots.
LAT_RANGE = (-90.0, 90.0)
LON_RANGE = (-180.0, 180.0)
ALT_RANGE = (-1000.0, 60000.0)
SPEED_RANGE = (0.0, 700.0)
