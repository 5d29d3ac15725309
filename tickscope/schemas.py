"""Column names, model inputs and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw bar columns (one row per series and bar time).
KEY = "ticker"
TIME = "Date"
OHLCV = ["Open", "High", "Low", "Close", "Volume"]

BARS_SCHEMA = T.StructType([
    T.StructField(KEY, T.StringType(), False),
    T.StructField(TIME, T.TimestampNTZType(), False),
    *[T.StructField(c, T.DoubleType(), True) for c in OHLCV],
])

# Fixed values that must equal the reference for the same results.
# Feature columns added to every bar, in the reference's order.
FEATURE_COLS_ALL = [
    "daily_return", "log_return", "price_range", "volatility_20d",
    "volume_change", "volume_zscore", "ma_20", "ma_50",
    "price_vs_ma20", "price_vs_ma50", "momentum_5d", "momentum_20d",
]
# Model inputs, in the reference's order (all features except the two moving averages).
MODEL_FEATURES = [
    "daily_return", "log_return", "price_range", "volatility_20d",
    "volume_change", "volume_zscore", "price_vs_ma20", "price_vs_ma50",
    "momentum_5d", "momentum_20d",
]
# Longest look-back of any feature: the 50-bar moving average needs 49 earlier bars.
WARMUP_BARS = 49
N_TREES = 300                 # isolation-forest size
MAX_SAMPLES = 256             # per-tree sample size (capped by series length)
SEED = 42
ANOMALY_PERCENTILE = 0.02     # per-series score quantile used as IF threshold
FALLBACK_THRESHOLD = -0.60    # threshold when no stored results exist
INTERVAL_Z = 1.959963984540054  # two-sided 95 % normal quantile for the band
MIN_LIVE_BARS = 60            # live scorer needs at least this many raw bars
LIVE_LOOKBACK_DAYS = 90
ROLLING_RATE_BARS = 30
TOP_ANOMALIES = 15
LIVE_SOURCE = "live_IF_only"
CONSENSUS_SOURCE = "consensus"

RESULT_FLAG_COLS = ["if_anomaly", "band_anomaly", "consensus_anomaly"]
