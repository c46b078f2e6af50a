"""Column layouts and fixed values shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

PRICES = ["open", "high", "low", "close"]
OHLCV = PRICES + ["volume"]

RAW_MINUTES = T.StructType(
    [T.StructField("ts_event", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in OHLCV]
    + [T.StructField("symbol", T.StringType())]
)

BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in OHLCV]
)

# They must equal the reference's for right results.
MARKET_TIME_ZONE = "America/New_York"
BARS_PER_YEAR = 252 * 390
REGIME_NAMES = [
    "Range + Low Volatility",
    "Trend + Low Volatility",
    "Trend + High Volatility",
    "Range + High Volatility",
]
RISK_REGIMES = ["Trend + High Volatility", "Range + High Volatility"]
STRATEGIES = ["sma_cross", "donchian", "rsi_mr", "zscore_mr", "ml_rf", "ml_logreg", "ml_gbrt"]
VARIANTS = ["baseline", "regime_aware", "liquidity_filtered"]
STRESS_MODELS = ["gbm", "regime_mixture_gbm", "block_bootstrap"]
CAPITAL = 100_000.0
COST_BPS = 0.25
TINY = 1e-12
