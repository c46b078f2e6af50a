"""Bar analytics on Spark: clean bars, features, regimes, signals, backtests, stress."""
