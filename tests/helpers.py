"""Small fixtures shared by the tests."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

START = datetime(2024, 1, 1, 9, 30)


def bars_frame(spark, rows=300, symbols=("AA", "BB"), seed=7):
    """Random walk minute bars with an ordinal."""
    rng = np.random.default_rng(seed)
    parts = []
    for s in symbols:
        r = rng.normal(0, 0.001, rows)
        close = 100 * np.cumprod(1 + r)
        gap = np.maximum(0.05, 4 * close * np.abs(r))
        parts.append(
            pd.DataFrame(
                {
                    "symbol": s, "idx": np.arange(rows), "date": [START + timedelta(minutes=7 * i) for i in range(rows)],
                    "open": close, "high": close + gap, "low": close - gap, "close": close, "volume": 100.0 + rng.integers(0, 50, rows),
                }
            )
        )
    return from_pandas(spark, pd.concat(parts, ignore_index=True))


def from_pandas(spark, pdf):
    df = spark.createDataFrame(pdf)
    for name, kind in df.dtypes:
        if kind == "timestamp":
            df = df.withColumn(name, df[name].cast("timestamp_ntz"))
    return df


def segments(spark, bars=900, symbol="AA", seed=181):
    """Four equal stretches: calm, calm and rising, wild and rising, wild."""
    rng = np.random.default_rng(seed)
    n = bars // 4
    r = np.concatenate([rng.normal(m, s, n) for m, s in ((0, 0.0002), (0.00007, 0.00022), (0.00012, 0.0012), (0, 0.0016))])
    close = 100 * np.cumprod(1 + r)
    gap = np.maximum(0.05, 4 * close * np.abs(r))
    pdf = pd.DataFrame(
        {
            "symbol": symbol, "idx": np.arange(len(r)), "date": [START + timedelta(minutes=i) for i in range(len(r))],
            "open": close, "high": close + gap, "low": close - gap, "close": close, "volume": 100.0 + np.arange(len(r)),
        }
    )
    return from_pandas(spark, pdf)
