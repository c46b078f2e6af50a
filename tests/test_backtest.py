from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlight.operators import backtest as bt
from barlight.operators import signals as sg

from helpers import START, bars_frame, from_pandas


def test_three_bars(spark):
    pdf = pd.DataFrame(
        {
            "symbol": "AA", "strategy": "s", "idx": [0, 1, 2], "date": [START + timedelta(minutes=i) for i in range(3)],
            "close": [100.0, 110.0, 121.0], "signal": [1.0, 0.0, 0.0],
        }
    )
    run = bt.run_backtests(None, from_pandas(spark, pdf), cost_bps=0.0)
    assert [r[0] for r in run.returns.orderBy("idx").select("return").collect()] == pytest.approx([0.0, 0.1, 0.0])
    metrics = run.metrics.first()
    assert metrics["num_trades"] == 1 and metrics["win_rate"] == 1.0
    assert metrics["profit_factor"] == float("inf")
    trade = run.trades.first()
    assert (trade["side"], trade["exit_reason"], trade["bars_held"]) == ("LONG", "signal_exit", 2)


def brute_trades(pdf):
    """Walk the bars one by one."""
    out, active, entry = [], 0.0, None
    for i, p in enumerate(pdf["position"]):
        if abs(p - active) > 1e-12:
            if abs(active) > 1e-12:
                out.append((entry, i, active, p))
            active, entry = p, i if abs(p) > 1e-12 else None
    if abs(active) > 1e-12:
        out.append((entry, len(pdf) - 1, active, 0.0))
    return [
        (s, e, x, y, float((1 + pdf["return"][s : e + 1]).prod() - 1)) for s, e, x, y in out
    ]


def test_trades_and_metrics_match_a_walk_over_the_bars(spark):
    bars = bars_frame(spark, rows=400, symbols=("AA",))
    hold = F.floor(F.col("idx") / F.lit(37)).cast("long")
    level = F.element_at(F.array(*[F.lit(x) for x in (0.0, 1.0, -1.0, 0.5, 0.5, -0.5)]), (F.abs(F.xxhash64(hold)) % 6 + 1).cast("int"))
    signals = bars.withColumns({"strategy": F.lit("s"), "signal": F.when(F.col("idx") > 300, 1.0).otherwise(level)})
    returns = bt.strategy_returns(None, signals)
    pdf = returns.orderBy("idx").toPandas()
    want = brute_trades(pdf)
    got = bt.trades(returns).orderBy("entry_date").collect()
    assert len(got) == len(want) > 3
    for row, (s, e, x, y, r) in zip(got, want):
        assert row["entry_date"] == pdf["date"][s].to_pydatetime() and row["exit_date"] == pdf["date"][e].to_pydatetime()
        assert (row["entry_exposure"], row["exit_exposure"], row["bars_held"]) == (x, y, e - s + 1)
        assert row["return"] == pytest.approx(r, abs=1e-12)
    assert got[-1]["exit_reason"] == "end_of_sample"

    m, r = bt.return_metrics(returns).first(), pdf["return"].to_numpy()
    equity = np.cumprod(1 + r)
    assert m["bars"] == 400
    assert m["total_return"] == pytest.approx(equity[-1] / equity[0] - 1, abs=1e-12)
    assert m["max_drawdown"] == pytest.approx((equity / np.maximum.accumulate(equity) - 1).min(), abs=1e-12)
    assert m["sharpe"] == pytest.approx(np.sqrt(252 * 390) * r.mean() / r.std(), rel=1e-9)
    assert m["sortino"] == pytest.approx(np.sqrt(252 * 390) * r.mean() / r[r < 0].std(), rel=1e-9)
    assert m["var_95"] == pytest.approx(np.percentile(r, 5), abs=1e-12)


def test_regime_bars_add_up_and_risk_halves_the_size(spark):
    bars = bars_frame(spark, rows=300)
    labels = bars.where("idx >= 50 AND idx % 3 != 1").select(
        "symbol", "idx", F.when(F.col("idx") < 150, 0).otherwise(3).alias("regime_id"),
        F.when(F.col("idx") < 150, "Range + Low Volatility").otherwise("Range + High Volatility").alias("regime_name"),
    )
    signals = sg.strategy_signals(bars, labels, strategies=sg.RULES)
    values = {r[0] for r in signals.select("signal").distinct().collect()}
    assert values <= {-1.0, -0.5, 0.0, 0.5, 1.0}
    assert signals.select("strategy").distinct().count() == 12
    risky = signals.where("strategy LIKE '%regime_aware' AND idx >= 150 AND signal != 0").select(F.abs("signal")).distinct()
    assert [r[0] for r in risky.collect()] == [0.5]
    run = bt.run_backtests(bars, signals, sg.aligned_regimes(bars, labels))
    sums = run.regime_metrics.groupBy("symbol", "strategy").agg(F.sum("bars")).collect()
    assert {r[2] for r in sums} == {250} and len(sums) == 24


def test_unknown_strategy_is_refused(spark):
    with pytest.raises(ValueError):
        sg.strategy_signals(bars_frame(spark, rows=10), strategies=["nothing"])
