import inspect

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlight.functions import scalar
from barlight.operators import report as rp
from barlight.operators import stress as st
from barlight.operators import walkforward as wf
from barlight.sources import runs
from checks import evaluation
from checks.registry import CHECKS

from helpers import bars_frame, from_pandas


@pytest.mark.parametrize("step", [None, 30, 100])
def test_blocks_match_a_loop(spark, step):
    bars = bars_frame(spark, rows=300, symbols=("AA",))
    plan = wf.WalkForward(train=100, test=50, step=step, least_train=10)
    want, start = [], 0
    while start + 150 <= 300:
        want.append((len(want), start, start + 100, start + 100, start + 150))
        start += step or 50
    counts = wf.bar_counts(bars)
    got = [tuple(r)[1:] for r in wf.slices(counts, plan).orderBy("block").collect()]
    assert got == want
    for side, a, b in (("train", 1, 2), ("test", 3, 4)):
        rows = {(r["idx"], r["block"]) for r in wf.in_blocks(bars, counts, plan, side).select("idx", "block").collect()}
        assert rows == {(i, w[0]) for w in want for i in range(w[a], w[b])}


def stress_input(spark):
    bars = bars_frame(spark, rows=80, symbols=("AA",))
    returns = bars.select("symbol", F.lit("s").alias("strategy"), "date", ((F.col("idx") - 40) / 40_000).alias("return"))
    labels = bars.select("symbol", "idx", "date", F.when(F.col("idx") < 40, 0).otherwise(2).alias("regime_id")).withColumn(
        "regime_name", F.when(F.col("regime_id") == 0, "Range + Low Volatility").otherwise("Trend + High Volatility")
    )
    return returns, labels


def test_stress_models_and_percentiles(spark):
    returns, labels = stress_input(spark)
    run = st.run_stress(returns, labels, ["all", "each"], simulations=25, horizon=20, block=5, keep_paths=4)
    rows = run.summary.toPandas()
    assert len(rows) == 9 and set(rows["simulations"]) == {25} and set(rows["horizon"]) == {20}
    assert (rows["terminal_p5"] <= rows["terminal_p50"]).all() and (rows["terminal_p50"] <= rows["terminal_p95"]).all()
    assert (rows["terminal_cvar_95"] <= rows["terminal_p5"] + 1e-12).all()
    assert run.paths.count() == 9 * 4 * 20
    only_up = run.paths.where("regime_filter = 'Trend + High Volatility' AND stress_model != 'gbm' AND `return` < 0")
    assert only_up.count() == 0


def test_paths_do_not_depend_on_partitioning(spark):
    returns, _ = stress_input(spark)
    a = st.run_stress(returns, simulations=5, horizon=7, keep_paths=5).paths
    b = st.run_stress(returns.repartition(7, "date"), simulations=5, horizon=7, keep_paths=5).paths
    key = ["strategy", "stress_model", "simulation", "step"]
    left, right = (x.toPandas().sort_values(key)["return"].to_list() for x in (a, b))
    assert left == pytest.approx(right, abs=1e-15)


def test_paths_do_not_depend_on_the_chunks(spark, monkeypatch):
    returns, labels = stress_input(spark)
    found = []
    for rows in (4_096, 7):
        monkeypatch.setattr(st, "CHUNK", rows)
        run = st.run_stress(returns, labels, ["all", "each"], simulations=5, horizon=17, block=6, keep_paths=5)
        key = ["strategy", "regime_filter", "stress_model", "simulation", "step"]
        found.append(run.paths.toPandas().sort_values(key).reset_index(drop=True))
    assert found[0].equals(found[1]) and len(found[0]) == 9 * 5 * 17
    ends = found[0].groupby(["regime_filter", "stress_model", "simulation"])
    for _, path in ends:
        wealth = (1 + path["return"]).cumprod()
        assert path["equity"].to_list() == pytest.approx((100_000 * wealth).to_list())


def test_block_paths_are_runs_of_the_input(spark):
    returns, _ = stress_input(spark)
    paths = st.run_stress(returns, simulations=6, horizon=12, block=4, keep_paths=6, models=["block_bootstrap"]).paths.toPandas()
    pool = [(i - 40) / 40_000 for i in range(80)]
    for _, path in paths.sort_values("step").groupby("simulation"):
        values = path["return"].to_list()
        for k in range(0, 12, 4):
            start = min(range(80), key=lambda i: abs(pool[i] - values[k]))
            assert values[k : k + 4] == pytest.approx(pool[start : start + 4], abs=1e-15)


def test_ranking_presets_and_focus(spark):
    rows = spark.createDataFrame(
        [("x", "a", 0.1, 1.0, 10), ("x", "b", 0.3, 0.5, 10), ("x", "c", 0.1, 0.9, 10)], "symbol string, strategy string, expectancy double, sharpe double, bars int"
    )
    assert [r["strategy"] for r in rp.ranked(rows, "expectancy").collect()] == ["b", "a", "c"]
    assert [r["strategy"] for r in rp.preset(rows, "sharpe", "top_3").collect()] == ["a", "c", "b"]
    paths = spark.createDataFrame(
        [("x", "s", "all", "gbm", i, 1, e) for i, e in enumerate((100_000.0, 101_000.0, 102_000.0))],
        "symbol string, strategy string, regime_filter string, stress_model string, simulation int, step int, equity double",
    )
    assert rp.path_bands(paths, ["symbol"]).first()["p50"] == 101_000.0
    assert rp.terminal_frame(paths).agg(F.max("terminal_return")).first()[0] == pytest.approx(0.02)


def test_model_choice_falls_back(spark, tmp_path):
    models = spark.createDataFrame(
        [("x", "m1", 1, False), ("x", "m2", 2, True)], "symbol string, model_id string, rank int, is_best boolean"
    )
    store = runs.RunStore(spark, str(tmp_path))
    store.write("models", models, "r")
    for m in ("m1", "m2"):
        store.write("metrics", from_pandas(spark, pd.DataFrame({"symbol": ["x"], "value": [m]})), "r", m)
    assert store.read("metrics", "r").first()["value"] == "m2"
    assert store.read("metrics", "r", "m1").first()["value"] == "m1"
    assert store.read("metrics", "r", "gone").first()["value"] == "m2"
    store.write("metrics", from_pandas(spark, pd.DataFrame({"symbol": ["x"], "value": ["again"]})), "r", "m1")
    assert [r["value"] for r in store.read("metrics", "r", "m1").collect()] == ["again"]
    assert set(store.load("r")) == set(runs.TABLES) and store.read("trades", "r").count() == 0


def test_bands_query_does_the_whole_job(spark, monkeypatch):
    """F1 of round 4: the query ran 12 simulations of 24 steps in blocks of 6."""
    asked = {}

    def run_stress(returns, labels, requests, **options):
        asked.update(options)
        raise InterruptedError

    monkeypatch.setattr(evaluation.st, "run_stress", run_stress)
    monkeypatch.setattr(evaluation.tr, "rule_returns", lambda spark, sf: None)
    monkeypatch.setattr(evaluation.tr, "labelled", lambda spark, sf: None)
    with pytest.raises(InterruptedError):
        CHECKS["a21_path_bands"].run(spark, "")
    usual = {name: p.default for name, p in inspect.signature(st.simulated_paths).parameters.items()}
    for name, value in {"simulations": 500, "horizon": 390, "block": 30}.items():
        assert asked.get(name, usual[name]) == usual[name] == value
    sql = CHECKS["a21_path_bands"].sql
    assert "range(500)" in sql and "range(1, 391)" in sql and "least(30, n)" in sql and "range(12)" not in sql


def test_bands_of_pieces_are_those_of_steps(spark, monkeypatch):
    returns, labels = stress_input(spark)
    monkeypatch.setattr(st, "PIECE", 6)
    run = st.run_stress(returns, labels, ["all", "each"], simulations=11, horizon=20, block=5)
    key = [*st.SCENARIO, "step"]
    left, right = (rp.path_bands(x, st.SCENARIO).toPandas().sort_values(key).reset_index(drop=True) for x in (run.pieces, run.equity))
    assert len(left) == 9 * 20 and run.pieces.count() == 9 * 11 * 4
    pd.testing.assert_frame_equal(left, right, rtol=1e-13, check_dtype=False)


def test_bands_without_a_symbol(spark):
    paths = spark.createDataFrame([(None, i, 1, [e, 2 * e]) for i, e in enumerate((1.0, 2.0, 4.0, 7.0))], "symbol string, simulation int, step int, equity array<double>")
    found = {tuple(r) for r in rp.path_bands(paths, ["symbol"]).select("symbol", "step", "p25", "p50", "mean").collect()}
    assert found == {(None, 1, 1.75, 3.0, 3.5), (None, 2, 3.5, 6.0, 7.0)}


def test_draws_in_arrays_are_the_single_draws(spark):
    rows = spark.createDataFrame([("a", 3), (None, 1), ("b:c", 0)], "symbol string, n int")
    many = scalar.uniforms([181, F.col("symbol")], ["1:a", "2:a", "3:a"], F.col("n"))
    single = F.slice(F.array(*[scalar.uniform(181, F.col("symbol"), t, "a") for t in "123"]), F.lit(1), F.col("n"))
    assert [r[0] for r in rows.select(many).collect()] == [r[0] for r in rows.select(single).collect()]


@pytest.mark.parametrize("draw", [scalar.uniform, scalar.fast_uniform])
def test_blocks_are_those_of_a_loop(spark, draw):
    """Also of pools smaller than a block."""
    returns, labels = stress_input(spark)
    returns = returns.where("date < '2024-01-01 14:31:00'")  # 43 bars, 3 of them of the second regime
    labels = labels.withColumn("regime_name", F.when(F.col("idx") < 40, "one").otherwise("two"))
    run = st.run_stress(returns, labels, ["each"], simulations=3, horizon=11, block=5, keep_paths=3, models=["block_bootstrap"], uniform=draw)
    pool = {"one": [(i - 40) / 40_000 for i in range(40)], "two": [(i - 40) / 40_000 for i in range(40, 43)]}
    draws = spark.createDataFrame([(f, s, b) for f in pool for s in range(3) for b in range(4)], "regime_filter string, simulation int, b int")
    key = [181, F.lit("AA"), F.lit("s"), F.col("regime_filter"), F.lit("block_bootstrap"), F.col("simulation"), F.col("b").cast("string"), "s"]
    u = {(r[0], r[1], r[2]): r[3] for r in draws.select("*", draw(*key)).collect()}
    got = run.paths.toPandas().sort_values("step")
    assert len(got) == 2 * 3 * 11
    for (name, simulation), path in got.groupby(["regime_filter", "simulation"]):
        bars = pool[name]
        size = min(5, len(bars))
        want = [bars[int(u[name, simulation, k // size] * (len(bars) - size + 1)) + k % size] for k in range(11)]
        assert path["return"].to_list() == pytest.approx(want, abs=1e-15)
