import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlight.operators import classify, hmm, kmeans, logistic
from barlight.operators import features as fx
from barlight.operators import regimes as rg
from barlight.operators import tournament as tm
from barlight.plans import research
from barlight.schema import REGIME_NAMES
from barlight.session import staged
from barlight.sources.runs import RunStore, available_runs

from helpers import START, bars_frame, from_pandas, segments


def cloud(spark, keys=("a", "b"), n=120, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for k in keys:
        for i in range(n):
            center = [(-2, -2), (-2, 2), (2, -2), (2, 2)][i % 4]
            rows.append((k, i, [float(c + rng.normal(0, 0.6)) for c in center]))
    pdf = pd.DataFrame(rows, columns=["symbol", "idx", "z"])
    pdf["pos"] = pdf["idx"]
    pdf["date"] = [START + pd.Timedelta(minutes=20 * int(i)) for i in pdf["idx"]]
    return pdf, staged(from_pandas(spark, pdf))


def test_kmeans_reaches_a_fixed_point_for_every_key(spark):
    pdf, points = cloud(spark)
    made = kmeans.fit(points, ["symbol"], 2, (0, 1), starts=3, tolerance=1e-12).collect()
    assert {r["symbol"] for r in made} == {"a", "b"}
    for r in made:
        x = np.stack(pdf[pdf["symbol"] == r["symbol"]]["z"].to_numpy())
        c = np.array(r["centers"])
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        assert r["inertia"] == pytest.approx(d.min(axis=1).sum(), rel=1e-9)
        assert np.allclose(c, [x[near == k].mean(axis=0) for k in range(4)])


def test_forward_backward_and_best_path_against_enumeration():
    rng = np.random.default_rng(2)
    start, moves = rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4)
    logs = rng.normal(0, 1, (1, 4, 4))
    real = np.ones((1, 4), dtype=bool)
    paths = list(itertools.product(range(4), repeat=4))
    weight = np.array(
        [start[p[0]] * np.prod([moves[a, b] for a, b in zip(p, p[1:])]) * np.exp(sum(logs[0, t, s] for t, s in enumerate(p))) for p in paths]
    )
    post, expected, likelihood = hmm._forward_backward(logs, real, start, moves)
    assert likelihood == pytest.approx(np.log(weight.sum()))
    for t in range(4):
        for s in range(4):
            share = weight[[p[t] == s for p in paths]].sum() / weight.sum()
            assert post[0, t, s] == pytest.approx(share)
    counts = np.zeros((4, 4))
    for p, w in zip(paths, weight / weight.sum()):
        for a, b in zip(p, p[1:]):
            counts[a, b] += w
    assert np.allclose(expected, counts)
    assert tuple(hmm._best_states(logs, real, start, moves)[0]) == paths[weight.argmax()]


def test_hmm_improves_and_gives_probabilities(spark):
    _, points = cloud(spark)
    centers = kmeans.fit(points, ["symbol"], 2, (0, 1), starts=1)
    first = hmm.likelihoods(points, hmm.first_parameters(centers, ["symbol"], 2), ["symbol"], 2)
    model = hmm.fit(points, centers, ["symbol"], 2, max_iter=4)
    before = {r["symbol"]: r["log_likelihood"] for r in first.collect()}
    after = hmm.likelihoods(points, model, ["symbol"], 2).collect()
    assert all(r["log_likelihood"] > before[r["symbol"]] for r in after)
    assert after[0]["hmm_status"].startswith("available_fit_success log_likelihood=")
    rows = hmm.decode(points, model, ["symbol"], 2).toPandas()
    assert len(rows) == 240 and set(rows["raw"]) <= {0, 1, 2, 3}
    assert np.allclose(np.stack(rows["posterior"].to_numpy()).sum(axis=1), 1.0)


def test_hmm_does_not_depend_on_the_blocks(spark, monkeypatch):
    _, points = cloud(spark)
    centers = kmeans.fit(points, ["symbol"], 2, (0, 1), starts=1)
    found = []
    for rows in (10_000, 7):
        monkeypatch.setattr(hmm, "BLOCK_ROWS", rows)
        model = staged(hmm.fit(points, centers, ["symbol"], 2, max_iter=2))
        decoded = hmm.decode(points, model, ["symbol"], 2).orderBy("symbol", "pos").toPandas()
        found.append((model.orderBy("symbol").toPandas(), decoded))
    (one, whole), (many, cut) = found
    for column in ("start", "moves", "means", "spreads"):
        assert np.allclose(np.stack(one[column].to_numpy()), np.stack(many[column].to_numpy()), atol=1e-8), column
    assert np.allclose(one["log_likelihood"], many["log_likelihood"])
    assert np.allclose(np.stack(whole["posterior"].to_numpy()), np.stack(cut["posterior"].to_numpy()), atol=1e-8)
    assert (whole["raw"] == cut["raw"]).all()


def test_logistic_fit_is_at_the_optimum(spark):
    bars = bars_frame(spark, rows=700, symbols=("AA", "BB"))
    rows = staged(classify.split_rows(bars))
    symbols = classify.fittable(rows)
    points = staged(classify.with_points(rows, symbols))
    fitted = {r["symbol"]: r for r in classify.fit_logistic(points).collect()}
    assert set(fitted) == {r["symbol"] for r in symbols.collect()} and fitted
    for symbol, model in fitted.items():
        pdf = points.where((F.col("part") == "train") & (F.col("symbol") == symbol)).toPandas()
        x, y, w = np.stack(pdf["scaled"].to_numpy()), pdf["label"].to_numpy(), pdf["weight"].to_numpy()
        beta, intercept = np.array(model["beta"][:-1]), model["beta"][-1]
        p = 1 / (1 + np.exp(-(x @ beta + intercept)))
        assert np.abs(x.T @ (w * (p - y)) + beta).max() < 1e-6
        assert abs((w * (p - y)).sum()) < 1e-6
        assert w.sum() == pytest.approx(len(pdf))


def test_logistic_fit_shortens_steps_that_overshoot(spark):
    # Nearly separable: full Newton steps from 0 run away without the search along the step.
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(-6, 0.1, 40), rng.normal(6, 0.1, 40)])
    rows = [("a", [float(v)], float(v > 0), 1.0) for v in x] + [("b", [1.0], 1.0, 1.0), ("b", [1.0], 0.0, 1.0)]
    points = staged(spark.createDataFrame(rows, "symbol string, x array<double>, label double, weight double"))
    found = {r["symbol"]: r for r in logistic.fit(points, ["symbol"], 1, penalty=1e-3).collect()}
    beta = np.array(found["a"]["beta"])
    p = 1 / (1 + np.exp(-(x * beta[0] + beta[1])))
    assert abs((x * (p - (x > 0))).sum() + 1e-3 * beta[0]) < 1e-6 and abs((p - (x > 0)).sum()) < 1e-6
    assert found["b"]["beta"] == pytest.approx([0.0, 0.0], abs=1e-9)


def test_quadrants_need_four_clusters(spark):
    stats = spark.createDataFrame(
        [("a", 0, 5, 1.0, 9.0), ("a", 1, 5, 1.0, 2.0), ("a", 2, 5, 3.0, 1.0), ("a", 3, 5, 4.0, 0.5), ("b", 0, 5, 1.0, 1.0)],
        "symbol string, raw int, bars long, vol_axis double, structure_axis double",
    )
    made = {r["raw"]: r["regime_id"] for r in rg.quadrants(stats).collect()}
    assert made == {1: 0, 0: 1, 2: 2, 3: 3}


def test_run_saves_every_table(spark, tmp_path):
    bars = segments(spark)
    store = RunStore(spark, str(tmp_path / "runs"))
    settings = research.Settings(
        strategies=("sma_cross", "donchian"), starts=1, simulations=5, horizon=10, block=5, keep_paths=2, stability_window=200
    )
    found = research.run(bars, store, "run_1", settings)
    scores = found.scores.collect()
    assert {r["candidate"] for r in scores} >= {fx.MINUTE, fx.SCRIPTED} and sum(r["is_best"] for r in scores) == 1
    labels = store.read("regime_labels", "run_1").toPandas()
    assert set(labels["regime_name"]) == set(REGIME_NAMES)
    assert np.allclose(labels[[f"prob_regime_{k}" for k in range(4)]].sum(axis=1), 1.0)
    assert store.read("metrics", "run_1").count() == 6
    assert store.read("equity_curves", "run_1").count() == 6 * 900
    stress = store.read("stress_summary", "run_1").toPandas()
    assert set(stress["stress_model"]) == {"gbm", "regime_mixture_gbm", "block_bootstrap"}
    assert (stress["terminal_p5"] <= stress["terminal_p50"]).all() and (stress["terminal_p50"] <= stress["terminal_p95"]).all()
    ends = store.read("monte_carlo_terminal", "run_1")
    assert ends.agg(F.max("simulation")).first()[0] == 4  # distributions are of all simulations
    assert store.read("monte_carlo_bands", "run_1").agg(F.max("step")).first()[0] == 10
    paths = store.read("monte_carlo_paths", "run_1")
    assert paths.agg(F.max("simulation")).first()[0] == 1
    picked = available_runs(store.manifests(), primary_rows=900).collect()
    assert [(r["run_id"], r["mode"], r["rows"], r["has_tables"]) for r in picked] == [("run_1", "full", 900, True)]
    by_regime = store.read("per_regime_metrics", "run_1").groupBy("strategy").agg(F.sum("bars")).collect()
    first = labels["idx"].min()
    assert {r[1] for r in by_regime} == {900 - first}
    assert store.read("oos_regime_blocks", "run_1").count() == 0  # not written: empty
    assert tm.hmm_status(found, starts=1, steps=2).first()["hmm_status"].startswith("available_fit_success")
