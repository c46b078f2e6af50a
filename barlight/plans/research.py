"""A whole research run: bars to regimes, signals, backtests, stress tests and saved tables.

Each stage writes its table to the run store and the next stages read it back, so the
work of a stage is done once and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.operators import backtest as bt
from barlight.operators import classify, clean, continuous
from barlight.operators import features as fx
from barlight.operators import report as rp
from barlight.operators import signals as sg
from barlight.operators import stress as st
from barlight.operators import tournament as tm
from barlight.operators import walkforward as wf
from barlight.operators.ordered import with_ordinal
from barlight.schema import CAPITAL, COST_BPS, STRATEGIES, STRESS_MODELS
from barlight.session import staged
from barlight.sources.runs import RunStore, model_catalogue, run_row


@dataclass(frozen=True)
class Settings:
    """Options of a run with their usual values."""

    detector: str = "production"  # or "dev"
    walk_forward: wf.WalkForward | None = None
    include_hmm: bool = False
    short: int = fx.SHORT
    long: int = fx.LONG
    stability_window: int = 2_000
    seed: int = 181
    starts: int = 20
    hmm_steps: int = 200
    strategies: Sequence[str] = field(default_factory=lambda: tuple(STRATEGIES))
    capital: float = CAPITAL
    cost_bps: float = COST_BPS
    stress_models: Sequence[str] = field(default_factory=lambda: tuple(STRESS_MODELS))
    stress_regimes: Sequence[str] = ("all", "each")
    simulations: int = 500
    horizon: int = 390
    block: int = 30
    keep_paths: int = 50
    drawdown_threshold: float = 0.20
    train_filter: bool = False
    filter_metric: str = "sharpe"
    filter_threshold: float = 0.0
    filter_rows: int = 5_000  # train rows a block needs for a filter
    regime_only: bool = False


def load_bars(
    records: DataFrame,
    roots: Sequence[str],
    sample_rows: int | None = None,
    start: str | None = None,
    end: str | None = None,
    session_start: str | None = None,
    session_end: str | None = None,
    back_adjust: bool = True,
) -> DataFrame:
    """Clean bars with ordinals: the first minutes per root (sample), or the whole stitched series."""
    options = dict(start=start, end=end, session_start=session_start, session_end=session_end)
    if sample_rows is None:
        bars = continuous.front_series(records, roots, back_adjust=back_adjust, **options)
    else:
        bars = None
        for root in roots:
            part = clean.validated(clean.sample_bars(records, root, sample_rows, **options))
            bars = part if bars is None else bars.unionByName(part)
    return with_ordinal(staged(bars))


def detect(bars: DataFrame, s: Settings) -> tm.Detection:
    common = dict(short=s.short, long=s.long, stability_window=s.stability_window, starts=s.starts, seed=s.seed)
    if s.detector == "production":
        return tm.detect(bars, **common)
    common.update(include_hmm=s.include_hmm, hmm_steps=s.hmm_steps)
    if s.walk_forward is None:
        return tm.detect_dev(bars, **common)
    return tm.detect_walk_forward(bars, s.walk_forward, **common)


def _one_label_per_bar(labels: DataFrame) -> DataFrame:
    if "block" not in labels.columns:
        return labels
    first = F.min_by(F.struct("regime_id", "regime_name"), "block").alias("_l")
    return labels.groupBy("symbol", "idx", "date").agg(first).select("symbol", "idx", "date", "_l.*")


def run(bars: DataFrame, store: RunStore, run_id: str, s: Settings = Settings()) -> tm.Detection:
    """Run every stage and save its tables under ``run_id``; ``bars`` must carry ``idx``."""
    bars = staged(bars)
    found = detect(bars, s)
    labels = staged(found.labels)
    bar_labels = staged(_one_label_per_bar(labels))
    regimes = staged(sg.aligned_regimes(bars, bar_labels))

    scores = found.scores if "model_family" in found.scores.columns else found.scores.withColumn("model_family", F.lit(tm.KMEANS))
    by = {"production": "score"}.get(s.detector, "dev_score" if s.walk_forward is None else "oos_score_mean")
    models = staged(model_catalogue(scores, by, "production_default" if s.detector == "production" else "oos" if s.walk_forward else "in_sample"))
    best = models.where("is_best").select("symbol", "model_id")

    def save(table: str, df: DataFrame) -> None:
        """Each symbol's rows go under the model that was chosen for it."""
        store.write_by_model(table, df.join(best, "symbol"), run_id)

    def finish() -> tm.Detection:
        """The run's row comes last: what lists runs by it never meets a run that is half written."""
        store.write("runs", run_row(clean.load_summary(bars), run_id, "regime_only" if s.regime_only else "full", **asdict(s)), run_id)
        return found

    store.write("models", models, run_id)
    if found.skipped is not None:
        store.write("skipped_models", found.skipped, run_id)
    for table, df in {
        "bars": bars, "regime_labels": labels, "regime_stats": found.stats, "regime_transitions": found.transitions,
        "regime_stability": found.stability, "price_regimes": regimes,
    }.items():
        save(table, df)
    chosen = found.scores.where("is_best").select("symbol", "candidate")
    features = None
    for frame in found.features.values():
        part = frame.join(chosen, ["symbol", "candidate"], "left_semi").drop("used", "feature_rows")
        features = part if features is None else features.unionByName(part, allowMissingColumns=True)
    save("regime_features", features)
    if found.blocks is not None:
        save("oos_regime_labels", labels)
        save("oos_regime_model_rankings", found.scores.drop("model_id"))
        save("oos_regime_blocks", found.blocks)
    if s.regime_only:
        return finish()

    learned_names = [m for m in classify.LEARNED if m in s.strategies]
    learned = staged(classify.learned_signals(bars, learned_names)) if learned_names else None
    signals = staged(sg.strategy_signals(bars, bar_labels, learned, s.strategies))
    save("strategy_signals", signals.drop("close"))
    if found.blocks is not None:
        train = tm.train_labels(bars, found, s.walk_forward, s.starts, s.seed, s.hmm_steps) if s.train_filter else None
        out = wf.evaluate(
            bars, signals, labels, s.walk_forward, train, s.filter_metric, s.filter_threshold, s.capital, s.cost_bps, s.filter_rows
        )
        save("strategy_metrics_oos", out.block_metrics)
        save("strategy_per_regime_metrics_oos", out.block_regime_metrics)
        save("strategy_regime_rankings_oos", out.ranking)
        if out.unfiltered is not None:
            save("unfiltered_blocks", out.unfiltered)
        returns, by_regime = out.returns, out.regime_metrics
    else:
        out = bt.run_backtests(bars, signals, regimes, s.capital, s.cost_bps)
        returns, by_regime = out.returns, out.regime_metrics
    save("strategy_returns", returns)
    save("equity_curves", out.equity)
    save("metrics", out.metrics)
    save("per_regime_metrics", by_regime)
    save("trades", out.trades)
    stress = st.run_stress(
        returns, bar_labels, s.stress_regimes, s.capital, s.keep_paths, s.drawdown_threshold,
        simulations=s.simulations, horizon=s.horizon, block=s.block, seed=s.seed, models=s.stress_models,
    )
    save("stress_summary", stress.summary)
    save("monte_carlo_paths", stress.paths)
    save("monte_carlo_bands", rp.path_bands(stress.equity, st.SCENARIO))
    save("monte_carlo_terminal", rp.terminal_frame(stress.equity, s.capital))
    return finish()
