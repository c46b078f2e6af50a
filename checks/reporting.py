"""Scopes, rankings, pivots and the run store over saved results."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.operators import backtest as bt
from barlight.operators import clean
from barlight.operators import regimes as rg
from barlight.operators import report as rp
from barlight.schema import REGIME_NAMES
from barlight.session import shared_folder, staged
from barlight.sources import runs
from checks import evaluation as ev
from checks import trading as tr
from checks.registry import check, rnd, rnds, rounded, shared, view
from checks.trading import FLOATS, K, STRATEGIES, TRADE_COLS, TRADE_FLOATS, W, metrics_sql, q, trade_summary_sql
from checks.views import bars, events

START, END = "2024-01-08", "2024-01-19"
WANTED = [REGIME_NAMES[0], REGIME_NAMES[2]]
_W = ", ".join(f"'{n}'" for n in WANTED)
SOME = STRATEGIES[:4]
_S = ", ".join(f"'{n}'" for n in SOME)

view(
    "scope15",
    f"""SELECT * FROM aligned15 WHERE date >= TIMESTAMP '{START}' AND date <= TIMESTAMP '{END}' + INTERVAL 1 DAY AND regime_name IN ({_W})""",
)
view(
    "scret15",
    f"""SELECT r.* FROM bret15 r WHERE strategy IN ({_S}) AND (EXISTS (SELECT 1 FROM scope15 s WHERE s.symbol = r.symbol AND s.date = r.date)
    OR NOT EXISTS (SELECT 1 FROM scope15 s WHERE s.symbol = r.symbol))""",
)
view(
    "sctrades15",
    f"""SELECT t.* FROM btrades15 t WHERE strategy IN ({_S}) AND exit_date >= TIMESTAMP '{START}' AND entry_date <= TIMESTAMP '{END}' + INTERVAL 1 DAY
    AND (EXISTS (SELECT 1 FROM scope15 s WHERE s.symbol = t.symbol AND s.date IN (t.entry_date, t.exit_date))
    OR NOT EXISTS (SELECT 1 FROM scope15 s WHERE s.symbol = t.symbol))""",
)
view("scmet15", metrics_sql("scret15", K))
view("sctsum15", trade_summary_sql("sctrades15", K))
view("scregret15", "SELECT r.*, a.regime_id, a.regime_name FROM scret15 r JOIN scope15 a ON a.symbol = r.symbol AND a.date = r.date WHERE a.regime_id IS NOT NULL")
view("scregmet15", metrics_sql("scregret15", K + ", regime_id, regime_name"))


def scope(spark, sf):
    return rp.scoped_bars(tr.regime_bars(spark, sf), START, END, WANTED)


def sc_returns(spark, sf):
    return rp.scoped_returns(tr.rule_returns(spark, sf), scope(spark, sf), SOME)


def sc_trades(spark, sf):
    return rp.scoped_trades(tr.rule_trades(spark, sf), scope(spark, sf), START, END, SOME)


@shared
def metrics(spark, sf):
    returns = tr.rule_returns(spark, sf)
    rows = bt.return_metrics(returns).join(bt.turnover(returns), list(bt.KEYS))
    return bt.with_trade_metrics(rows, bt.trade_summary(tr.rule_trades(spark, sf)))


@shared
def regime_metrics(spark, sf):
    return bt.regime_metrics(tr.rule_returns(spark, sf), tr.regime_bars(spark, sf))


@check("f7_scope_filter", f"SELECT symbol, idx, date, regime_name, {rnds('close')} FROM scope15")
def _(spark, sf):
    return rounded(scope(spark, sf).select("symbol", "idx", "date", "regime_name", "close"))


@check("j9_scoped_returns", f"SELECT symbol, strategy, idx, {rnd(chr(34) + 'return' + chr(34))} AS \"return\" FROM scret15")
def _(spark, sf):
    return rounded(sc_returns(spark, sf).select("symbol", "strategy", "idx", "return"))


@check("f8_scoped_trades", f"SELECT symbol, strategy, {', '.join(TRADE_COLS)}, {q(TRADE_FLOATS)} FROM sctrades15")
def _(spark, sf):
    return rounded(sc_trades(spark, sf).select("symbol", "strategy", *TRADE_COLS, *TRADE_FLOATS), 6)


@check(
    "a28_scoped_metrics",
    f"""SELECT symbol, strategy, bars, coalesce(num_trades, 0) AS num_trades, {q(FLOATS)}, {rnd('coalesce(win_rate, bar_win_rate)', 6)} AS win_rate,
    {rnd('coalesce(profit_factor, 0)', 6)} AS profit_factor, {rnd('coalesce(expected_r, 0)', 6)} AS expected_r FROM scmet15 LEFT JOIN sctsum15 USING (symbol, strategy)""",
)
def _(spark, sf):
    return rounded(rp.scoped_metrics(staged(sc_returns(spark, sf)), sc_trades(spark, sf)), 6)


@check("a15_scoped_regime_metrics", f"SELECT symbol, strategy, regime_id, regime_name, bars, {q(FLOATS)} FROM scregmet15")
def _(spark, sf):
    out = rp.scoped_regime_metrics(staged(sc_returns(spark, sf)), scope(spark, sf))
    return rounded(out.drop("win_rate"), 6)


@check("j11_returns_by_regime", f"SELECT symbol, strategy, idx, regime_id, regime_name, {rnd(chr(34) + 'return' + chr(34))} AS \"return\" FROM scregret15")
def _(spark, sf):
    rows = rp.returns_by_regime(sc_returns(spark, sf), scope(spark, sf))
    return rounded(rows.select("symbol", "strategy", "idx", "regime_id", "regime_name", "return"))


_RANKED = ["total_return", "expectancy", "sharpe", "max_drawdown"]


@check(
    "a20_regime_ranking",
    f"""SELECT symbol, strategy, regime_id, regime_name, CAST(sum(bars) AS BIGINT) AS bars, {', '.join(f'{rnd(f"avg({c})", 6)} AS {c}' for c in _RANKED)},
    {rnd('avg(bar_win_rate)', 6)} AS win_rate FROM breg15 GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    return rounded(rp.regime_ranking(regime_metrics(spark, sf)), 6)


_ORDER = "round(sharpe, 9) DESC, round(expectancy, 12) DESC, bars DESC, strategy"


@check(
    "t3_metric_ranking",
    f"SELECT symbol, strategy, bars, {q(['sharpe', 'expectancy'])}, row_number() OVER (PARTITION BY symbol ORDER BY {_ORDER}) AS position FROM bfull15",
)
def _(spark, sf):
    rows = metrics(spark, sf).withColumns({"sharpe": F.round("sharpe", 9), "expectancy": F.round("expectancy", 12)})
    out = rp.ranked(rows, "sharpe").withColumn("position", F.col("position").cast("long"))
    return rounded(out.select("symbol", "strategy", "bars", "sharpe", "expectancy", "position"), 6)


@check(
    "t1_top_strategies",
    f"""SELECT * FROM (SELECT symbol, strategy, row_number() OVER (PARTITION BY symbol ORDER BY {_ORDER}) AS position FROM bfull15) t WHERE position <= 3""",
)
def _(spark, sf):
    rows = metrics(spark, sf).withColumns({"sharpe": F.round("sharpe", 9), "expectancy": F.round("expectancy", 12)})
    out = rp.preset(rows, "sharpe", "top_3")
    return out.select("symbol", "strategy", F.col("position").cast("long").alias("position"))


@check(
    "w22_best_regime",
    f"""SELECT symbol, strategy, regime_name, {rnd('sharpe', 6)} AS score FROM (SELECT *, row_number() OVER (PARTITION BY symbol, strategy
    ORDER BY round(sharpe, 9) DESC, round(expectancy, 12) DESC, bars DESC, regime_id) AS rn FROM breg15) t WHERE rn = 1""",
)
def _(spark, sf):
    rows = regime_metrics(spark, sf).withColumns({"sharpe": F.round("sharpe", 9), "expectancy": F.round("expectancy", 12)})
    return rounded(rp.best_regimes(rows, "sharpe"), 6)


@check(
    "w23_latest_trade",
    f"""SELECT symbol, strategy, {', '.join(TRADE_COLS)}, {q(TRADE_FLOATS)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol
    ORDER BY exit_date DESC, entry_date DESC, strategy DESC) AS rn FROM btrades15) t WHERE rn = 1""",
)
def _(spark, sf):
    out = rp.latest_trade(tr.rule_trades(spark, sf))
    return rounded(out.select("symbol", "strategy", *TRADE_COLS, *TRADE_FLOATS), 6)


@check(
    "j13_augmented_metrics",
    f"""SELECT symbol, strategy, bars, {q(FLOATS)}, s.num_trades, {', '.join(f'{rnd(f"s.{c}", 6)} AS {c}' for c in ('win_rate', 'profit_factor', 'expected_r'))}
    FROM bmet15 m LEFT JOIN btsum15 s USING (symbol, strategy)""",
)
def _(spark, sf):
    plain = metrics(spark, sf).select("symbol", "strategy", "bars", *FLOATS)
    return rounded(rp.augmented(plain, tr.rule_trades(spark, sf)), 6)


@check(
    "j10_signal_markers",
    f"""SELECT a.symbol, a.date, {rnd('a.close')} AS close, {rnds('signal')}, CASE WHEN signal > 0 THEN 'long' ELSE 'short' END AS marker
    FROM aligned15 a JOIN sig15 s ON s.symbol = a.symbol AND s.date = a.date AND strategy = 'donchian__regime_aware' WHERE signal <> 0""",
)
def _(spark, sf):
    return rounded(rp.signal_markers(tr.regime_bars(spark, sf), tr.rules(spark, sf), "donchian__regime_aware"))


@check(
    "w12_strategy_drawdowns",
    f"""SELECT symbol, strategy, idx, {rnd('e / max(e) OVER (PARTITION BY symbol, strategy ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1', 7)} AS drawdown FROM (
    SELECT *, product(1 + "return") OVER (PARTITION BY symbol, strategy ORDER BY idx ROWS UNBOUNDED PRECEDING) AS e FROM bret15) t""",
)
def _(spark, sf):
    out = rp.drawdown_series(staged(bt.equity_curves(tr.rule_returns(spark, sf))))
    return rounded(out.select("symbol", "strategy", "idx", "drawdown"), 7)


_COLS = {n: n.lower().replace(" + ", "_").replace(" ", "_") for n in REGIME_NAMES}


@check(
    "a25_regime_pivot",
    "SELECT symbol, strategy, " + ", ".join(f"{rnd(f'avg(sharpe) FILTER (regime_name = {chr(39)}{n}{chr(39)})', 6)} AS {c}" for n, c in _COLS.items())
    + " FROM breg15 GROUP BY 1, 2",
)
def _(spark, sf):
    out = rp.regime_pivot(regime_metrics(spark, sf), "sharpe", REGIME_NAMES)
    return rounded(out.withColumnsRenamed(_COLS), 6)


@check(
    "u4_melted_shares",
    " UNION ALL ".join(f"SELECT symbol, window_start, window_end, bars, '{k}' AS regime, {rnd(f'regime_{k}_share')} AS share FROM stab15" for k in range(4)),
)
def _(spark, sf):
    return rounded(rp.melted_shares(rg.stability(tr.labelled(spark, sf), W)))


# --- models and runs ---------------------------------------------------------

KEYS2 = ["symbol", "candidate", "model_family"]
_LABEL = """CASE candidate WHEN 'minute_volatility_trend_kmeans' THEN 'Minute Volatility Trend KMeans / Given'
ELSE 'Rolling Return Volatility KMeans / Given' END"""
view(
    "variants15",
    f"""SELECT symbol, candidate, candidate || '::given' AS model_id, {_LABEL} AS display_label, candidate || '__given' AS folder,
    coalesce(oos_score_mean, 0) AS rank_value, row_number() OVER (PARTITION BY symbol ORDER BY round(oos_score_mean, 9) DESC NULLS LAST, candidate) AS rank FROM wfrank""",
)


@shared
def model_ranking(spark, sf):
    scores = ev.wf.block_scores(ev.wf_labels(spark, sf), ev.MK).withColumn("model_family", F.lit("given"))
    tried = None
    for rows in ev.wf_features(spark, sf).values():
        part = rows.select("symbol", "candidate").distinct()
        tried = part if tried is None else tried.unionByName(part)
    out = ev.wf.rank_models(scores, tried.withColumn("model_family", F.lit("given")), KEYS2)
    return out.withColumn("oos_score_mean", F.round("oos_score_mean", 9))


@check(
    "t4_model_selection",
    f"SELECT symbol, model_id, candidate, display_label, folder, {rnd('rank_value', 6)} AS rank_value, CAST(rank AS INTEGER) AS rank, rank = 1 AS is_best FROM variants15",
)
def _(spark, sf):
    out = runs.model_catalogue(model_ranking(spark, sf), "oos_score_mean", "oos")
    return rounded(out.select("symbol", "model_id", "candidate", "display_label", "folder", "rank_value", "rank", "is_best"), 6)


@check(
    "j12_model_leaderboard",
    f"""SELECT symbol, model_id, status, {rnd('oos_score_mean', 6)} AS oos_score_mean, rank = 1 AS recommended,
    CASE WHEN rank = 1 THEN '★ Recommended - ' ELSE '' END || display_label AS label FROM wfrank JOIN variants15 USING (symbol, candidate)""",
)
def _(spark, sf):
    ranking = model_ranking(spark, sf)
    out = rp.leaderboard(runs.model_catalogue(ranking, "oos_score_mean", "oos"), ranking)
    return rounded(out.select("symbol", "model_id", "status", "oos_score_mean", "recommended", "label"), 6)


@check(
    "j12_variants_by_rank",
    f"""SELECT symbol, model_id, CAST(rank AS INTEGER) AS rank, {rnd('rank_value', 6)} AS rank_value,
    CASE WHEN rank = 1 THEN '★ Recommended - ' ELSE '' END || display_label AS label FROM variants15""",
)
def _(spark, sf):
    out = rp.leaderboard(runs.model_catalogue(model_ranking(spark, sf), "oos_score_mean", "oos"))
    return rounded(out.select("symbol", "model_id", "rank", "rank_value", "label"), 6)


def store(spark, sf):
    """A run saved with its metrics under two models; the catalogue marks the best."""
    out = runs.RunStore(spark, f"{shared_folder(spark)}/runs_{abs(hash(sf))}")
    models = runs.model_catalogue(model_ranking(spark, sf), "oos_score_mean", "oos")
    out.write("models", models, "run_a", "catalogue")
    out.write("metrics", metrics(spark, sf), "run_a", "minute_volatility_trend_kmeans::given")
    out.write("metrics", metrics(spark, sf).where(F.col("sharpe") > 0), "run_a", "rolling_return_volatility_kmeans::given")
    return out


@check("s7_saved_tables", f"SELECT symbol, strategy, bars, {q(FLOATS)} FROM bfull15")
def _(spark, sf):
    saved = store(spark, sf).read("metrics", "run_a", "minute_volatility_trend_kmeans::given")
    return rounded(saved.select("symbol", "strategy", "bars", *FLOATS), 6)


@check(
    "s8_run_catalogue",
    """SELECT 'run_a' AS run_id, 'full' AS mode, symbol, count(*) AS rows, count(DISTINCT CAST(date AS DATE)) AS trade_days, strftime(min(date), '%Y-%m-%d') AS start_date,
    strftime(max(date), '%Y-%m-%d') AS end_date, '{"capital":"100000","cost_bps":"0.25"}' AS settings FROM bars15 GROUP BY symbol""",
)
def _(spark, sf):
    row = runs.run_row(clean.load_summary(bars(spark, sf)), "run_a", "full", capital=100_000, cost_bps=0.25)
    return row.drop("created_at")  # the clock


@check("s9_load_saved_run", f"SELECT symbol, strategy, {q(['sharpe'])} FROM bfull15 WHERE sharpe > 0")
def _(spark, sf):
    saved = store(spark, sf).read("metrics", "run_a", "rolling_return_volatility_kmeans::given")
    return rounded(saved.select("symbol", "strategy", "sharpe"), 6)


view(
    "manifests",
    """SELECT event_type || CASE WHEN hour(ts) = 3 THEN '_smoke_' ELSE '_run_' END || strftime(ts, '%Y%m%d') AS run_id,
    CASE WHEN day(ts) < 25 THEN 'full' ELSE 'regime_only' END AS mode, max(value) > 60 AS has_tables, count(*) AS rows, max(ts) AS modified FROM events GROUP BY 1, 2""",
)


@check("s10_available_runs", "SELECT run_id, mode, rows, modified FROM manifests WHERE mode = 'full' AND has_tables AND rows >= 40 AND NOT contains(lower(run_id), 'smoke')")
def _(spark, sf):
    name = F.concat("event_type", F.when(F.hour("ts") == 3, "_smoke_").otherwise("_run_"), F.date_format("ts", "yyyyMMdd"))
    manifests = events(spark, sf).groupBy(
        name.alias("run_id"), F.when(F.dayofmonth("ts") < 25, "full").otherwise("regime_only").alias("mode")
    ).agg((F.max("value") > 60).alias("has_tables"), F.count(F.lit(1)).alias("rows"), F.max("ts").alias("modified"))
    return runs.available_runs(manifests, primary_rows=40).select("run_id", "mode", "rows", "modified")
