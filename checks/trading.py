"""Regime labels from given centers, strategy signals, backtests and trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.operators import backtest as bt
from barlight.operators import features as fx
from barlight.operators import regimes as rg
from barlight.operators import signals as sg
from barlight.schema import REGIME_NAMES
from barlight.session import sized, staged
from checks.features import RSI, avg, gated, zsc
from checks.registry import check, rnd, rnds, rounded, shared, view
from checks.views import indexed

COLS = fx.COLUMNS[fx.MINUTE]
# Given centers in scaled units, one row per cluster, columns in the order of COLS.
CENTERS = [
    [0.6, 0.6, 0.6, 0.6, 0.0, 0.3, 0.6, 0.6],
    [-0.6, -0.6, -0.6, -0.6, 0.0, -0.3, -0.6, -0.6],
    [0.6, 0.6, 0.6, -0.6, 0.0, 0.3, 0.6, -0.6],
    [-0.6, -0.6, -0.6, 0.6, 0.0, -0.3, -0.6, 0.6],
]
STRATEGIES = [f"{s}__{v}" for s in sg.RULES for v in ("baseline", "regime_aware", "liquidity_filtered")]


def centers():
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in CENTERS])


def complete(spark, sf):
    return rg.complete_rows(fx.minute_features(indexed(spark, sf)), COLS)


@shared
def complete_saved(spark, sf):
    return complete(spark, sf)


def scaled(spark, sf):
    rows = complete_saved(spark, sf)
    return rg.standardised(rows, COLS, sized(rg.scaling(rows, COLS)))


def clustered(spark, sf):
    rows = scaled(spark, sf)
    given = sized(rows.select("symbol").distinct()).withColumn("centers", centers())
    return rg.assigned(rows, given)


@shared
def labelled(spark, sf):
    rows = clustered(spark, sf)
    return rg.with_regimes(rows, sized(rg.quadrants(rg.axis_stats(rows))))


_NAMES = "['" + "', '".join(REGIME_NAMES) + "']"


def name_of(x: str) -> str:
    return f"{_NAMES}[{x} + 1]"


view(
    "gate15",
    " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS \"column\", count({c}) AS non_null, stddev_pop({c}) AS deviation FROM e1 GROUP BY 1" for c in COLS
    ),
)
view(
    "complete15",
    "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos FROM e1 WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in COLS)
    + f" QUALIFY count(*) OVER (PARTITION BY symbol) >= {rg.LEAST_ROWS}",
)
view(
    "z15",
    "SELECT symbol, idx, date, pos, " + ", ".join(COLS) + ", "
    + ", ".join(f"({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w AS z{i}" for i, c in enumerate(COLS))
    + " FROM complete15 WINDOW w AS (PARTITION BY symbol)",
)
_D = [" + ".join(f"(z{j} - ({x})) * (z{j} - ({x}))" for j, x in enumerate(row)) for row in CENTERS]
view(
    "raw15",
    f"""SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 AND d0 <= d3 THEN 0 WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS raw
    FROM (SELECT *, {', '.join(f'{d} AS d{k}' for k, d in enumerate(_D))} FROM z15) t""",
)
view(
    "axis15",
    "SELECT symbol, raw, count(*) AS bars, avg(vol_axis) AS vol_axis, avg(structure_axis) AS structure_axis FROM raw15 GROUP BY 1, 2",
)
view(
    "quad15",
    """SELECT *, CASE WHEN NOT wild AND t = 1 THEN 0 WHEN NOT wild THEN 1 WHEN t = 2 THEN 2 ELSE 3 END AS regime_id FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, wild ORDER BY structure_axis, raw) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY vol_axis, structure_axis, raw) > 2 AS wild,
    count(*) OVER (PARTITION BY symbol) AS n FROM axis15) a) b WHERE n = 4""",
)
view("lab15", f"SELECT r.*, q.regime_id, {name_of('q.regime_id')} AS regime_name FROM raw15 r JOIN quad15 q USING (symbol, raw)")
view(
    "aligned15",
    """SELECT symbol, idx, date, close, high, low, last_value(regime_id IGNORE NULLS) OVER w AS regime_id,
    last_value(regime_name IGNORE NULLS) OVER w AS regime_name FROM (SELECT b.*, l.regime_id, l.regime_name FROM idx15 b
    LEFT JOIN lab15 l ON l.symbol = b.symbol AND l.idx = b.idx) t WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
)
_CH = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
view(
    "base15",
    f"""SELECT symbol, idx, date, close, CAST(sign(coalesce(sma, 0)) AS DOUBLE) AS sma_cross,
    CASE WHEN close < prior_low THEN -1.0 WHEN close > prior_high THEN 1.0 ELSE 0.0 END::DOUBLE AS donchian,
    CASE WHEN rsi > 70 THEN -1.0 WHEN rsi < 30 THEN 1.0 ELSE 0.0 END::DOUBLE AS rsi_mr,
    CASE WHEN z > 1.25 THEN -1.0 WHEN z < -1.25 THEN 1.0 ELSE 0.0 END::DOUBLE AS zscore_mr,
    CASE WHEN volume >= mv AND abs(high - low) >= mr THEN 1.0 ELSE 0.0 END::DOUBLE AS liquid FROM (
    SELECT *, ({avg('close', 20, 10)}) - ({avg('close', 80, 40)}) AS sma, {RSI} AS rsi, {zsc('close', 80, 40)} AS z,
    CASE WHEN count(high) {_CH} >= 30 THEN max(high) {_CH} END AS prior_high,
    CASE WHEN count(low) {_CH} >= 30 THEN min(low) {_CH} END AS prior_low,
    {gated('quantile_cont({}, 0.5)', 'volume', 60, 30)} AS mv, {gated('quantile_cont({}, 0.5)', 'abs(high - low)', 60, 30)} AS mr
    FROM gains15) t""",
)
view(
    "sig15",
    " UNION ALL ".join(
        f"SELECT b.symbol, b.idx, b.date, b.close, '{s}__{v}' AS strategy, {s} * {m} AS signal FROM base15 b "
        "JOIN aligned15 a ON a.symbol = b.symbol AND a.idx = b.idx"
        for s in sg.RULES
        for v, m in (
            ("baseline", "1.0::DOUBLE"),
            ("regime_aware", "CASE WHEN regime_name IN ('Trend + High Volatility', 'Range + High Volatility') THEN 0.5 ELSE 1.0 END::DOUBLE"),
            ("liquidity_filtered", "liquid"),
        )
    ),
)


def returns_sql(src: str, keys: str = "symbol, strategy", cost: str = "0.25") -> str:
    w = f"(PARTITION BY {keys} ORDER BY idx)"
    return f"""SELECT *, position * move - turnover * ({cost}::DOUBLE / 10000) AS "return" FROM (
    SELECT *, abs(position - coalesce(lag(position) OVER {w}, 0)) AS turnover,
    coalesce(close / nullif(lag(close) OVER {w}, 0) - 1, 0) AS move FROM (
    SELECT *, coalesce(lag(signal) OVER {w}, 0) AS position FROM {src}) a) b"""


def metrics_sql(src: str, keys: str, extra: str = "") -> str:
    """Metrics of the returns table ``src`` per ``keys``; rows ordered by idx."""
    part = f"PARTITION BY {keys} ORDER BY idx ROWS UNBOUNDED PRECEDING"
    on = " AND ".join(f"m.{k} = t.{k}" for k in keys.split(", "))
    return f"""SELECT {keys}, count(*) AS bars, coalesce(max_by(e, idx) / nullif(min_by(e, idx), 0) - 1, 0) AS total_return,
    avg(r) AS expectancy,
    CASE WHEN stddev_pop(r) > 1e-12 THEN sqrt(98280::DOUBLE) * avg(r) / stddev_pop(r) ELSE 0 END AS sharpe,
    CASE WHEN stddev_pop(r) FILTER (r < 0) > 1e-12 THEN sqrt(98280::DOUBLE) * avg(r) / stddev_pop(r) FILTER (r < 0) ELSE 0 END AS sortino,
    min(e / peak) - 1 AS max_drawdown, any_value(v) AS var_95, avg(r) FILTER (r <= v) AS cvar_95,
    avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS bar_win_rate{extra} FROM (
    SELECT *, quantile_cont(r, 0.05) OVER (PARTITION BY {keys}) AS v, max(e) OVER ({part}) AS peak FROM (
    SELECT *, product(1 + r) OVER ({part}) AS e FROM (SELECT *, coalesce("return", 0) AS r FROM {src}) a) b) c GROUP BY {keys}"""


def trades_sql(src: str, keys: str) -> str:
    w = f"(PARTITION BY {keys} ORDER BY idx)"
    return f"""SELECT {keys}, entry_date, coalesce(next_date, last_date) AS exit_date, CASE WHEN exposure > 0 THEN 'LONG' ELSE 'SHORT' END AS side,
    exposure AS entry_exposure, coalesce(next_position, 0) AS exit_exposure, entry_price, coalesce(next_close, last_close) AS exit_price,
    growth * (1 + coalesce(next_return, 0)) - 1 AS "return", coalesce(next_idx, last_idx) - entry_idx + 1 AS bars_held,
    CASE WHEN next_idx IS NULL THEN 'end_of_sample' WHEN abs(next_position) > 1e-12 THEN 'signal_flip' ELSE 'signal_exit' END AS exit_reason,
    100000 * (growth * (1 + coalesce(next_return, 0)) - 1) AS pnl FROM (
    SELECT *, lead(entry_idx) OVER x AS next_idx, lead(entry_date) OVER x AS next_date, lead(exposure) OVER x AS next_position,
    lead(entry_price) OVER x AS next_close, lead(first_return) OVER x AS next_return,
    max(end_idx) OVER (PARTITION BY {keys}) AS last_idx, max(end_date) OVER (PARTITION BY {keys}) AS last_date,
    last_value(end_close) OVER (PARTITION BY {keys} ORDER BY entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_close
    FROM (SELECT {keys}, run, min(idx) AS entry_idx, min(date) AS entry_date, any_value(position) AS exposure, min_by(close, idx) AS entry_price,
    min_by("return", idx) AS first_return, product(1 + "return") AS growth, max(idx) AS end_idx, max(date) AS end_date, max_by(close, idx) AS end_close
    FROM (SELECT *, sum(flag) OVER (PARTITION BY {keys} ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN abs(position - coalesce(lag(position) OVER {w}, 0)) > 1e-12 THEN 1 ELSE 0 END AS flag FROM {src}) a) b GROUP BY {keys}, run) c
    WINDOW x AS (PARTITION BY {keys} ORDER BY entry_idx)) d WHERE abs(exposure) > 1e-12"""


def trade_summary_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS num_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS win_rate,
    CASE WHEN coalesce(sum(-pnl) FILTER (pnl < 0), 0) > 1e-12 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / sum(-pnl) FILTER (pnl < 0)
    WHEN coalesce(sum(pnl) FILTER (pnl > 0), 0) > 0 THEN 'inf'::DOUBLE ELSE 0 END AS profit_factor,
    CASE WHEN coalesce(avg(-pnl) FILTER (pnl < 0), 0) > 1e-12 THEN avg(pnl) / avg(-pnl) FILTER (pnl < 0) ELSE 0 END AS expected_r
    FROM {src} GROUP BY {keys}"""


K = "symbol, strategy"
view("bret15", returns_sql("sig15"))
view("bmet15", metrics_sql("bret15", K, ", sum(turnover) AS turnover"))
view("btrades15", trades_sql("bret15", K))
view("btsum15", trade_summary_sql("btrades15", K))
view(
    "bfull15",
    """SELECT m.*, coalesce(num_trades, 0) AS num_trades, coalesce(win_rate, 0) AS win_rate, coalesce(profit_factor, 0) AS profit_factor,
    coalesce(expected_r, 0) AS expected_r FROM bmet15 m LEFT JOIN btsum15 USING (symbol, strategy)""",
)
view(
    "bregret15",
    "SELECT r.*, a.regime_id, a.regime_name FROM bret15 r JOIN aligned15 a ON a.symbol = r.symbol AND a.idx = r.idx WHERE a.regime_id IS NOT NULL",
)
view("breg15", metrics_sql("bregret15", K + ", regime_id, regime_name"))

FLOATS = ["total_return", "expectancy", "sharpe", "sortino", "max_drawdown", "var_95", "cvar_95", "bar_win_rate"]
TRADE_COLS = ["entry_date", "exit_date", "side", "bars_held", "exit_reason"]
TRADE_FLOATS = ["entry_exposure", "exit_exposure", "entry_price", "exit_price", "return", "pnl"]


def q(names):
    return ", ".join(f"{rnd(chr(34) + n + chr(34), 6)} AS \"{n}\"" for n in names)


def rules(spark, sf):
    """Long rule signals with regime sizing from the given centers."""
    base = indexed(spark, sf)
    return sg.strategy_signals(base, labelled(spark, sf), strategies=sg.RULES)


@shared
def rule_returns(spark, sf):
    return bt.strategy_returns(None, rules(spark, sf))


@shared
def rule_trades(spark, sf):
    return bt.trades(rule_returns(spark, sf))


@shared
def regime_bars(spark, sf):
    return sg.aligned_regimes(indexed(spark, sf), labelled(spark, sf))


# --- flagship ----------------------------------------------------------------

view(
    "flag_sig",
    "SELECT symbol, idx, date, close, 'sma_cross' AS strategy, sma_cross AS signal FROM base15",
)
view("flag_ret", returns_sql("flag_sig"))
view("flag_met", metrics_sql("flag_ret", K, ", sum(turnover) AS turnover"))


@check("flagship_sma_cross_metrics", f"SELECT symbol, strategy, bars, {q(FLOATS + ['turnover'])} FROM flag_met")
def _(spark, sf):
    base = sg.base_signals(indexed(spark, sf), strategies=["sma_cross"])
    signals = base.select("symbol", "idx", "date", "close", F.lit("sma_cross").alias("strategy"), F.col("sma_cross").alias("signal"))
    returns = staged(bt.strategy_returns(None, signals))
    return rounded(bt.return_metrics(returns).join(bt.turnover(returns), ["symbol", "strategy"]), 6)


# --- regime preparation, assignment, labels ----------------------------------


@check("m1_column_gate", f"SELECT symbol, \"column\", non_null, {rnds('deviation')}, non_null >= 20 AND coalesce(deviation, 0) > 1e-12 AS usable FROM gate15")
def _(spark, sf):
    return rounded(rg.column_gate(fx.minute_features(indexed(spark, sf)), COLS))


@check("m1_complete_rows", f"SELECT symbol, idx, date, pos, {rnds(*COLS)} FROM complete15")
def _(spark, sf):
    return rounded(complete(spark, sf).select("symbol", "idx", "date", "pos", *COLS))


@check("m2_standardised", "SELECT symbol, idx, " + ", ".join(f"{rnd(f'z{i}', 7)} AS z{i}" for i in range(len(COLS))) + " FROM z15")
def _(spark, sf):
    return rounded(scaled(spark, sf).select("symbol", "idx", *[F.col("z")[i].alias(f"z{i}") for i in range(len(COLS))]), 7)


@check("m3b_nearest_center", "SELECT symbol, idx, CAST(raw AS INTEGER) AS raw FROM raw15")
def _(spark, sf):
    return clustered(spark, sf).select("symbol", "idx", "raw")


@check("a5_axis_stats", f"SELECT symbol, raw, bars, {rnds('vol_axis', 'structure_axis')} FROM axis15")
def _(spark, sf):
    return rounded(rg.axis_stats(clustered(spark, sf)))


@check("m4_quadrant_mapping", f"SELECT symbol, raw, bars, regime_id, {name_of('regime_id')} AS regime_name, {rnds('vol_axis', 'structure_axis')} FROM quad15")
def _(spark, sf):
    return rounded(rg.quadrants(rg.axis_stats(clustered(spark, sf))))


@check(
    "m8_label_table",
    "SELECT symbol, idx, date, regime_id, regime_name, 'given_centers' AS regime_model, "
    + ", ".join(f"CASE WHEN regime_id = {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS prob_regime_{k}" for k in range(4)) + " FROM lab15",
)
def _(spark, sf):
    return rg.label_table(labelled(spark, sf), "given_centers")


@check(
    "a6_regime_stats",
    f"SELECT symbol, regime_id, any_value(regime_name) AS regime_name, count(*) AS bars, {', '.join(f'{rnd(f"avg({c})")} AS {c}_mean' for c in COLS)} FROM lab15 GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(rg.regime_stats(labelled(spark, sf), COLS))


view("moves15", "SELECT *, lag(regime_id) OVER (PARTITION BY symbol ORDER BY idx) AS previous FROM lab15")


@check(
    "a7_transition_matrix",
    "SELECT symbol, previous AS from_regime, " + ", ".join(f"{rnd(f'avg(CASE WHEN regime_id = {k} THEN 1.0 ELSE 0.0 END::DOUBLE)')} AS to_{k}" for k in range(4))
    + " FROM moves15 WHERE previous IS NOT NULL GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(rg.transitions(labelled(spark, sf)))


W = 200
_SH = ", ".join(f"avg(CASE WHEN regime_id = {k} THEN 1.0 ELSE 0.0 END::DOUBLE) AS regime_{k}_share" for k in range(4))
SHARES = [f"regime_{k}_share" for k in range(4)]
view("stab15", f"SELECT symbol, min(date) AS window_start, max(date) AS window_end, count(*) AS bars, {_SH} FROM lab15 GROUP BY symbol, pos // {W}")
view(
    "stabscore15",
    f"""SELECT symbol, CASE WHEN total >= {W} AND runs >= 2 THEN greatest(0, 1 - 4 * dev) ELSE 0.5 END AS rolling_stability_score FROM (
    SELECT symbol, sum(bars) AS total, count(*) FILTER (bars >= {W // 4}) AS runs,
    ({' + '.join(f'stddev_pop(CASE WHEN bars >= {W // 4} THEN {s} END)' for s in SHARES)}) / 4 AS dev FROM stab15 GROUP BY 1) t""",
)
view(
    "persist15",
    f"""SELECT symbol, rows, min_share, greatest(0, least(1, min_share / 0.10::DOUBLE)) AS cluster_balance_score, kept AS transition_persistence,
    1 - kept AS churn FROM (SELECT symbol, rows, kept, least({', '.join(SHARES)}) AS min_share FROM (
    SELECT symbol, count(*) AS rows, avg(CASE WHEN coalesce(previous = regime_id, false) THEN 1.0 ELSE 0.0 END::DOUBLE) AS kept, {_SH}
    FROM moves15 GROUP BY 1) a) b""",
)
view(
    "interp15",
    """SELECT symbol, greatest(0, least(2, (high - low) / (sv + 1e-12) + (trending - ranging) / (ss + 1e-12))) / 2 AS interpretability_score,
    0.5::DOUBLE * CASE WHEN high > low THEN 1 ELSE 0 END + 0.5::DOUBLE * CASE WHEN trending > ranging THEN 1 ELSE 0 END AS semantics FROM (
    SELECT symbol, avg(v) FILTER (regime_id IN (0, 1)) AS low, avg(v) FILTER (regime_id IN (2, 3)) AS high, stddev_pop(v) AS sv,
    avg(s) FILTER (regime_id IN (0, 3)) AS ranging, avg(s) FILTER (regime_id IN (1, 2)) AS trending, stddev_pop(s) AS ss FROM (
    SELECT symbol, regime_id, avg(vol_axis) AS v, avg(structure_axis) AS s FROM lab15 GROUP BY 1, 2) a GROUP BY 1) b""",
)


def silhouette_sql(rows: str, keys: list[str], dims: range) -> str:
    """Squared-Euclidean silhouette over all rows of a view, from each cluster's count, sums and sum of squares."""
    k, on = ", ".join(keys), " AND ".join(f"p.{c} = c.{c}" for c in keys)
    square = " + ".join(f"z{j} * z{j}" for j in dims)
    far = f"greatest(c.n * ({square.replace('z', 'p.z')}) + c.q - 2 * ({' + '.join(f'p.z{j} * c.s{j}' for j in dims)}), 0)"
    return f"""SELECT {k}, CASE WHEN count(*) >= 4 THEN avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) ELSE 0 END AS silhouette_score FROM (
    SELECT {", ".join(f"p.{c}" for c in keys)}, p.idx, max(CASE WHEN p.regime_id = c.regime_id AND c.n > 1 THEN {far} / (c.n - 1) END) AS a,
    min(CASE WHEN p.regime_id <> c.regime_id THEN {far} / c.n END) AS b FROM {rows} p JOIN (
    SELECT {k}, regime_id, count(*) AS n, sum({square}) AS q, {", ".join(f"sum(z{j}) AS s{j}" for j in dims)} FROM {rows} GROUP BY {k}, regime_id) c ON {on}
    GROUP BY {", ".join(f"p.{c}" for c in keys)}, p.idx) v GROUP BY {k}"""


view("sil15", silhouette_sql("lab15", ["symbol"], range(len(COLS))))
view(
    "scores15",
    """SELECT *, silhouette_score * 0.35 + cluster_balance_score * 0.20 + rolling_stability_score * 0.15 + transition_persistence * 0.10 + interpretability_score * 0.20 AS score,
    silhouette_score * 0.45 + cluster_balance_score * 0.25 + transition_persistence * 0.10 + interpretability_score * 0.20 AS dev_score,
    silhouette_score * 0.30 + interpretability_score * 0.20 + transition_persistence * 0.10 + greatest(0, 1 - churn * 5) * 0.15
    + greatest(0, least(1, min_share / 0.05::DOUBLE)) * 0.15 + semantics * 0.10 AS oos_score
    FROM persist15 JOIN interp15 USING (symbol) JOIN stabscore15 USING (symbol) JOIN sil15 USING (symbol)""",
)


@check("a8_stability_runs", f"SELECT symbol, window_start, window_end, bars, {rnds(*SHARES)} FROM stab15")
def _(spark, sf):
    return rounded(rg.stability(labelled(spark, sf), W))


@check("a9_stability_score", f"SELECT symbol, {rnds('rolling_stability_score')} FROM stabscore15")
def _(spark, sf):
    return rounded(rg.stability_score(labelled(spark, sf), W))


_P = ["min_share", "cluster_balance_score", "transition_persistence", "churn"]


@check("a10_balance_persistence", f"SELECT symbol, rows, {rnds(*_P)} FROM persist15")
def _(spark, sf):
    return rounded(rg.balance_persistence(labelled(spark, sf), ["symbol"]))


@check("a11_interpretability", f"SELECT symbol, {rnds('interpretability_score', 'semantics')} FROM interp15")
def _(spark, sf):
    return rounded(rg.interpretability(labelled(spark, sf), ["symbol"]))


@check("m5_silhouette", f"SELECT symbol, {rnds('silhouette_score')} FROM sil15")
def _(spark, sf):
    return rounded(rg.silhouette(labelled(spark, sf)))


@check("a12_composite_scores", f"SELECT symbol, {rnds('score', 'dev_score')} FROM scores15")
def _(spark, sf):
    return rounded(rg.candidate_scores(labelled(spark, sf), ["symbol"], W).select("symbol", "score", "dev_score"))


@check("a17_oos_score", f"SELECT symbol, {rnds('oos_score')} FROM scores15")
def _(spark, sf):
    return rounded(rg.candidate_scores(labelled(spark, sf), ["symbol"], W).select("symbol", "oos_score"))


# --- signals -----------------------------------------------------------------


def _signal_check(name: str, column: str):
    @check(name, f"SELECT symbol, idx, date, {rnds(column)} FROM base15")
    def _(spark, sf):
        base = sg.base_signals(indexed(spark, sf), strategies=[column])
        return rounded(base.select("symbol", "idx", "date", column))


_signal_check("g1_sma_cross", "sma_cross")
_signal_check("g2_donchian", "donchian")
_signal_check("g3_rsi_reversion", "rsi_mr")
_signal_check("g4_zscore_reversion", "zscore_mr")
_signal_check("g6_liquidity_mask", "liquid")


@check("j6_price_regime_frame", f"SELECT symbol, idx, date, {rnds('close')}, CAST(regime_id AS DOUBLE) AS regime_id, regime_name FROM aligned15")
def _(spark, sf):
    rows = regime_bars(spark, sf).select("symbol", "idx", "date", "close", F.col("regime_id").cast("double").alias("regime_id"), "regime_name")
    return rounded(rows)


@check(
    "g7_risk_multiplier",
    """SELECT symbol, idx, CASE WHEN regime_name IN ('Trend + High Volatility', 'Range + High Volatility') THEN 0.5 ELSE 1.0 END::DOUBLE
    AS multiplier FROM aligned15""",
)
def _(spark, sf):
    return regime_bars(spark, sf).select("symbol", "idx", sg.risk_multiplier(F.col("regime_name")).alias("multiplier"))


@check("g8_strategy_variants", f"SELECT symbol, idx, date, strategy, {rnds('signal')} FROM sig15")
def _(spark, sf):
    return rounded(rules(spark, sf).select("symbol", "idx", "date", "strategy", "signal"))


@check(
    "f11_clipped_signal",
    f"SELECT symbol, idx, {rnd('least(greatest(coalesce(log_return, 0) * 40, -1), 1)')} AS signal FROM e1",
)
def _(spark, sf):
    rows = fx.minute_features(indexed(spark, sf))
    return rounded(rows.select("symbol", "idx", sg.clipped_signal(F.col("log_return") * 40).alias("signal")))


@check(
    "f12_wide_signals",
    "SELECT symbol, date, " + ", ".join(f"coalesce(max(signal) FILTER (strategy = '{s}'), 0) + 0.0 AS {s}" for s in STRATEGIES)
    + " FROM sig15 GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(sg.wide_signals(rules(spark, sf), STRATEGIES))


# --- backtest ----------------------------------------------------------------


@check("w20_next_bar_returns", f"SELECT symbol, strategy, idx, {rnds('position', 'turnover')}, {rnd(chr(34) + 'return' + chr(34))} AS \"return\" FROM bret15")
def _(spark, sf):
    out = bt.strategy_returns(None, rules(spark, sf))
    return rounded(out.select("symbol", "strategy", "idx", "position", "turnover", "return"))


@check(
    "w11_equity_curves",
    f"""SELECT symbol, strategy, idx, {rnd('ln(100000 * product(1 + "return") OVER (PARTITION BY symbol, strategy ORDER BY idx ROWS UNBOUNDED PRECEDING))', 6)}
    AS log_equity FROM bret15""",
)
def _(spark, sf):
    curves = bt.equity_curves(rule_returns(spark, sf))
    return rounded(curves.select("symbol", "strategy", "idx", F.ln("equity").alias("log_equity")), 6)


@check("a13_return_metrics", f"SELECT symbol, strategy, bars, {q(FLOATS)} FROM bmet15")
def _(spark, sf):
    return rounded(bt.return_metrics(rule_returns(spark, sf)), 6)


@check("w16_trades", f"SELECT symbol, strategy, {', '.join(TRADE_COLS)}, {q(TRADE_FLOATS)} FROM btrades15")
def _(spark, sf):
    return rounded(bt.trades(rule_returns(spark, sf)).select("symbol", "strategy", *TRADE_COLS, *TRADE_FLOATS), 6)


@check("a14_trade_summary", f"SELECT symbol, strategy, num_trades, {q(['win_rate', 'profit_factor', 'expected_r'])} FROM btsum15")
def _(spark, sf):
    return rounded(bt.trade_summary(rule_trades(spark, sf)), 6)


@check(
    "a14_r_multiples",
    f"""SELECT t.symbol, t.strategy, entry_date, {rnd('CASE WHEN u > 1e-12 THEN pnl / u ELSE 0 END', 6)} AS r_multiple_proxy FROM btrades15 t
    JOIN (SELECT symbol, strategy, coalesce(avg(-pnl) FILTER (pnl < 0), 0) AS u FROM btrades15 GROUP BY 1, 2) s USING (symbol, strategy)""",
)
def _(spark, sf):
    rows = bt.with_r_multiple(rule_trades(spark, sf))
    return rounded(rows.select("symbol", "strategy", "entry_date", "r_multiple_proxy"), 6)


@check("a15_regime_metrics", f"SELECT symbol, strategy, regime_id, regime_name, bars, {q(FLOATS)}, {rnd('bar_win_rate', 6)} AS win_rate FROM breg15")
def _(spark, sf):
    return rounded(bt.regime_metrics(rule_returns(spark, sf), regime_bars(spark, sf)), 6)


@check(
    "b2_regime_alignment",
    "SELECT symbol, strategy, count(*) AS bars, min(idx) AS first_idx FROM bregret15 GROUP BY 1, 2",
)
def _(spark, sf):
    named = regime_bars(spark, sf).where(F.col("regime_id").isNotNull()).select("symbol", "idx")
    rows = rule_returns(spark, sf).join(named, ["symbol", "idx"])
    return rows.groupBy("symbol", "strategy").agg(F.count(F.lit(1)).alias("bars"), F.min("idx").alias("first_idx"))


@check("b1_backtest_metrics", f"SELECT symbol, strategy, bars, num_trades, {q(FLOATS + ['turnover', 'win_rate', 'profit_factor', 'expected_r'])} FROM bfull15")
def _(spark, sf):
    return rounded(bt.run_backtests(None, rules(spark, sf)).metrics, 6)


@check("t6_metrics_sorted", f"SELECT symbol, strategy, bars, {q(['sharpe', 'total_return'])} FROM bfull15 ORDER BY symbol, strategy")
def _(spark, sf):
    rows = bt.return_metrics(rule_returns(spark, sf))
    return rounded(rows.select("symbol", "strategy", "bars", "sharpe", "total_return"), 6).orderBy("symbol", "strategy")


@check(
    "u1_union_of_strategies",
    "SELECT strategy, count(*) AS rows FROM sig15 GROUP BY 1",
)
def _(spark, sf):
    parts = None
    base = sg.base_signals(indexed(spark, sf)).withColumn("multiplier", F.lit(1.0))
    for s in sg.RULES:
        one = sg.variants(base, [s])
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("strategy").agg(F.count(F.lit(1)).alias("rows"))

