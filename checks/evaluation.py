"""Walk-forward blocks, resampled paths, and questions over the results."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.functions.scalar import uniform
from barlight.operators import features as fx
from barlight.operators import regimes as rg
from barlight.operators import report as rp
from barlight.operators import stress as st
from barlight.operators import walkforward as wf
from barlight.session import staged
from checks import trading as tr
from checks.registry import check, rnd, rnds, rounded, shared, view
from checks.trading import FLOATS, K, metrics_sql, q, returns_sql, trade_summary_sql, trades_sql
from checks.views import indexed

PLAN = wf.WalkForward(train=600, test=240, step=240, least_train=400)
OVERLAP = wf.WalkForward(train=600, test=240, step=100, least_train=400)
MODELS = {fx.MINUTE: fx.COLUMNS[fx.MINUTE], fx.SCRIPTED: fx.COLUMNS[fx.SCRIPTED]}
CANDIDATES = {fx.MINUTE: "e1", fx.SCRIPTED: "e2"}
MK = ["symbol", "candidate", "block"]

# --- walk-forward ------------------------------------------------------------

view("counts15", "SELECT symbol, max(idx) + 1 AS n FROM idx15 GROUP BY 1")


def slices_sql(plan: wf.WalkForward) -> str:
    t, e, s = plan.train, plan.test, plan.stride
    return f"""SELECT symbol, CAST(b AS INTEGER) AS block, b * {s} AS train_start, b * {s} + {t} AS train_end, b * {s} + {t} AS test_start,
    b * {s} + {t + e} AS test_end FROM counts15, range(0, 100000) g(b) WHERE b * {s} + {t + e} <= n"""


view("slices15", slices_sql(PLAN))
view("slices15o", slices_sql(OVERLAP))
for _i, (_name, _src) in enumerate(CANDIDATES.items()):
    _cols = MODELS[_name]
    view(
        f"wfrows{_i}",
        f"SELECT symbol, '{_name}' AS candidate, idx, date, vol_axis, structure_axis, "
        + ", ".join(f"{c} AS c{j}" for j, c in enumerate(_cols)) + f" FROM {_src} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _cols)
        + f" QUALIFY count(*) OVER (PARTITION BY symbol) >= {rg.LEAST_ROWS}",
    )
view("wfrows", "SELECT * FROM wfrows0 UNION ALL SELECT * FROM wfrows1")
_D = range(8)
view(
    "wfvalid",
    f"""SELECT candidate, s.* FROM slices15 s JOIN wfrows r ON r.symbol = s.symbol AND r.idx >= train_start AND r.idx < test_end
    GROUP BY ALL HAVING count(*) FILTER (r.idx < train_end) >= {PLAN.least_train} AND count(*) FILTER (r.idx >= test_start) >= {PLAN.least_test}""",
)
view(
    "wfz",
    "SELECT r.symbol, r.candidate, block, r.idx, date, vol_axis, structure_axis, r.idx >= test_start AS is_test, "
    + ", ".join(f"(c{j} - avg(c{j}) FILTER (r.idx < train_end) OVER w) / stddev_pop(c{j}) FILTER (r.idx < train_end) OVER w AS z{j}" for j in _D)
    + """ FROM wfvalid v JOIN wfrows r ON r.symbol = v.symbol AND r.candidate = v.candidate AND r.idx >= train_start AND r.idx < test_end
    WINDOW w AS (PARTITION BY r.symbol, r.candidate, block)""",
)
_DIST = [" + ".join(f"(z{j} - ({x})) * (z{j} - ({x}))" for j, x in enumerate(row)) for row in tr.CENTERS]
view(
    "wfraw",
    f"""SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 AND d0 <= d3 THEN 0 WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS raw
    FROM (SELECT *, {', '.join(f'{d} AS d{k}' for k, d in enumerate(_DIST))} FROM wfz) t""",
)
view(
    "wfquad",
    """SELECT *, CASE WHEN NOT wild AND t = 1 THEN 0 WHEN NOT wild THEN 1 WHEN t = 2 THEN 2 ELSE 3 END AS regime_id FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, candidate, block, wild ORDER BY s, raw) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, candidate, block ORDER BY v, s, raw) > 2 AS wild,
    count(*) OVER (PARTITION BY symbol, candidate, block) AS n FROM (SELECT symbol, candidate, block, raw, avg(vol_axis) AS v, avg(structure_axis) AS s
    FROM wfraw WHERE NOT is_test GROUP BY ALL) x) a) b WHERE n = 4""",
)
view(
    "wflab",
    f"""SELECT r.*, q.regime_id, {tr.name_of('q.regime_id')} AS regime_name FROM wfraw r
    JOIN wfquad q USING (symbol, candidate, block, raw) WHERE is_test""",
)
_SH = ", ".join(f"avg(CASE WHEN regime_id = {k} THEN 1.0 ELSE 0.0 END::DOUBLE) AS s{k}" for k in range(4))
G = "symbol, candidate, block"
view(
    "wfpersist",
    f"""SELECT {G}, kept, 1 - kept AS churn, least(s0, s1, s2, s3) AS min_share FROM (SELECT {G}, {_SH},
    avg(CASE WHEN coalesce(previous = regime_id, false) THEN 1.0 ELSE 0.0 END::DOUBLE) AS kept FROM (
    SELECT *, lag(regime_id) OVER (PARTITION BY {G} ORDER BY idx) AS previous FROM wflab) a GROUP BY {G}) b""",
)
view(
    "wfinterp",
    f"""SELECT {G}, coalesce(CASE WHEN (high - low) / (sv + 1e-12) + (trending - ranging) / (ss + 1e-12) IS NOT NULL THEN
    greatest(0, least(2, (high - low) / (sv + 1e-12) + (trending - ranging) / (ss + 1e-12))) / 2 END, 1) AS interp,
    0.5::DOUBLE * CASE WHEN high > low THEN 1 ELSE 0 END + 0.5::DOUBLE * CASE WHEN trending > ranging THEN 1 ELSE 0 END AS semantics FROM (
    SELECT {G}, avg(v) FILTER (regime_id IN (0, 1)) AS low, avg(v) FILTER (regime_id IN (2, 3)) AS high, stddev_pop(v) AS sv,
    avg(s) FILTER (regime_id IN (0, 3)) AS ranging, avg(s) FILTER (regime_id IN (1, 2)) AS trending, stddev_pop(s) AS ss FROM (
    SELECT {G}, regime_id, avg(vol_axis) AS v, avg(structure_axis) AS s FROM wflab GROUP BY {G}, regime_id) a GROUP BY {G}) b""",
)
view("wfsil", tr.silhouette_sql("wflab", ["symbol", "candidate", "block"], _D))
PARTS = list(wf.SCORE_PARTS)
view(
    "wfscore",
    f"""SELECT *, oos_silhouette * 0.30 + oos_interpretability * 0.20 + oos_persistence * 0.10 + oos_churn_score * 0.15 + oos_coverage_score * 0.15
    + oos_semantics_score * 0.10 AS oos_score FROM (SELECT {G}, silhouette_score AS oos_silhouette, interp AS oos_interpretability, kept AS oos_persistence,
    churn AS oos_churn, greatest(0, 1 - churn * 5) AS oos_churn_score, min_share AS oos_min_share,
    greatest(0, least(1, min_share / 0.05::DOUBLE)) AS oos_coverage_score, semantics AS oos_semantics_score
    FROM wfpersist JOIN wfinterp USING (symbol, candidate, block) JOIN wfsil USING (symbol, candidate, block)) t""",
)
view(
    "wfrank",
    f"""SELECT symbol, candidate, 'given' AS model_family, CASE WHEN blocks IS NULL THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN blocks IS NULL THEN 'no block with enough rows could be scored' END AS reason, blocks - blocks AS failed_blocks, * EXCLUDE (symbol, candidate) FROM (
    SELECT DISTINCT symbol, candidate FROM wfrows) m LEFT JOIN (SELECT symbol, candidate, count(*) AS blocks, avg(oos_score) AS oos_score_mean,
    stddev_pop(oos_score) AS oos_score_std, {', '.join(f'avg({p}) AS {p}' for p in PARTS)} FROM wfscore GROUP BY 1, 2) s USING (symbol, candidate)""",
)


@shared
def wf_features(spark, sf):
    """Complete rows of both families, one table per family with its own columns."""
    base = indexed(spark, sf)
    made = {fx.MINUTE: fx.minute_features(base), fx.SCRIPTED: fx.scripted_features(base)}
    return {
        name: staged(rg.complete_rows(made[name], cols).withColumn("candidate", F.lit(name))) for name, cols in MODELS.items()
    }


@shared
def wf_labels(spark, sf, names=tuple(MODELS)):
    counts = staged(wf.bar_counts(indexed(spark, sf)))
    out = None
    for name in names:
        rows = wf_features(spark, sf)[name]
        train, test, valid = wf.scaled_sides(rows, MODELS[name], counts, PLAN, MK)
        given = valid.select(*MK).withColumn("centers", tr.centers())
        part = wf.labels_from_centers(train, test, given, MK).select(*MK, "idx", "date", *rg.AXES, "z", "regime_id", "regime_name")
        out = part if out is None else out.unionByName(part)
    return out


@check("b3_walk_forward_slices", "SELECT * FROM slices15o")
def _(spark, sf):
    return wf.slices(wf.bar_counts(indexed(spark, sf)), OVERLAP)


@check("j8_rows_in_blocks", "SELECT i.symbol, idx, block FROM idx15 i JOIN slices15o s ON s.symbol = i.symbol AND idx >= train_start AND idx < train_end")
def _(spark, sf):
    base = indexed(spark, sf)
    return wf.in_blocks(base, wf.bar_counts(base), OVERLAP, "train").select("symbol", "idx", "block")


@check("j8_rows_in_test_blocks", "SELECT i.symbol, idx, block FROM idx15 i JOIN slices15o s ON s.symbol = i.symbol AND idx >= test_start AND idx < test_end")
def _(spark, sf):
    base = indexed(spark, sf)
    return wf.in_blocks(base, wf.bar_counts(base), OVERLAP, "test").select("symbol", "idx", "block")


@check(
    "b4_walk_forward_labels",
    """SELECT symbol, candidate, block, idx, date, regime_id, regime_name, train_start AS train_start_idx, train_end - 1 AS train_end_idx,
    test_start AS test_start_idx, test_end - 1 AS test_end_idx FROM wflab JOIN slices15 USING (symbol, block)""",
)
def _(spark, sf):
    labels = wf_labels(spark, sf)
    ranges = wf.slices(wf.bar_counts(indexed(spark, sf)), PLAN)
    return wf.with_ranges(labels, ranges).drop("z", *rg.AXES)


@check("a17_block_scores", f"SELECT {G}, {rnds('oos_score', *PARTS)} FROM wfscore")
def _(spark, sf):
    scores = wf.block_scores(wf_labels(spark, sf), MK)
    return rounded(scores.select(*MK, "oos_score", *[F.col(c).alias(n) for n, c in wf.SCORE_PARTS.items()]))


@check("a18_model_ranking", f"SELECT symbol, candidate, model_family, status, reason, CAST(failed_blocks AS DOUBLE) AS failed_blocks, CAST(blocks AS DOUBLE) AS blocks, {rnds('oos_score_mean', 'oos_score_std', *PARTS)} FROM wfrank")
def _(spark, sf):
    keys = ["symbol", "candidate", "model_family"]
    labels = wf_labels(spark, sf)
    tried = None
    for rows in wf_features(spark, sf).values():
        part = rows.select("symbol", "candidate").distinct()
        tried = part if tried is None else tried.unionByName(part)
    scores = wf.block_scores(labels, MK).withColumn("model_family", F.lit("given"))
    return rounded(wf.rank_models(scores, tried.withColumn("model_family", F.lit("given")), keys).withColumns({c: F.col(c).cast("double") for c in ("blocks", "failed_blocks")}))


# strategies per block, with the minute model's labels
STRATS = ["sma_cross__baseline", "sma_cross__regime_aware", "zscore_mr__baseline"]
_IN = ", ".join(f"'{s}'" for s in STRATS)
BK = "symbol, strategy, block"
view("wfl1", f"SELECT * FROM wflab WHERE candidate = '{fx.MINUTE}'")
view("wfblocks", "SELECT DISTINCT symbol, block, test_start, test_end FROM wfl1 JOIN slices15 USING (symbol, block)")
view(
    "wfreg",
    """SELECT symbol, block, idx, date, last_value(regime_id IGNORE NULLS) OVER w AS regime_id, last_value(regime_name IGNORE NULLS) OVER w AS regime_name FROM (
    SELECT i.symbol, b.block, i.idx, i.date, l.regime_id, l.regime_name FROM idx15 i JOIN wfblocks b ON b.symbol = i.symbol AND i.idx >= test_start AND i.idx < test_end
    LEFT JOIN wfl1 l ON l.symbol = i.symbol AND l.block = b.block AND l.idx = i.idx) t WINDOW w AS (PARTITION BY symbol, block ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
)
view("wfsig", f"SELECT s.*, b.block FROM sig15 s JOIN wfblocks b ON b.symbol = s.symbol AND s.idx >= test_start AND s.idx < test_end WHERE strategy IN ({_IN})")
view("wfret", returns_sql("wfsig", BK))
view("wfmet", metrics_sql("wfret", BK, ", sum(turnover) AS turnover"))
view("wfregret", "SELECT r.*, g.regime_id, g.regime_name FROM wfret r JOIN wfreg g USING (symbol, block, idx) WHERE g.regime_id IS NOT NULL")
view("wfregmet", metrics_sql("wfregret", BK + ", regime_id, regime_name"))
view("wftrades", trades_sql("wfret", BK))
view("wftsum", trade_summary_sql("wftrades", K))
view("wfstitch", metrics_sql("wfret", K))
view(
    "wfstitchreg",
    metrics_sql(
        "(SELECT r.*, l.regime_id, l.regime_name FROM wfret r JOIN (SELECT symbol, date, min_by(regime_id, block) AS regime_id, "
        "min_by(regime_name, block) AS regime_name FROM wfl1 GROUP BY 1, 2) l USING (symbol, date)) z",
        K + ", regime_id, regime_name",
    ),
)


def wf_inputs(spark, sf):
    signals = tr.rules(spark, sf).where(F.col("strategy").isin(STRATS))
    return indexed(spark, sf), signals, wf_labels(spark, sf, (fx.MINUTE,))


@shared
def wf_result(spark, sf):
    base, signals, labels = wf_inputs(spark, sf)
    return wf.evaluate(base, signals, labels, PLAN)


@check("b5_block_metrics", f"SELECT symbol, strategy, block, bars, {q(FLOATS + ['turnover'])} FROM wfmet")
def _(spark, sf):
    out = wf_result(spark, sf).block_metrics
    return rounded(out.select("symbol", "strategy", "block", "bars", *FLOATS, "turnover"), 6)


@check("b5_block_regime_metrics", f"SELECT symbol, strategy, block, regime_id, regime_name, bars, {q(FLOATS)} FROM wfregmet")
def _(spark, sf):
    out = wf_result(spark, sf).block_regime_metrics
    return rounded(out.select("symbol", "strategy", "block", "regime_id", "regime_name", "bars", *FLOATS), 6)


@check(
    "a19_strategy_regime_ranking",
    f"""SELECT symbol, strategy, regime_id, regime_name, count(DISTINCT block) AS blocks, {', '.join(f'{rnd(f"avg({c})", 6)} AS {c}' for c in ('sharpe', 'expectancy', 'max_drawdown'))},
    {rnd('avg(bar_win_rate)', 6)} AS win_rate, CAST(sum(bars) AS BIGINT) AS bars FROM wfregmet GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    return rounded(wf_result(spark, sf).ranking, 6)


@check(
    "a29_stitched_metrics",
    f"""SELECT symbol, strategy, bars, coalesce(num_trades, 0) AS num_trades, {q(FLOATS)}, {', '.join(f'{rnd(f"coalesce({c}, 0)", 6)} AS {c}' for c in ('win_rate', 'profit_factor', 'expected_r'))}
    FROM wfstitch LEFT JOIN wftsum USING (symbol, strategy)""",
)
def _(spark, sf):
    return rounded(wf_result(spark, sf).metrics, 6)


@check("a29_stitched_regime_metrics", f"SELECT symbol, strategy, regime_id, regime_name, bars, {q(FLOATS)} FROM wfstitchreg")
def _(spark, sf):
    return rounded(wf_result(spark, sf).regime_metrics.drop("win_rate"), 6)


view(
    "wfallow",
    """SELECT symbol, strategy, block, list_sort(coalesce(list(regime_id) FILTER (sharpe > 0), [])) AS allowed FROM wfregmet GROUP BY 1, 2, 3""",
)


@check(
    "b6_allowed_regimes",
    "SELECT symbol, strategy, block, array_to_string(allowed, ',') AS allowed_regimes, 'sharpe' AS filter_metric, 0.0::DOUBLE AS filter_threshold FROM wfallow",
)
def _(spark, sf):
    return wf.allowed_regimes(wf_result(spark, sf).block_regime_metrics).drop("allowed")


@check(
    "b6_filtered_signals",
    f"""SELECT symbol, strategy, block, idx, {rnd('CASE WHEN coalesce(list_contains(allowed, g.regime_id), false) THEN signal ELSE 0 END')} AS signal
    FROM wfsig JOIN wfallow USING (symbol, strategy, block) LEFT JOIN wfreg g USING (symbol, block, idx)""",
)
def _(spark, sf):
    base, _, labels = wf_inputs(spark, sf)
    result = wf_result(spark, sf)
    allowed = wf.allowed_regimes(result.block_regime_metrics)
    regimes = wf.block_regimes(base, labels, wf.bar_counts(base), PLAN)
    out = wf.filtered_signals(result.signals, regimes, allowed)
    return rounded(out.select("symbol", "strategy", "block", "idx", "signal"))


# --- stress ------------------------------------------------------------------

SIMS, HORIZON, BLOCK, SEED = 12, 24, 6, 181
ST = tr.STRATEGIES
REQUEST = ["each", "all", "each", "no such regime"]
P = "symbol, strategy, regime_filter, stress_model, simulation"
SC = "symbol, strategy, regime_filter, stress_model"

view(
    "streg",
    """SELECT symbol, date, last_value(regime_name IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS regime_name FROM (
    SELECT DISTINCT i.symbol, i.date, l.regime_name FROM idx15 i LEFT JOIN lab15 l ON l.symbol = i.symbol AND l.date = i.date) t""",
)
view(
    "stfilt",
    """SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY o, regime_filter) - 1 AS INTEGER) AS position, regime_filter FROM (
    SELECT DISTINCT symbol, 0 AS o, regime_name AS regime_filter FROM streg WHERE regime_name IS NOT NULL UNION ALL
    SELECT DISTINCT symbol, 1, 'all' FROM streg) t""",
)
view(
    "stpool",
    f"""SELECT symbol, strategy, pool, row_number() OVER (PARTITION BY symbol, strategy, pool ORDER BY date) - 1 AS ord, r AS "return" FROM (
    SELECT symbol, strategy, 'all' AS pool, date, "return" AS r FROM bret15 UNION ALL
    SELECT b.symbol, strategy, regime_name, b.date, "return" FROM bret15 b JOIN streg g ON g.symbol = b.symbol AND g.date = b.date
    WHERE regime_name IS NOT NULL) t""",
)
view(
    "ststat",
    'SELECT symbol, strategy, pool, count(*) AS n, avg("return") AS mean, stddev_pop("return") AS deviation FROM stpool GROUP BY 1, 2, 3',
)
view(
    "stmix",
    """SELECT symbol, strategy, regime_filter, pool, n, sum(n) OVER w - n AS lo, sum(n) OVER w AS hi, sum(n) OVER (PARTITION BY symbol, strategy, regime_filter) AS total FROM (
    SELECT f.symbol, s.strategy, f.regime_filter, s.pool, s.n FROM stfilt f JOIN ststat s ON s.symbol = f.symbol AND s.pool <> 'all'
    AND (f.regime_filter = 'all' OR f.regime_filter = s.pool)) t WINDOW w AS (PARTITION BY symbol, strategy, regime_filter ORDER BY pool)""",
)
view(
    "stgrid",
    f"""SELECT f.symbol, s.strategy, f.regime_filter, stress_model, CAST(simulation AS INTEGER) AS simulation, CAST(step AS INTEGER) AS step, n, mean, deviation
    FROM stfilt f JOIN ststat s ON s.symbol = f.symbol AND s.pool = f.regime_filter,
    (VALUES ('gbm'), ('regime_mixture_gbm'), ('block_bootstrap')) m(stress_model), range({SIMS}) a(simulation), range(1, {HORIZON + 1}) b(step)""",
)


def draw(*tail: str) -> str:
    key = f"concat_ws(':', '{SEED}', symbol, strategy, regime_filter, stress_model, simulation, {', '.join(tail)})"
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


view("stdraw", f"SELECT *, {draw('step', chr(39) + 'a' + chr(39))} AS u1, {draw('step', chr(39) + 'b' + chr(39))} AS u2 FROM stgrid")
view(
    "stgbm",
    f"""SELECT {P}, step, mean + deviation * sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2) AS "return" FROM stdraw WHERE stress_model = 'gbm'""",
)
view(
    "stmixed",
    f"""SELECT d.symbol, d.strategy, d.regime_filter, d.stress_model, d.simulation, d.step, p."return" FROM stdraw d
    JOIN stmix m ON m.symbol = d.symbol AND m.strategy = d.strategy AND m.regime_filter = d.regime_filter AND floor(u1 * total) >= lo AND floor(u1 * total) < hi
    JOIN stpool p ON p.symbol = d.symbol AND p.strategy = d.strategy AND p.pool = m.pool AND p.ord = CAST(floor(u2 * m.n) AS BIGINT)
    WHERE d.stress_model = 'regime_mixture_gbm'""",
)
_SIZE = f"greatest(1, least({BLOCK}, n))"
view(
    "stboot",
    f"""SELECT d.symbol, d.strategy, d.regime_filter, d.stress_model, d.simulation, d.step, p."return" FROM (
    SELECT *, CAST(floor({draw('part', chr(39) + 's' + chr(39))} * (n - size + 1)) AS BIGINT) + (step - 1) % size AS ord FROM (
    SELECT *, (step - 1) // {_SIZE} AS part, {_SIZE} AS size FROM stgrid WHERE stress_model = 'block_bootstrap') x) d
    JOIN stpool p ON p.symbol = d.symbol AND p.strategy = d.strategy AND p.pool = d.regime_filter AND p.ord = d.ord""",
)
view("stpaths", "SELECT * FROM stgbm UNION ALL SELECT * FROM stmixed UNION ALL SELECT * FROM stboot")
view(
    "stwealth",
    f"""SELECT *, wealth / greatest(max(wealth) OVER (PARTITION BY {P} ORDER BY step ROWS UNBOUNDED PRECEDING), 1e-12) - 1 AS drawdown FROM (
    SELECT *, product(1 + "return") OVER (PARTITION BY {P} ORDER BY step ROWS UNBOUNDED PRECEDING) AS wealth FROM stpaths) t""",
)
view("stends", f"SELECT {P}, max_by(wealth, step) - 1 AS terminal, min(drawdown) AS max_drawdown, count(*) AS horizon FROM stwealth GROUP BY ALL")
view("stequity", f"""SELECT {P}, step, "return", 100000 * wealth AS equity FROM stwealth""")
view("steq", f"""SELECT {P}, step, "return", 100000 * wealth AS equity FROM stwealth WHERE simulation < 5""")
_E = "(100000 * (1 + terminal))"
view(
    "stsum",
    f"""SELECT {SC}, count(*) AS simulations, max(horizon) AS horizon, avg(terminal) AS terminal_mean, stddev_pop(terminal) AS terminal_std,
    quantile_cont(terminal, 0.05) AS terminal_p5, quantile_cont(terminal, 0.5) AS terminal_p50, quantile_cont(terminal, 0.95) AS terminal_p95,
    avg(terminal) FILTER (terminal <= v) AS terminal_cvar_95, quantile_cont({_E}, 0.05) AS terminal_equity_p5, quantile_cont({_E}, 0.5) AS terminal_equity_p50,
    quantile_cont({_E}, 0.95) AS terminal_equity_p95, quantile_cont(max_drawdown, 0.5) AS max_drawdown_p50, quantile_cont(max_drawdown, 0.05) AS max_drawdown_p95,
    avg(CASE WHEN terminal < 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS probability_of_loss,
    avg(CASE WHEN max_drawdown <= -0.2 THEN 1.0 ELSE 0.0 END::DOUBLE) AS prob_drawdown_exceed,
    avg(CASE WHEN {_E} <= 50000 THEN 1.0 ELSE 0.0 END::DOUBLE) AS risk_of_ruin
    FROM (SELECT *, quantile_cont(terminal, 0.05) OVER (PARTITION BY {SC}) AS v FROM stends) t GROUP BY ALL""",
)
SUM_FLOATS = [
    "terminal_mean", "terminal_std", "terminal_p5", "terminal_p50", "terminal_p95", "terminal_cvar_95", "terminal_equity_p5", "terminal_equity_p50",
    "terminal_equity_p95", "max_drawdown_p50", "max_drawdown_p95", "probability_of_loss", "prob_drawdown_exceed", "risk_of_ruin",
]
EQUITY = [c for c in SUM_FLOATS if "equity" in c]
RATIOS = [c for c in SUM_FLOATS if c not in EQUITY]
SUM_SQL = rnds(*RATIOS, digits=9) + ", " + rnds(*EQUITY, digits=4)
SUM_DIGITS = {c: 4 for c in EQUITY}


@shared
def stress_regimes(spark, sf):
    return st.dated_regimes(tr.rule_returns(spark, sf), tr.labelled(spark, sf))


def stress_inputs(spark, sf):
    return tr.rule_returns(spark, sf), stress_regimes(spark, sf)


def stress_paths(spark, sf, models=tuple(st.STRESS_MODELS), made=st.simulated_paths):
    returns, regimes = stress_inputs(spark, sf)
    pools = staged(st.return_pools(returns, regimes))
    return made(pools, st.regime_filters(regimes, REQUEST), SIMS, HORIZON, BLOCK, SEED, models, uniform)


@shared
def stress(spark, sf):
    returns = tr.rule_returns(spark, sf)
    return st.run_stress(
        returns, tr.labelled(spark, sf), REQUEST, keep_paths=5, simulations=SIMS, horizon=HORIZON, block=BLOCK, seed=SEED, uniform=uniform
    )


@shared
def saved(spark, sf):
    return stress(spark, sf).paths


@shared
def all_equity(spark, sf):
    return stress(spark, sf).equity


@shared
def saved_summary(spark, sf):
    return stress(spark, sf).summary


@check("j7_dated_regimes", "SELECT symbol, date, regime_name FROM streg")
def _(spark, sf):
    return stress_inputs(spark, sf)[1].select("symbol", "date", "regime_name")


@check("u3_regime_filters", "SELECT * FROM stfilt")
def _(spark, sf):
    return st.regime_filters(stress_inputs(spark, sf)[1], REQUEST)


@check("p4_return_pools", f"SELECT symbol, strategy, pool, ord, {rnd(chr(34) + 'return' + chr(34))} AS \"return\" FROM stpool")
def _(spark, sf):
    return rounded(st.return_pools(*stress_inputs(spark, sf)))


@check("j14_scenario_grid", f"SELECT {P}, step, n, {rnds('mean', 'deviation')} FROM stgrid")
def _(spark, sf):
    returns, regimes = stress_inputs(spark, sf)
    pools = staged(st.return_pools(returns, regimes))
    paths = st.grid(st.scenarios(pools, st.regime_filters(regimes, REQUEST), st.STRESS_MODELS), SIMS)
    cells = paths.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
    return rounded(cells.select(*st.PATH, "step", "n", "mean", "deviation"))


for _name, _model, _view in (
    ("p1_normal_paths", "gbm", "stgbm"), ("p2_regime_mixture_paths", "regime_mixture_gbm", "stmixed"), ("p3_block_bootstrap_paths", "block_bootstrap", "stboot"),
):
    @check(_name, f"SELECT {P}, step, {rnd(chr(34) + 'return' + chr(34))} AS \"return\" FROM {_view}")
    def _(spark, sf, model=_model):
        return rounded(stress_paths(spark, sf, [model], st.simulated_returns))


@check("p5_saved_paths", f"SELECT {P}, step, {rnd('equity', 5)} AS equity FROM steq")
def _(spark, sf):
    return rounded(stress(spark, sf).paths.drop("return"), 5)


@check("p6_stress_suite", f"SELECT {SC}, simulations, horizon, {SUM_SQL} FROM stsum")
def _(spark, sf):
    return rounded(stress(spark, sf).summary, 9, **SUM_DIGITS)


@check("a16_stress_summary", f"SELECT {SC}, simulations, {SUM_SQL} FROM stsum")
def _(spark, sf):
    ends = staged(st.path_ends(stress_paths(spark, sf)))
    return rounded(st.summary(ends).drop("horizon"), 9, **SUM_DIGITS)


@check("t2_first_paths", f"SELECT {P}, step, {rnd('equity', 5)} AS equity FROM steq WHERE simulation < 3")
def _(spark, sf):
    return rounded(rp.first_paths(saved(spark, sf), 3).drop("return"), 5)


@check("f9_path_scope", f"SELECT {P}, step, {rnd('equity', 5)} AS equity FROM steq WHERE strategy = '{ST[0]}' AND regime_filter = 'all' AND stress_model IN ('gbm', 'block_bootstrap')")
def _(spark, sf):
    return rounded(rp.scoped_paths(saved(spark, sf), [ST[0]], ["all"], ["gbm", "block_bootstrap"]).drop("return"), 5)


@check("f13_focus_row", f"SELECT {SC}, simulations, horizon, {SUM_SQL} FROM stsum WHERE strategy = '{ST[1]}' AND regime_filter = 'all' AND stress_model = 'gbm'")
def _(spark, sf):
    return rounded(rp.focus(saved_summary(spark, sf), ST[1], "all", "gbm"), 9, **SUM_DIGITS)


view(
    "stterm",
    f"""SELECT {P}, max_by(equity, step) AS terminal_equity, max_by(equity, step) / 100000 - 1 AS terminal_return, min(equity / peak) - 1 AS max_drawdown FROM (
    SELECT *, max(equity) OVER (PARTITION BY {P} ORDER BY step ROWS UNBOUNDED PRECEDING) AS peak FROM stequity) t GROUP BY ALL""",
)


# The bands are of the operator's whole job. Its 175 million cells don't fit the materialized views above, so scenarios have
# numbers here, a model's paths are lists, multiplied up in the order of their steps, and so are the values of a step.
BAND_SIMS, BAND_HORIZON, BAND_BLOCK = 500, 390, 30
view(
    "whole_scen",
    """SELECT CAST(row_number() OVER (ORDER BY f.symbol, s.strategy, f.regime_filter, stress_model) AS INTEGER) AS scenario, f.symbol, s.strategy, f.regime_filter,
    stress_model, n, mean, deviation FROM stfilt f JOIN ststat s ON s.symbol = f.symbol AND s.pool = f.regime_filter,
    (VALUES ('gbm'), ('regime_mixture_gbm'), ('block_bootstrap')) m(stress_model)""",
)
view("whole_paths", f"SELECT *, CAST(unnest(range({BAND_SIMS})) AS INTEGER) AS simulation FROM whole_scen")


def whole_grid(model: str) -> str:
    return f"(SELECT p.*, CAST(step AS INTEGER) AS step FROM whole_paths p, range(1, {BAND_HORIZON + 1}) b(step) WHERE stress_model = '{model}')"


_TWO = f"{draw('step', chr(39) + 'a' + chr(39))} AS u1, {draw('step', chr(39) + 'b' + chr(39))} AS u2"
_WHOLE_SIZE = f"greatest(1, least({BAND_BLOCK}, n))"
WHOLE = {
    "whole_gbm": f"""SELECT scenario, simulation, step, mean + deviation * sqrt(-2 * ln(1 - u1)) * cos(2 * pi() * u2) AS "return"
    FROM (SELECT *, {_TWO} FROM {whole_grid('gbm')} g) d""",
    "whole_mixed": f"""SELECT scenario, simulation, step, p."return" FROM (SELECT d.*, m.pool, CAST(floor(u2 * m.n) AS BIGINT) AS ord
    FROM (SELECT *, {_TWO} FROM {whole_grid('regime_mixture_gbm')} g) d
    JOIN stmix m ON m.symbol = d.symbol AND m.strategy = d.strategy AND m.regime_filter = d.regime_filter AND floor(u1 * total) >= lo AND floor(u1 * total) < hi) d
    LEFT JOIN stpool p ON p.symbol = d.symbol AND p.strategy = d.strategy AND p.pool = d.pool AND p.ord = d.ord""",
    "whole_boot": f"""SELECT scenario, simulation, step, p."return" FROM (
    SELECT *, CAST(floor({draw('part', chr(39) + 's' + chr(39))} * (n - size + 1)) AS BIGINT) + (step - 1) % size AS ord FROM (
    SELECT *, (step - 1) // {_WHOLE_SIZE} AS part, {_WHOLE_SIZE} AS size FROM {whole_grid('block_bootstrap')} g) x) d
    LEFT JOIN stpool p ON p.symbol = d.symbol AND p.strategy = d.strategy AND p.pool = d.regime_filter AND p.ord = d.ord""",
}
for _name, _cells in WHOLE.items():
    view(
        _name,
        f"""SELECT scenario, step, list_aggregate(listed, 'quantile_cont', [0.05, 0.25, 0.5, 0.75, 0.95]) AS b, list_aggregate(listed, 'favg') AS average FROM (
    SELECT scenario, step, list(100000 * list_aggregate(factors[1:step], 'product')) AS listed FROM (
    SELECT scenario, simulation, list(1 + "return" ORDER BY step) AS factors FROM ({_cells}) t GROUP BY ALL) w, range(1, {BAND_HORIZON + 1}) b(step)
    GROUP BY ALL) l""",
    )
_WHOLE_BANDS = ", ".join(f"{rnd(f'b[{i}]', 5)} AS {n}" for i, n in enumerate(rp.BANDS, 1))


@check(
    "a21_path_bands",
    f"""SELECT {SC}, CAST(step AS INTEGER) AS step, {_WHOLE_BANDS}, {rnd('average', 5)} AS mean FROM (SELECT scenario, {SC} FROM whole_scen) s
    JOIN ({' UNION ALL '.join(f'SELECT * FROM {n}' for n in WHOLE)}) z USING (scenario)""",
)
def _(spark, sf):
    returns, labels = tr.rule_returns(spark, sf), tr.labelled(spark, sf)
    run = st.run_stress(returns, labels, REQUEST, simulations=BAND_SIMS, horizon=BAND_HORIZON, block=BAND_BLOCK, seed=SEED, uniform=uniform)
    bands = rp.path_bands(run.pieces, st.SCENARIO)
    # Rounded by way of whole numbers, as DuckDB does: among two million values there are some for which decimal rounding gives the other neighbour.
    return bands.select(*st.SCENARIO, "step", *[(F.round(F.col(c) * 1e5) / 1e5 + F.lit(0.0)).alias(c) for c in (*rp.BANDS, "mean")])


@check("a22_terminal_frame", f"SELECT {P}, {q(['terminal_equity', 'terminal_return', 'max_drawdown'])} FROM stterm")
def _(spark, sf):
    return rounded(rp.terminal_frame(all_equity(spark, sf)), 6)


@check(
    "a23_ending_balances",
    f"""SELECT {SC}, {rnd('avg(terminal_equity)', 5)} AS average_equity, {rnd('quantile_cont(terminal_equity, 0.5)', 5)} AS median_equity,
    {rnd('min(terminal_equity)', 5)} AS min_equity, {rnd('max(terminal_equity)', 5)} AS max_equity FROM stterm GROUP BY {SC}""",
)
def _(spark, sf):
    return rounded(rp.ending_balances(rp.terminal_frame(all_equity(spark, sf)), st.SCENARIO), 5)


@check(
    "a24_terminal_histogram",
    f"""SELECT symbol, strategy, CAST(bin AS BIGINT) AS bin, count(*) AS paths, {rnd('min(lo)', 6)} AS low, {rnd('max(hi)', 6)} AS high FROM (
    SELECT *, least(coalesce(floor((terminal_return - lo) / nullif(hi - lo, 0) * 40), 0), 39) AS bin FROM (
    SELECT *, min(terminal_return) OVER (PARTITION BY symbol, strategy) AS lo, max(terminal_return) OVER (PARTITION BY symbol, strategy) AS hi FROM stterm) a) b GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(rp.histogram(staged(rp.terminal_frame(all_equity(spark, sf))), "terminal_return", ["symbol", "strategy"]), 6)


@check(
    "a24_distribution_marks",
    f"SELECT {SC}, " + ", ".join(f"{rnd(f'quantile_cont(max_drawdown, {p})', 6)} AS p{n}" for p, n in ((0.05, "05"), (0.5, "50"), (0.95, "95"))) + f" FROM stterm GROUP BY {SC}",
)
def _(spark, sf):
    return rounded(rp.distribution_marks(rp.terminal_frame(all_equity(spark, sf)), "max_drawdown", st.SCENARIO), 6)


@check("a26_mean_loss_probability", f"SELECT symbol, {rnd('avg(probability_of_loss)', 6)} AS probability_of_loss FROM stsum GROUP BY 1")
def _(spark, sf):
    return rounded(rp.mean_loss_probability(saved_summary(spark, sf)), 6)


@check("a27_average_paths", f"SELECT {SC}, step, {rnd('avg(equity)', 5)} AS average, {rnd('quantile_cont(equity, 0.5)', 5)} AS median FROM stequity GROUP BY {SC}, step")
def _(spark, sf):
    return rounded(rp.average_paths(all_equity(spark, sf), st.SCENARIO), 5)


_T5 = rnds("terminal_equity_p50", "terminal_equity_p95", digits=4) + ", " + rnds("max_drawdown_p95", "probability_of_loss", "risk_of_ruin", digits=9)


@check("t5_scenario_table", f"SELECT {SC}, simulations, horizon, {_T5} FROM stsum ORDER BY stsum.probability_of_loss, stsum.risk_of_ruin")
def _(spark, sf):
    return rounded(rp.scenario_table(saved_summary(spark, sf)), 9, **SUM_DIGITS)
