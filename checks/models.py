"""Fitted models: clustering, hidden Markov models, classifiers, tournaments.

Logistic fits have a SQL twin, trees have twins for their shape and first cut; of other fits, what is applied after them is
compared on given parameters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.operators import classify, hmm, kmeans
from barlight.operators import features as fx
from barlight.operators import regimes as rg
from barlight.operators import signals as sg
from barlight.operators import tournament as tm
from barlight.operators import walkforward as wf
from checks import evaluation as ev
from checks import trading as tr
from checks.registry import check, rnd, rounded, shared, view
from checks.views import indexed

DIMS = len(tr.COLS)
AXES = (tr.COLS.index("vol_axis"), tr.COLS.index("structure_axis"))
FAST = dict(starts=2, stability_window=200)

view(
    "split15",
    f"""SELECT symbol, idx, date, target, CASE WHEN idx < floor(n * 0.6::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM e6
    JOIN counts15 USING (symbol) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in fx.CLASSIFIER_COLUMNS)}""",
)
view(
    "given_up",
    "SELECT symbol, idx, date, 1 / (1 + exp(-(ret_1 * 12 - ret_20 * 6 + (rsi - 50) * 0.02::DOUBLE))) AS up FROM e6 JOIN split15 USING (symbol, idx, date) WHERE part = 'test'",
)


@shared
def points(spark, sf):
    return tr.scaled(spark, sf).withColumn("candidate", F.lit(fx.MINUTE))


@shared
def split(spark, sf):
    return classify.split_rows(indexed(spark, sf))


@check("m12_classifier_split", "SELECT symbol, idx, date, target, part FROM split15")
def _(spark, sf):
    return split(spark, sf).select("symbol", "idx", "date", "target", "part")


@check(
    "m12_fittable_symbols",
    """SELECT symbol, count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'test') AS test_rows,
    count(*) FILTER (part = 'train' AND target = 1) AS ups FROM split15 GROUP BY 1 HAVING train_rows >= 200 AND test_rows >= 10 AND ups > 0 AND ups < train_rows""",
)
def _(spark, sf):
    return classify.fittable(split(spark, sf))


@check("m16_signal_from_probability", f"SELECT symbol, idx, {rnd('CASE WHEN up > 0.55 THEN 1.0 WHEN up < 0.45 THEN -1.0 ELSE 0.0 END::DOUBLE')} AS signal FROM given_up")
def _(spark, sf):
    test = split(spark, sf).where("part = 'test'")
    up = 1 / (1 + F.exp(-(F.col("ret_1") * 12 - F.col("ret_20") * 6 + (F.col("rsi") - 50) * 0.02)))
    return rounded(test.select("symbol", "idx", classify.signal_from(up).alias("signal")))


@shared
def classified(spark, sf):
    rows = split(spark, sf)
    return classify.with_points(rows, classify.fittable(rows))


def _learned(name: str):
    def run(spark, sf):
        return classify.probabilities(classified(spark, sf), [name]).select("symbol", "idx", "date", "up")

    return run


check("m13_random_forest")(_learned("ml_rf"))
check("m15_gradient_boosting")(_learned("ml_gbrt"))

_INPUTS = list(fx.CLASSIFIER_COLUMNS)
view("fit15", f"SELECT e6.symbol, e6.idx, e6.date, e6.target, part, {', '.join(f'e6.{c}' for c in _INPUTS)} FROM e6 JOIN split15 USING (symbol, idx, date)")
view(
    "able15",
    """SELECT symbol, count(*) FILTER (part = 'train') AS n, count(*) FILTER (part = 'test') AS tests, count(*) FILTER (part = 'train' AND target = 1) AS ups FROM fit15 GROUP BY 1
    HAVING n >= 200 AND tests >= 10 AND ups > 0 AND ups < n""",
)
view(
    "moments15",
    f"SELECT symbol, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _INPUTS)} FROM fit15 WHERE part = 'train' GROUP BY 1",
)
view(
    "inputs15",
    f"""SELECT symbol, idx, date, part, target AS y, n / (2.0::DOUBLE * CASE WHEN target = 1 THEN ups ELSE n - ups END) AS w,
    [{', '.join(f'({c} - m_{c}) / CASE WHEN s_{c} > 1e-12 THEN s_{c} ELSE 1 END' for c in _INPUTS)}, 1.0::DOUBLE] AS x FROM fit15 JOIN able15 USING (symbol) JOIN moments15 USING (symbol)""",
)


def _logistic_sql() -> str:
    """Accelerated gradient steps, all symbols in one recursion, from 0 to the optimum."""
    k = len(_INPUTS) + 1
    gradient = ", ".join(f"sum(w * (p - y) * x[{j + 1}]){f' + any_value(ahead[{j + 1}])' if j < k - 1 else ''}" for j in range(k))
    return f"""RECURSIVE_MARK steps AS (
    SELECT symbol, 0 AS i, list_transform(range({k}), lambda j: 0.0::DOUBLE) AS b, list_transform(range({k}), lambda j: 0.0::DOUBLE) AS before, 1 + 0.25::DOUBLE * sum(w * list_dot_product(x, x)) AS lip FROM inputs15 WHERE part = 'train' GROUP BY symbol
    UNION ALL
    SELECT symbol, i + 1, list_transform(range({k}), lambda j: ahead[j + 1] - g[j + 1] / lip), b, lip FROM (
        SELECT symbol, any_value(i) AS i, any_value(b) AS b, any_value(lip) AS lip, any_value(ahead) AS ahead, [{gradient}] AS g FROM (
            SELECT a.*, w, x, y, 1 / (1 + exp(-list_dot_product(x, ahead))) AS p FROM (
                SELECT *, list_transform(range({k}), lambda j: b[j + 1] + 0.9::DOUBLE * (b[j + 1] - before[j + 1])) AS ahead FROM steps WHERE i < 1500) a
            JOIN (SELECT * FROM inputs15 WHERE part = 'train') t USING (symbol)) r GROUP BY symbol) q)"""


view("betas15", f"SELECT * FROM (WITH {_logistic_sql().replace('RECURSIVE_MARK', 'RECURSIVE')} SELECT symbol, b FROM steps WHERE i = 1500) z")


@check("m14_logistic_regression", f"SELECT symbol, idx, date, {rnd('1 / (1 + exp(-list_dot_product(x, b)))', 4)} AS up FROM inputs15 JOIN betas15 USING (symbol) WHERE part = 'test'")
def _(spark, sf):
    return rounded(_learned("ml_logreg")(spark, sf), 4)


@check("m14_gradient_at_the_optimum", f"SELECT symbol, input, 0.0::DOUBLE AS gradient FROM able15, (VALUES {', '.join(f'({c!r})' for c in [*_INPUTS, 'intercept'])}) t(input)")
def _(spark, sf):
    rows = classified(spark, sf).where("part = 'train'").join(classify.fit_logistic(classified(spark, sf)), "symbol")
    names = [*_INPUTS, "intercept"]
    x = F.concat("scaled", F.array(F.lit(1.0)))
    pull = F.col("weight") * (1 / (1 + F.exp(-F.aggregate(F.zip_with(x, "beta", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v))) - F.col("label"))
    sums = rows.groupBy("symbol").agg(F.array(*[F.sum(pull * x[j]) + (F.first("beta")[j] if j < len(_INPUTS) else 0.0) for j in range(len(names))]).alias("g"))
    return rounded(sums.select("symbol", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), "g")).alias("input", "gradient")), 5)


@check("g5_logistic_signals", f"SELECT symbol, idx, {rnd('CASE WHEN up > 0.55 THEN 1.0 WHEN up < 0.45 THEN -1.0 ELSE 0.0 END::DOUBLE')} AS ml_logreg FROM (SELECT symbol, idx, 1 / (1 + exp(-list_dot_product(x, b))) AS up FROM inputs15 JOIN betas15 USING (symbol) WHERE part = 'test') t")
def _(spark, sf):
    made = classify.learned_signals(indexed(spark, sf), ["ml_logreg"])
    tested = classified(spark, sf).where("part = 'test'").select("symbol", "idx")
    return rounded(made.join(tested, ["symbol", "idx"]).select("symbol", "idx", "ml_logreg"))


@shared
def grown(spark, sf):
    return classify.trees.fit(classified(spark, sf).where("part = 'train'"), ["ml_rf", "ml_gbrt"], classify.SEED)


@check(
    "m13_forest_shape",
    "SELECT symbol, 80::BIGINT AS trees, 63::BIGINT AS inner_nodes_at_most, true AS leaves_have_50_rows, true AS bags_fit, true AS values_are_shares FROM able15",
)
def _(spark, sf):
    train = classified(spark, sf).where("part = 'train'").groupBy("symbol").agg(F.count("*").alias("n"))
    made = grown(spark, sf).where("model = 'ml_rf'").withColumn("size", F.aggregate("rows", F.lit(0).cast("long"), lambda t, v: t + v))
    inner = F.size(F.filter("feature", lambda f: f >= 0))
    return made.join(train, "symbol").groupBy("symbol").agg(
        F.count_distinct("tree").alias("trees"),
        F.greatest(F.max(inner).cast("long"), F.lit(63).cast("long")).alias("inner_nodes_at_most"),
        F.bool_and(F.forall("rows", lambda r: (r == 0) | (r >= 50))).alias("leaves_have_50_rows"),
        # A draw with repeats holds some 63 % of the rows.
        F.bool_and(F.col("size").between(0.55 * F.col("n"), 0.72 * F.col("n"))).alias("bags_fit"),
        F.bool_and(F.forall("value", lambda v: v.between(0, 1))).alias("values_are_shares"),
    )


@check("m15_boosting_shape", f"SELECT symbol, 80::BIGINT AS trees, {rnd('ln(ups / (n - ups)::DOUBLE)')} AS base, n * 80 AS rows_in_leaves, tests AS scored FROM able15")
def _(spark, sf):
    made = grown(spark, sf).where("model = 'ml_gbrt'")
    size = F.aggregate("rows", F.lit(0).cast("long"), lambda t, v: t + v)
    shape = made.groupBy("symbol").agg(
        F.count_if(F.col("tree") >= 0).alias("trees"), F.max(F.when(F.col("tree") < 0, F.col("value")[0])).alias("base"), F.sum(F.when(F.col("tree") >= 0, size)).alias("rows_in_leaves")
    )
    points = classified(spark, sf)
    scored = classify.trees.scored(points.where("part = 'test'"), made).where(F.col("up").between(0, 1)).groupBy("symbol").agg(F.count("*").alias("scored"))
    return rounded(shape.join(scored, "symbol"))


view(
    "levels15",
    f"""SELECT symbol, input, v, sum(t) AS t, count(*) AS c FROM (SELECT symbol, y - ups / n::DOUBLE AS t, unnest(range({len(_INPUTS)})) AS input, unnest([{', '.join(_INPUTS)}]) AS v
    FROM (SELECT symbol, target AS y, {', '.join(_INPUTS)} FROM fit15 WHERE part = 'train') f JOIN able15 USING (symbol)) r GROUP BY ALL""",
)
view(
    "cuts15",
    """SELECT symbol, input, v, lead(v) OVER w AS following, sum(t) OVER w AS s, sum(c) OVER w AS c, sum(t) OVER p AS ts, sum(c) OVER p AS tc FROM levels15
    WINDOW w AS (PARTITION BY symbol, input ORDER BY v), p AS (PARTITION BY symbol, input)""",
)


@check(
    "m15_first_cut",
    f"""SELECT symbol, input::INTEGER AS input, {rnd('threshold')} AS threshold, c::BIGINT AS rows_below FROM (
    SELECT symbol, input, (v + following) / 2 AS threshold, c, row_number() OVER (PARTITION BY symbol ORDER BY s * s / c + (ts - s) * (ts - s) / (tc - c) DESC, input, v) AS r FROM cuts15 WHERE following IS NOT NULL) z WHERE r = 1""",
)
def _(spark, sf):
    made = grown(spark, sf).where("model = 'ml_gbrt' AND tree = 0")
    below = F.col("rows")[1] + F.col("rows")[3] + F.col("rows")[4]
    return rounded(made.select("symbol", F.col("feature")[0].alias("input"), F.col("threshold")[0].alias("threshold"), below.alias("rows_below")))


@check("g5_learned_signals")
def _(spark, sf):
    base = indexed(spark, sf)
    learned = classify.learned_signals(base, classify.LEARNED)
    return sg.strategy_signals(base, tr.labelled(spark, sf), learned, list(classify.LEARNED)).drop("close")


@check("m3_kmeans_fit")
def _(spark, sf):
    made = kmeans.fit(points(spark, sf), ["symbol"], DIMS, AXES, starts=3)
    return made.select("symbol", F.round("inertia", 6).alias("inertia"), F.col("centers").cast("string").alias("centers"))


def _moved(dims: int) -> str:
    """Lloyd steps of all symbols in one recursion, from the means of the quadrants of the two axes."""
    v, k = AXES
    side = f"CASE WHEN z{v} > 0 THEN 2 ELSE 0 END + CASE WHEN z{k} > 0 THEN 1 ELSE 0 END"

    def mean(q: int, j: int) -> str:
        corner = (1 if q >= 2 else -1) if j == v else (1 if q % 2 else -1) if j == k else 0
        return f"coalesce(avg(z{j}) FILTER (side = {q}), {corner}::DOUBLE)"

    first = ", ".join("[" + ", ".join(mean(q, j) for j in range(dims)) + "]" for q in range(rg.STATES))
    after = ", ".join("[" + ", ".join(f"coalesce(avg(z{j}) FILTER (raw = {q}), any_value(c[{q + 1}][{j + 1}]))" for j in range(dims)) + "]" for q in range(rg.STATES))
    gaps = ", ".join("(" + " + ".join(f"(z{j} - c[{q + 1}][{j + 1}]) * (z{j} - c[{q + 1}][{j + 1}])" for j in range(dims)) + ")" for q in range(rg.STATES))
    return f"""WITH RECURSIVE lloyd AS (SELECT symbol, 0 AS i, [{first}] AS c FROM (SELECT *, {side} AS side FROM z15) t GROUP BY symbol
    UNION ALL SELECT symbol, any_value(i) + 1, [{after}] FROM (SELECT *, list_position(d, list_min(d)) - 1 AS raw FROM (
    SELECT lloyd.symbol, i, c, [{gaps}] AS d, {', '.join(f'z{j}' for j in range(dims))} FROM lloyd JOIN z15 USING (symbol) WHERE i < 100) e) f GROUP BY symbol)
    SELECT symbol, c FROM lloyd WHERE i = 100"""


view("lloyd15", f"SELECT * FROM ({_moved(DIMS)}) t")


@check(
    "m3_lloyd_fixed_point",
    f"SELECT symbol, CAST(k AS INTEGER) AS cluster, {', '.join(f'{rnd(f'c[k + 1][{j + 1}]', 7)} AS z{j}' for j in range(DIMS))} FROM lloyd15, range({rg.STATES}) t(k)",
)
def _(spark, sf):
    made = kmeans.fit(points(spark, sf), ["symbol"], DIMS, AXES, starts=1, tolerance=1e-12)
    rows = made.select("symbol", F.posexplode("centers").alias("cluster", "c"))
    return rounded(rows.select("symbol", "cluster", *[F.col("c")[j].alias(f"z{j}") for j in range(DIMS)]), 7)


# Given parameters for what hidden Markov models do after a fit.
START = [0.4, 0.3, 0.2, 0.1]
MOVES = [[0.85 if i == j else 0.02 + 0.03 * ((i + 2 * j) % 3) for j in range(rg.STATES)] for i in range(rg.STATES)]
MOVES = [[x / sum(row) for x in row] for row in MOVES]
SPREADS = [[0.6 + 0.2 * k + 0.05 * j for j in range(DIMS)] for k in range(rg.STATES)]
K = range(rg.STATES)


def given_hmm(spark, sf):
    def flat(rows):
        return F.array(*[F.lit(float(x)) for row in rows for x in row])

    return points(spark, sf).select("symbol").distinct().select("symbol", flat([START]).alias("start"), flat(MOVES).alias("moves"), flat(tr.CENTERS).alias("means"), flat(SPREADS).alias("spreads"))


_LOGS = [" + ".join(f"(z{j} - ({m!r}::DOUBLE)) * (z{j} - ({m!r}::DOUBLE)) / {s!r}::DOUBLE + ln(2 * pi() * {s!r}::DOUBLE)" for j, (m, s) in enumerate(zip(map(float, tr.CENTERS[k]), SPREADS[k], strict=True))) for k in K]
view("logs15", f"SELECT symbol, pos, {', '.join(f'-0.5::DOUBLE * ({x}) AS l{k}' for k, x in enumerate(_LOGS))} FROM z15")
view("dens15", f"SELECT *, {', '.join(f'exp(l{k} - top) AS d{k}' for k in K)} FROM (SELECT *, greatest(l0, l1, l2, l3) AS top, max(pos) OVER (PARTITION BY symbol) AS final FROM logs15) t")


def _mix(name: str, to: int) -> str:
    return "(" + " + ".join(f"{name}{j} * {MOVES[j][to]!r}::DOUBLE" for j in K) + ")"


view(
    "ahead15",
    f"""SELECT * FROM (WITH RECURSIVE ahead AS (SELECT symbol, pos, {', '.join(f'b{k} / b AS a{k}' for k in K)}, ln(b) + top AS ll FROM (SELECT *, b0 + b1 + b2 + b3 AS b FROM (
    SELECT symbol, pos, top, {', '.join(f'{START[k]!r}::DOUBLE * d{k} AS b{k}' for k in K)} FROM dens15 WHERE pos = 0) x) y
    UNION ALL SELECT symbol, pos, {', '.join(f'b{k} / b AS a{k}' for k in K)}, ll + ln(b) + top FROM (SELECT *, b0 + b1 + b2 + b3 AS b FROM (
    SELECT d.symbol, d.pos, d.top, ll, {', '.join(f'{_mix("a", k)} * d{k} AS b{k}' for k in K)} FROM ahead JOIN dens15 d ON d.symbol = ahead.symbol AND d.pos = ahead.pos + 1) x) y)
    SELECT * FROM ahead) z""",
)
_BACK = ["(" + " + ".join(f"{MOVES[k][j]!r}::DOUBLE * behind.d{j} * g{j}" for j in K) + ")" for k in K]
view(
    "behind15",
    f"""SELECT * FROM (WITH RECURSIVE behind AS (SELECT symbol, pos, {', '.join(f'1.0::DOUBLE AS g{k}' for k in K)}, {', '.join(f'd{k}' for k in K)} FROM dens15 WHERE pos = final
    UNION ALL SELECT symbol, pos, {', '.join(f'h{k} / (h0 + h1 + h2 + h3) AS g{k}' for k in K)}, {', '.join(f'e{k}' for k in K)} FROM (
    SELECT p.symbol, p.pos, {', '.join(f'{_BACK[k]} AS h{k}' for k in K)}, {', '.join(f'p.d{k} AS e{k}' for k in K)} FROM behind JOIN dens15 p ON p.symbol = behind.symbol AND p.pos = behind.pos - 1) x)
    SELECT symbol, pos, {', '.join(f'g{k}' for k in K)} FROM behind) z""",
)
_LOG_MOVES = [[f"ln({MOVES[j][k]!r}::DOUBLE)" for k in K] for j in K]
view(
    "scores15",
    f"""SELECT * FROM (WITH RECURSIVE best AS (SELECT symbol, pos, final, {', '.join(f'ln({START[k]!r}::DOUBLE) + l{k} AS s{k}' for k in K)}, {', '.join(f'0 AS c{k}' for k in K)} FROM dens15 WHERE pos = 0
    UNION ALL SELECT symbol, pos, final, {', '.join(f'list_max(o{k}) + l{k} AS s{k}' for k in K)}, {', '.join(f'list_position(o{k}, list_max(o{k})) - 1 AS c{k}' for k in K)} FROM (
    SELECT d.*, {', '.join(f'[{", ".join(f"s{j} + {_LOG_MOVES[j][k]}" for j in K)}] AS o{k}' for k in K)} FROM best JOIN dens15 d ON d.symbol = best.symbol AND d.pos = best.pos + 1) x)
    SELECT * FROM best) z""",
)
view(
    "route15",
    """SELECT * FROM (WITH RECURSIVE route AS (SELECT symbol, pos, list_position([s0, s1, s2, s3], greatest(s0, s1, s2, s3)) - 1 AS raw, [c0, c1, c2, c3] AS came FROM scores15 WHERE pos = final
    UNION ALL SELECT p.symbol, p.pos, came[raw + 1], [c0, c1, c2, c3] FROM route JOIN scores15 p ON p.symbol = route.symbol AND p.pos = route.pos - 1)
    SELECT symbol, pos, raw FROM route) z""",
)


@check("m6_posteriors_and_path", f"""SELECT symbol, pos, CAST(raw AS INTEGER) AS raw, {', '.join(f'{rnd(f"a{k} * g{k} / (a0 * g0 + a1 * g1 + a2 * g2 + a3 * g3)", 7)} AS state_{k}' for k in K)}
    FROM ahead15 JOIN behind15 USING (symbol, pos) JOIN route15 USING (symbol, pos)""")
def _(spark, sf):
    out = hmm.decode(points(spark, sf), given_hmm(spark, sf), ["symbol"], DIMS)
    return rounded(out.select("symbol", "pos", "raw", *[F.col("posterior")[k].alias(f"state_{k}") for k in K]), 7)


@check("m7_given_likelihood", f"SELECT symbol, {rnd('ll', 5)} AS log_likelihood, 'available_fit_success log_likelihood=' || format('{{:.2f}}', ll) AS hmm_status FROM ahead15 WHERE pos = (SELECT max(pos) FROM dens15 d WHERE d.symbol = ahead15.symbol)")
def _(spark, sf):
    return rounded(hmm.likelihoods(points(spark, sf), given_hmm(spark, sf), ["symbol"], DIMS), 5)


@shared
def fitted_hmm(spark, sf):
    centers = kmeans.fit(points(spark, sf), ["symbol"], DIMS, AXES, starts=1)
    return hmm.fit(points(spark, sf), centers, ["symbol"], DIMS, max_iter=10)


@check("m6_hmm_states")
def _(spark, sf):
    out = hmm.decode(points(spark, sf), fitted_hmm(spark, sf), ["symbol"], DIMS)
    return out.select("symbol", "idx", "raw", *[F.col("posterior")[k].alias(f"state_{k}") for k in range(rg.STATES)])


@check("m7_hmm_status")
def _(spark, sf):
    return hmm.likelihoods(points(spark, sf), fitted_hmm(spark, sf), ["symbol"], DIMS)


@shared
def detection(spark, sf):
    return tm.detect(indexed(spark, sf), **FAST)


@check("m9_production_tournament")
def _(spark, sf):
    return detection(spark, sf).labels


@check("m9_tournament_scores")
def _(spark, sf):
    scores = detection(spark, sf).scores
    return scores.select("symbol", "candidate", "score", "silhouette_score", "cluster_balance_score", "rank", "is_best")


@check("m10_dev_tournament")
def _(spark, sf):
    made = tm.detect_dev(indexed(spark, sf), candidates=[fx.MINUTE, fx.SCRIPTED], hmm_steps=5, **FAST)
    return made.scores.select("symbol", "model_id", "dev_score", "rank", "is_best")


@check("m11_named_model")
def _(spark, sf):
    return tm.materialise(indexed(spark, sf), fx.MINUTE, tm.HMM, hmm_steps=5, **FAST).labels


@shared
def walk_forward(spark, sf):
    return tm.detect_walk_forward(
        indexed(spark, sf), ev.PLAN, include_hmm=False, candidates=[fx.MINUTE, fx.SCRIPTED], **FAST
    )


@check("b4_walk_forward_detection")
def _(spark, sf):
    return walk_forward(spark, sf).labels


@check("b6_walk_forward_with_train_filter")
def _(spark, sf):
    base = indexed(spark, sf)
    made = walk_forward(spark, sf)
    learned = tm.train_labels(base, made, ev.PLAN, starts=2)
    signals = tr.rules(spark, sf).where(F.col("strategy").isin(ev.STRATS))
    return wf.evaluate(base, signals, made.labels, ev.PLAN, learned, filter_rows=200).ranking
