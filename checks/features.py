"""Rolling kit, feature families, resampling and the as-of join."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlight.functions import rolling, scalar
from barlight.operators import features as fx
from barlight.operators import ordered, resample
from barlight.operators.ordered import Blocks
from checks.registry import check, rnd, rnds, rounded, view
from checks.views import bars, indexed

ID = "symbol, idx, date"


def over(n: int | None = None, lead: str = "") -> str:
    frame = f" ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" if n else ""
    return f"OVER (PARTITION BY symbol ORDER BY date{frame}{lead})"


def gated(agg: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {least} THEN {agg.format(x)} {over(n)} END"


def std(x: str, n: int, least: int) -> str:
    return gated("stddev_pop({})", x, n, least)


def avg(x: str, n: int, least: int) -> str:
    return gated("avg({})", x, n, least)


def tot(x: str, n: int, least: int) -> str:
    return gated("sum({})", x, n, least)


def zsc(x: str, n: int, least: int) -> str:
    return f"(({x}) - ({avg(x, n, least)})) / nullif({std(x, n, least)}, 0)"


def rowmean(*xs: str) -> str:
    total = " + ".join(f"coalesce({x}, 0)" for x in xs)
    known = " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in xs)
    return f"({total}) / nullif({known}, 0)"


for m in (1, 15):
    view(
        f"ret{m}",
        f"""SELECT *, ln(close) - ln(lag(close) {over()}) AS r, (high - low) / nullif(close, 0) AS rng,
        close - lag(close) {over()} AS chg FROM idx{m}""",
    )

view(
    "e1",
    f"""SELECT *, {rowmean('rolling_vol_long', 'abs_return', 'range_pct')} AS vol_axis,
    {rowmean('abs(trend_strength)', 'abs(momentum)')} AS structure_axis FROM (SELECT {ID}, r AS log_return,
    {std('r', 30, 10)} AS rolling_vol_short, {std('r', 120, 30)} AS rolling_vol_long, {avg('abs(r)', 30, 10)} AS abs_return,
    abs({zsc('close', 120, 30)}) AS trend_strength, close / nullif(lag(close, 120) {over()}, 0) - 1 AS momentum, rng AS range_pct
    FROM ret15) t""",
)
view(
    "e2",
    f"""SELECT *, {rowmean('script_vol_slow', 'script_absret_mean', 'script_range_pct')} AS vol_axis,
    {rowmean('script_trend_strength', 'script_directional_persistence')} AS structure_axis FROM (SELECT {ID}, r AS log_return,
    {std('r', 60, 20)} AS script_vol_fast, {std('r', 240, 60)} AS script_vol_slow, {avg('abs(r)', 60, 20)} AS script_absret_mean,
    abs(close / nullif(lag(close, 240) {over()}, 0) - 1) AS script_trend_strength,
    abs({avg('CAST(sign(r) AS DOUBLE)', 60, 20)}) AS script_directional_persistence, rng AS script_range_pct FROM ret15) t""",
)
_GAIN = "CASE WHEN chg IS NOT NULL THEN greatest(chg, 0) END"
_LOSS = "CASE WHEN chg IS NOT NULL THEN greatest(-chg, 0) END"
RSI = f"100 - 100 / (1 + ({avg('gain', 14, 14)}) / nullif({avg('loss', 14, 14)}, 0))"
view("gains15", f"SELECT *, {_GAIN} AS gain, {_LOSS} AS loss FROM ret15")
view(
    "e6",
    f"""SELECT {ID}, r AS ret_1, {tot('r', 5, 3)} AS ret_5, {tot('r', 20, 10)} AS ret_20, {std('r', 20, 10)} AS vol_20,
    {std('r', 80, 20)} AS vol_80, rng AS range_pct, {RSI} AS rsi, {zsc('volume', 80, 20)} AS volume_z,
    CASE WHEN lead(close) {over()} / nullif(close, 0) - 1 > 0 THEN 1 ELSE 0 END AS target FROM gains15""",
)

LABEL = {
    "5min": "make_timestamp((epoch_us(date) + 300000000 - 1) // 300000000 * 300000000)",
    "1D": "make_timestamp((epoch_us(date) + 86400000000 - 1) // 86400000000 * 86400000000)",
    "W-FRI": "CAST(CAST(date AS DATE) + CAST((12 - isodow(date)) % 7 AS INTEGER) AS TIMESTAMP)",
}
for p, (rule, s, n) in fx.FRAMES.items():
    view(
        f"bins_{p}",
        f"""SELECT symbol, {LABEL[rule]} AS label, min_by(open, date) AS open, max(high) AS high, min(low) AS low,
        max_by(close, date) AS close, sum(volume) AS volume FROM bars1 GROUP BY 1, 2""",
    )
    raw = [std("r", s, max(2, s // 3)), std("r", n, max(3, n // 3)), tot("r", s, max(2, s // 3)), tot("r", n, max(3, n // 3)), "rng"]
    names = [f"{p}_{c}" for c in ("vol_short", "vol_long", "trend_short", "trend_long", "range_pct")]
    view(
        f"tf_{p}",
        "SELECT symbol, date, " + ", ".join(f"lag({c}) {over()} AS {c}" for c in names)
        + " FROM (SELECT symbol, date, " + ", ".join(f"{x} AS {c}" for x, c in zip(raw, names))
        + f" FROM (SELECT *, ln(close) - ln(lag(close) {over()}) AS r, (high - low) / nullif(close, 0) AS rng"
        f" FROM (SELECT * RENAME (label AS date) FROM bins_{p}) a) b) c",
    )
_ALL = [f"{p}_{c}" for p in fx.FRAMES for c in ("vol_short", "vol_long", "trend_short", "trend_long", "range_pct")]
_VOL = [c for c in _ALL if c.endswith(("vol_short", "vol_long", "range_pct"))]
_TREND = [c for c in _ALL if "trend_" in c]
view(
    "e4",
    f"SELECT *, {rowmean(*_VOL)} AS vol_axis, {rowmean(*[f'abs({c})' for c in _TREND])} AS structure_axis FROM (SELECT b.symbol, b.idx, b.date, "
    + ", ".join(_ALL)
    + " FROM idx1 b "
    + " ".join(f"ASOF LEFT JOIN tf_{p} {p} ON {p}.symbol = b.symbol AND {p}.date <= b.date" for p in fx.FRAMES)
    + ") t",
)
view(
    "e1m",
    f"""SELECT *, {rowmean('rolling_vol_long', 'abs_return', 'range_pct')} AS vol_axis,
    {rowmean('abs(trend_strength)', 'abs(momentum)')} AS structure_axis FROM (SELECT {ID}, r AS log_return,
    {std('r', 30, 10)} AS rolling_vol_short, {std('r', 120, 30)} AS rolling_vol_long, {avg('abs(r)', 30, 10)} AS abs_return,
    abs({zsc('close', 120, 30)}) AS trend_strength, close / nullif(lag(close, 120) {over()}, 0) - 1 AS momentum, rng AS range_pct
    FROM ret1) t""",
)
_HVOL = ["rolling_vol_short", "rolling_vol_long", "range_pct", "a.vol_axis"] + _VOL
_HTREND = ["abs(trend_strength)", "abs(momentum)"] + [f"abs({c})" for c in _TREND]
view(
    "e5",
    f"""SELECT a.symbol, a.idx, a.date, log_return, {', '.join(fx.MINUTE_COLUMNS)}, {', '.join(_ALL)}, {rowmean(*_HVOL)} AS vol_axis,
    {rowmean(*_HTREND)} AS structure_axis FROM e1m a LEFT JOIN e4 m ON m.symbol = a.symbol AND m.idx = a.idx""",
)


@check("w14_bar_ordinal", "SELECT symbol, date, idx FROM idx1")
def _(spark, sf):
    return indexed(spark, sf, 1).select("symbol", "date", "idx")


@check("w1_log_return", f"SELECT {ID}, {rnds('r')} FROM ret15")
def _(spark, sf):
    df = indexed(spark, sf)
    b = Blocks.of(df)
    rows = b.halo(df, back=1)
    return rounded(b.own(rows.withColumn("r", fx.log_return(b.order))).select("symbol", "idx", "date", "r"))


@check(
    "w2_rolling_moments",
    f"SELECT {ID}, {rnd(avg('close', 20, 10))} AS mean_20, {rnd(std('close', 80, 40))} AS std_80, {rnd(tot('volume', 30, 5))} AS sum_30 FROM idx15",
)
def _(spark, sf):
    df = indexed(spark, sf)
    b = Blocks.of(df)
    close = F.col("close")
    rows = b.halo(df, back=79).withColumns(
        {
            "mean_20": rolling.mean(close, b.last(20), 10),
            "std_80": rolling.deviation(close, b.last(80), 40),
            "sum_30": rolling.total(F.col("volume"), b.last(30), 5),
        }
    )
    return rounded(b.own(rows).select("symbol", "idx", "date", "mean_20", "std_80", "sum_30"))


@check("w3_rolling_zscore", f"SELECT {ID}, {rnd(zsc('close', 80, 20))} AS zscore FROM idx15")
def _(spark, sf):
    df = indexed(spark, sf)
    b = Blocks.of(df)
    rows = b.halo(df, back=79).withColumn("zscore", rolling.zscore(F.col("close"), b.last(80), 20))
    return rounded(b.own(rows).select("symbol", "idx", "date", "zscore"))


@check(
    "w4_percent_change",
    f"""SELECT {ID}, {rnd(f'close / nullif(lag(close, 20) {over()}, 0) - 1')} AS change_20,
    {rnd(f'abs(close / nullif(lag(close) {over()}, 0) - 1)')} AS abs_change_1 FROM idx15""",
)
def _(spark, sf):
    df = indexed(spark, sf)
    b = Blocks.of(df)
    rows = b.halo(df, back=20).withColumns(
        {
            "change_20": fx.pct_change(F.col("close"), 20, b.order),
            "abs_change_1": F.abs(fx.pct_change(F.col("close"), 1, b.order)),
        }
    )
    return rounded(b.own(rows).select("symbol", "idx", "date", "change_20", "abs_change_1"))


@check("w5_directional_persistence", f"SELECT {ID}, {rnds('script_directional_persistence')} FROM e2")
def _(spark, sf):
    return rounded(fx.scripted_features(indexed(spark, sf)).select("symbol", "idx", "date", "script_directional_persistence"))


_CH = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"


@check(
    "w6_lagged_channel",
    f"""SELECT {ID}, {rnd(f'CASE WHEN count(high) {_CH} >= 30 THEN max(high) {_CH} END')} AS prior_high,
    {rnd(f'CASE WHEN count(low) {_CH} >= 30 THEN min(low) {_CH} END')} AS prior_low FROM idx15""",
)
def _(spark, sf):
    df = indexed(spark, sf)
    b = Blocks.of(df)
    rows = b.halo(df, back=60).withColumns(
        {
            "prior_high": rolling.gated(F.max, F.col("high"), b.before(60), 30),
            "prior_low": rolling.gated(F.min, F.col("low"), b.before(60), 30),
        }
    )
    return rounded(b.own(rows).select("symbol", "idx", "date", "prior_high", "prior_low"))


@check(
    "w7_rolling_median",
    f"SELECT {ID}, {rnd(gated('quantile_cont({}, 0.5)', 'volume', 60, 30))} AS median_volume, "
    f"{rnd(gated('quantile_cont({}, 0.5)', 'abs(high - low)', 60, 30))} AS median_range FROM idx15",
)
def _(spark, sf):
    df = indexed(spark, sf)
    b = Blocks.of(df)
    rows = b.halo(df, back=59).withColumns(
        {
            "median_volume": rolling.median(F.col("volume"), b.last(60), 30),
            "median_range": rolling.median(F.abs(F.col("high") - F.col("low")), b.last(60), 30),
        }
    )
    return rounded(b.own(rows).select("symbol", "idx", "date", "median_volume", "median_range"))


@check("w8_rsi", f"SELECT {ID}, {rnd(RSI, 6)} AS rsi FROM gains15")
def _(spark, sf):
    df = indexed(spark, sf)
    b = Blocks.of(df)
    rows = fx.price_change(b.halo(df, back=14), b.order)
    rows = rows.withColumn("rsi", rolling.rsi(F.col("_gain"), F.col("_loss"), b.last(14), 14))
    return rounded(b.own(rows).select("symbol", "idx", "date", "rsi"), 6)


@check(
    "w9_forward_fill",
    f"SELECT {ID}, {rnd('last_value(spike IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)')} AS spike "
    "FROM (SELECT *, CASE WHEN high - low > 8 THEN close END AS spike FROM idx15) t",
)
def _(spark, sf):
    df = indexed(spark, sf).withColumn("spike", F.when(F.col("high") - F.col("low") > 8, F.col("close")))
    return rounded(ordered.forward_fill(df, ["spike"], Blocks.of(df)).select("symbol", "idx", "date", "spike"))


@check(
    "w10_one_bar_shift",
    f"SELECT {ID}, " + ", ".join(f"{rnd(f'lag({c}) {over()}')} AS prev_{c}" for c in ("close", "volume")) + " FROM idx15",
)
def _(spark, sf):
    df = indexed(spark, sf)
    b = Blocks.of(df)
    rows = b.halo(df, back=1).withColumns({f"prev_{c}": F.lag(c).over(b.order) for c in ("close", "volume")})
    return rounded(b.own(rows).select("symbol", "idx", "date", "prev_close", "prev_volume"))


_PEAK = "max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)"


@check("w12_running_peak_drawdown", f"SELECT {ID}, {rnd(_PEAK)} AS peak, {rnd(f'close / nullif({_PEAK}, 0) - 1')} AS drawdown FROM idx15")
def _(spark, sf):
    df = indexed(spark, sf)
    rows = ordered.running_peak(df, "close", "peak", Blocks.of(df))
    return rounded(rows.select("symbol", "idx", "date", "peak", (scalar.ratio(F.col("close"), F.col("peak")) - 1).alias("drawdown")))


@check("w17_row_chunks", "SELECT symbol, idx, idx // 200 AS chunk FROM idx15")
def _(spark, sf):
    return ordered.row_chunk(indexed(spark, sf), 200).select("symbol", "idx", "chunk")


@check(
    "w18_evenly_spaced_rows",
    """SELECT symbol, idx, date FROM idx15 JOIN (SELECT symbol, max(idx) + 1 AS n FROM idx15 GROUP BY 1) s USING (symbol)
    WHERE n <= 300 OR idx = n - 1 OR idx IN (SELECT CAST(floor(i * ((n - 1) / 299.0::DOUBLE)) AS BIGINT) FROM range(0, 299) g(i))""",
)
def _(spark, sf):
    return ordered.thin(indexed(spark, sf), 300).select("symbol", "idx", "date")


@check(
    "w19_stride_rows",
    """SELECT symbol, idx, date FROM idx15 JOIN (SELECT symbol, max(idx) + 1 AS n FROM idx15 GROUP BY 1) s USING (symbol)
    WHERE n <= 100 OR idx % greatest(1, n // 100) = 0""",
)
def _(spark, sf):
    return ordered.stride(indexed(spark, sf), 100).select("symbol", "idx", "date")


@check(
    "x1_row_mean_skipping_nulls",
    f"SELECT {ID}, {rnd(rowmean('rolling_vol_short', 'rolling_vol_long', 'momentum'))} AS value FROM e1",
)
def _(spark, sf):
    names = ("rolling_vol_short", "rolling_vol_long", "momentum")
    rows = fx.minute_features(indexed(spark, sf))
    return rounded(rows.select("symbol", "idx", "date", scalar.row_mean([F.col(c) for c in names]).alias("value")))


_RULES = list(fx.FRAMES)


@check(
    "a4_resampled_ohlcv",
    " UNION ALL ".join(
        f"SELECT '{p}' AS frame, symbol, label AS date, {rnds('open', 'high', 'low', 'close', 'volume')} FROM bins_{p}" for p in _RULES
    ),
)
def _(spark, sf):
    base = bars(spark, sf, 1)
    out = None
    for p in _RULES:
        part = resample.resampled(base, fx.FRAMES[p][0])
        part = part.select(F.lit(p).alias("frame"), "symbol", "date", "open", "high", "low", "close", "volume")
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@check("e1_minute_features", f"SELECT {ID}, {rnds('log_return', *fx.COLUMNS[fx.MINUTE])} FROM e1")
def _(spark, sf):
    return rounded(fx.minute_features(indexed(spark, sf)))


@check("e2_scripted_features", f"SELECT {ID}, {rnds('log_return', *fx.COLUMNS[fx.SCRIPTED])} FROM e2")
def _(spark, sf):
    return rounded(fx.scripted_features(indexed(spark, sf)))


for _p in _RULES:
    _names = [f"{_p}_{c}" for c in ("vol_short", "vol_long", "trend_short", "trend_long", "range_pct")]

    @check(f"e3_timeframe_features_{_p}", f"SELECT symbol, date, {rnds(*_names)} FROM tf_{_p}")
    def _(spark, sf, p=_p):
        return rounded(fx.timeframe_features(indexed(spark, sf, 1), p))


@check("e4_multi_timeframe_features", f"SELECT {ID}, {rnds(*fx.COLUMNS[fx.MULTI])} FROM e4")
def _(spark, sf):
    return rounded(fx.multi_timeframe_features(indexed(spark, sf, 1)))


@check(
    "j4_asof_backward",
    f"""SELECT b.symbol, b.idx, b.date, w.date AS weekly_date, {rnds('weekly_vol_short', 'weekly_range_pct')} FROM idx1 b
    ASOF LEFT JOIN tf_weekly w ON w.symbol = b.symbol AND w.date <= b.date""",
)
def _(spark, sf):
    base = indexed(spark, sf, 1)
    out = resample.asof_backward(base.select("symbol", "idx", "date"), {"w": fx.timeframe_features(base, "weekly")})
    return rounded(
        out.select("symbol", "idx", "date", F.col("w.date").alias("weekly_date"), "w.weekly_vol_short", "w.weekly_range_pct")
    )


@check("e5_hybrid_features", f"SELECT {ID}, {rnds('log_return', *fx.COLUMNS[fx.HYBRID])} FROM e5")
def _(spark, sf):
    base = indexed(spark, sf, 1)
    return rounded(fx.hybrid_features(fx.minute_features(base), fx.multi_timeframe_features(base)))


@check(
    "j5_hybrid_join",
    f"SELECT a.symbol, a.idx, {rnds('rolling_vol_short', 'i5_range_pct')} FROM e1m a LEFT JOIN e4 m ON m.symbol = a.symbol AND m.idx = a.idx",
)
def _(spark, sf):
    base = indexed(spark, sf, 1)
    both = fx.hybrid_features(fx.minute_features(base), fx.multi_timeframe_features(base))
    return rounded(both.select("symbol", "idx", "rolling_vol_short", "i5_range_pct"))


@check("e6_classifier_features", f"SELECT {ID}, target, {rnds(*fx.CLASSIFIER_COLUMNS, digits=7)} FROM e6")
def _(spark, sf):
    return rounded(fx.classifier_features(indexed(spark, sf)), 7)


view(
    "model_ids",
    """SELECT DISTINCT candidate || '::' || family AS model_id FROM (SELECT event_type || '_volatility_trend_' ||
    CASE WHEN value > 100 THEN 'hmm' ELSE 'kmeans' END AS candidate, CASE WHEN value > 50 THEN 'gaussian_hmm_quadrant'
    ELSE 'kmeans_quadrant' END AS family FROM events) t""",
)


@check(
    "x3_text_functions",
    """SELECT model_id, lower(regexp_replace(replace(model_id, '::', '__'), '[^a-zA-Z0-9._-]+', '_', 'g')) AS slug,
    replace(replace(replace(replace(array_to_string(list_transform(string_split(replace(model_id, '::', ' / '), ' / '), lambda part:
    array_to_string(list_transform(string_split(part, '_'), lambda t: upper(t[1]) || lower(t[2:])), ' ')), ' / '),
    'Kmeans ', 'KMeans '), 'Hmm ', 'HMM '), 'Kmeans', 'KMeans'), 'Hmm', 'HMM') AS label FROM model_ids""",
)
def _(spark, sf):
    kind, value = F.col("event_type"), F.col("value")
    candidate = F.concat(kind, F.lit("_volatility_trend_"), F.when(value > 100, "hmm").otherwise("kmeans"))
    family = F.when(value > 50, "gaussian_hmm_quadrant").otherwise("kmeans_quadrant")
    ids = spark.read.parquet(f"{sf}/events.parquet").select(F.concat_ws("::", candidate, family).alias("model_id")).distinct()
    return ids.select("model_id", scalar.slug(F.col("model_id")).alias("slug"), scalar.display_label(F.col("model_id")).alias("label"))
