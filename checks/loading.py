"""Sources, filters, cleaning and the continuous series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlight.operators import clean, continuous, ordered
from barlight.schema import RAW_MINUTES
from barlight.session import shared_folder
from barlight.sources.raw import read_minute_files
from checks.registry import check, rnds, rnd, rounded, view
from checks.views import bars, contracts, indexed, raw_minutes

ROOT = ["NQ"]
PX = ("open", "high", "low", "close")

view("outright_rows", "SELECT * FROM raw_minutes WHERE regexp_full_match(symbol, 'NQ[HMUZ][0-9]{1,2}')")
view(
    "local_rows",
    """SELECT *, timezone('America/New_York', timezone('UTC', utc)) AS date FROM (
    SELECT *, try_strptime(ts_event, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM outright_rows) t WHERE utc IS NOT NULL""",
)
view(
    "numeric_rows",
    """SELECT symbol, date, utc, o AS open, h AS high, l AS low, c AS close, v AS volume FROM (
    SELECT symbol, date, utc, TRY_CAST(open AS DOUBLE) o, TRY_CAST(high AS DOUBLE) h, TRY_CAST(low AS DOUBLE) l,
    TRY_CAST(close AS DOUBLE) c, TRY_CAST(volume AS DOUBLE) v FROM local_rows) t
    WHERE o IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL AND v IS NOT NULL""",
)
view(
    "consistent_rows",
    "SELECT * FROM numeric_rows WHERE high >= low AND open BETWEEN low AND high AND close BETWEEN low AND high",
)
view(
    "minute_best",
    """SELECT 'NQ' AS symbol, date, open, high, low, close, volume FROM (
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, symbol, utc, open, high, low, close) AS rn FROM consistent_rows) t WHERE rn = 1""",
)


@check("s1_raw_scan", f"SELECT {', '.join(RAW_MINUTES.names)} FROM raw_minutes")
def _(spark, sf):
    """Written as CSV files of two header orders, one with a further column, and read back."""
    rows = raw_minutes(spark, sf).select(*RAW_MINUTES.names)
    folder = f"{shared_folder(spark)}/minutes/{uuid.uuid4().hex}"
    odd = F.xxhash64(*RAW_MINUTES.names) % 2 != 0
    rows.where(odd).write.option("header", True).csv(f"{folder}/a")
    rows.where(~odd).select(F.lit("x,y").alias("extra"), *RAW_MINUTES.names[::-1]).write.option("header", True).csv(f"{folder}/b")
    return read_minute_files(spark, f"{folder}/*")[0]


@check("f1_outright_contracts", "SELECT symbol, 'NQ' AS root, ts_event, close FROM outright_rows")
def _(spark, sf):
    return clean.outrights(raw_minutes(spark, sf), ROOT).select("symbol", "root", "ts_event", "close")


@check("f2_market_time", "SELECT symbol, ts_event, utc, date FROM local_rows")
def _(spark, sf):
    rows = clean.local_dates(clean.outrights(raw_minutes(spark, sf), ROOT))
    return rows.select("symbol", "ts_event", "utc", "date")


@check(
    "f3_date_range",
    f"SELECT symbol, date, {rnds(*PX)} FROM bars15 WHERE date >= TIMESTAMP '2024-01-05' AND date < TIMESTAMP '2024-01-13'",
)
def _(spark, sf):
    return rounded(clean.date_range(bars(spark, sf), "2024-01-05", "2024-01-12").select("symbol", "date", *PX))


@check(
    "f4_session",
    f"""SELECT symbol, date, {rnds(*PX)} FROM bars15
    WHERE hour(date) * 60 + minute(date) >= 570 AND hour(date) * 60 + minute(date) < 960""",
)
def _(spark, sf):
    return rounded(clean.session(bars(spark, sf), "09:30", "16:00").select("symbol", "date", *PX))


@check("f5_numeric", f"SELECT symbol, date, {rnds(*PX, 'volume')} FROM numeric_rows")
def _(spark, sf):
    rows = clean.numeric(clean.local_dates(clean.outrights(raw_minutes(spark, sf), ROOT)))
    return rounded(rows.select("symbol", "date", *PX, "volume"))


@check("f6_consistent", f"SELECT symbol, date, {rnds(*PX, 'volume')} FROM consistent_rows")
def _(spark, sf):
    rows = clean.normalised(raw_minutes(spark, sf), ROOT)
    return rounded(rows.select("symbol", "date", *PX, "volume"))


@check("w15_best_contract_per_minute", f"SELECT symbol, date, {rnds(*PX, 'volume')} FROM minute_best")
def _(spark, sf):
    return rounded(clean.best_per_minute(clean.normalised(raw_minutes(spark, sf), ROOT)))


@check(
    "s2_sample_load",
    f"""SELECT symbol, date, {rnds(*PX, 'volume')} FROM minute_best
    WHERE date >= TIMESTAMP '2024-01-03' AND hour(date) * 60 + minute(date) BETWEEN 540 AND 959 ORDER BY date LIMIT 500""",
)
def _(spark, sf):
    return rounded(
        clean.sample_bars(
            raw_minutes(spark, sf), "NQ", 500, start="2024-01-03", session_start="09:00", session_end="16:00"
        )
    )


view(
    "validated_rows",
    """SELECT symbol, date, open, high, low, close, volume FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY utc DESC, volume DESC, open DESC, high DESC, low DESC, close DESC) AS rn
    FROM consistent_rows) t WHERE rn = 1""",
)


@check("s3_validated_bars", f"SELECT symbol, date, {rnds(*PX, 'volume')} FROM validated_rows")
def _(spark, sf):
    rows = clean.local_dates(clean.outrights(raw_minutes(spark, sf), ROOT))
    return rounded(clean.validated(rows.drop("ts_event", "root")))


@check(
    "s3_rows_removed",
    """SELECT b.symbol, CAST(b.n - coalesce(a.n, 0) AS BIGINT) AS rows_removed
    FROM (SELECT symbol, count(*) n FROM local_rows GROUP BY 1) b
    LEFT JOIN (SELECT symbol, count(*) n FROM validated_rows GROUP BY 1) a USING (symbol)""",
)
def _(spark, sf):
    rows = clean.local_dates(clean.outrights(raw_minutes(spark, sf), ROOT)).drop("ts_event", "root")
    return clean.rows_removed(rows, clean.validated(rows))


@check(
    "s4_load_summary",
    """SELECT symbol, count(*) AS rows, count(DISTINCT CAST(date AS DATE)) AS trade_days,
    strftime(min(date), '%Y-%m-%d') AS start_date, strftime(max(date), '%Y-%m-%d') AS end_date FROM bars1 GROUP BY 1""",
)
def _(spark, sf):
    return clean.load_summary(bars(spark, sf, 1))


@check("s5_latest_date", "SELECT 'NQ' AS root, max(date) AS latest FROM local_rows")
def _(spark, sf):
    return clean.latest_dates(raw_minutes(spark, sf), ROOT)


@check(
    "s6_trailing_years",
    f"SELECT symbol, date, {rnds('close')} FROM bars15 WHERE date >= TIMESTAMP '2024-01-15' AND date < TIMESTAMP '2025-01-16'",
)
def _(spark, sf):
    return rounded(clean.trailing_years(bars(spark, sf), 1, "2025-01-15").select("symbol", "date", "close"))


@check(
    "s6_trailing_years_from_latest",
    f"""SELECT symbol, date, {rnds('close')} FROM bars15 JOIN (SELECT symbol, max(date) AS m FROM bars15 GROUP BY 1) l USING (symbol)
    WHERE date >= CAST(m AS DATE) - INTERVAL 1 YEAR""",
)
def _(spark, sf):
    return rounded(clean.trailing_years(bars(spark, sf), 1).select("symbol", "date", "close"))


@check(
    "u2_distinct_dates",
    f"""SELECT symbol, date, {rnds('close', 'volume')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date
    ORDER BY utc DESC, volume DESC, open DESC, high DESC, low DESC, close DESC) AS rn FROM numeric_rows) t WHERE rn = 1""",
)
def _(spark, sf):
    rows = clean.numeric(clean.local_dates(clean.outrights(raw_minutes(spark, sf), ROOT))).drop("ts_event", "root")
    kept = clean.distinct_dates(rows.select("symbol", "date", "utc", "volume", *PX), ties=("utc", "volume"))
    return rounded(kept.select("symbol", "date", "close", "volume"))


# --- continuous series -------------------------------------------------------

view(
    "contract_days",
    """SELECT CAST(date AS DATE) AS trade_day, symbol, sum(volume) AS volume FROM contracts60
    WHERE regexp_full_match(symbol, 'NQ[HMUZ][0-9]{1,2}') GROUP BY 1, 2""",
)
view(
    "front_days",
    """SELECT 'NQ' AS root, trade_day, symbol AS front_symbol, volume FROM (SELECT *, row_number() OVER
    (PARTITION BY trade_day ORDER BY volume DESC, symbol) AS rn FROM contract_days) t WHERE rn = 1""",
)
view(
    "switch_days",
    """SELECT root, trade_day, old_symbol, front_symbol AS new_symbol FROM (SELECT *, lag(front_symbol) OVER
    (ORDER BY trade_day) AS old_symbol FROM front_days) t WHERE old_symbol IS NOT NULL AND old_symbol <> front_symbol""",
)
view(
    "roll_pairs",
    """SELECT s.root, s.trade_day, s.old_symbol, s.new_symbol, c.date,
    max(CASE WHEN c.symbol = old_symbol THEN close END) AS old_close, max(CASE WHEN c.symbol = new_symbol THEN close END) AS new_close
    FROM switch_days s JOIN contracts60 c ON CAST(c.date AS DATE) = s.trade_day AND c.symbol IN (old_symbol, new_symbol)
    GROUP BY ALL""",
)
view(
    "roll_table",
    """SELECT root, trade_day, old_symbol, new_symbol,
    CASE WHEN count(new_close - old_close) > 0 THEN quantile_cont(new_close - old_close, 0.5)
         ELSE arg_min(new_close, date) FILTER (new_close IS NOT NULL) - arg_max(old_close, date) FILTER (old_close IS NOT NULL) END AS roll_gap,
    CASE WHEN count(new_close - old_close) > 0 THEN 'median_overlap_close' ELSE 'first_new_minus_last_old' END AS source
    FROM roll_pairs GROUP BY ALL HAVING count(new_close) > 0 AND count(old_close) > 0""",
)
view(
    "adjust_days",
    """SELECT root, trade_day, gap AS roll_gap, coalesce(sum(gap) OVER (ORDER BY trade_day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0)
    AS back_adjustment FROM (SELECT f.root, f.trade_day, coalesce(roll_gap, 0.0) AS gap FROM front_days f LEFT JOIN roll_table r USING (root, trade_day)) t""",
)
view(
    "front_bars",
    """SELECT 'NQ' AS symbol, c.date, open, high, low, close, c.volume, trade_day FROM contracts60 c
    JOIN front_days f ON CAST(c.date AS DATE) = f.trade_day AND c.symbol = f.front_symbol""",
)


def nq_rows(spark, sf):
    return continuous.with_trade_day(clean.outrights(contracts(spark, sf), ROOT))


def nq_front(spark, sf):
    return continuous.dominant(continuous.daily_volume(nq_rows(spark, sf)))


@check("a1_daily_volume", "SELECT 'NQ' AS root, * FROM contract_days")
def _(spark, sf):
    return continuous.daily_volume(nq_rows(spark, sf))


@check("a2_dominant_contract", "SELECT * FROM front_days")
def _(spark, sf):
    return nq_front(spark, sf)


@check("w21_contract_switches", "SELECT * FROM switch_days")
def _(spark, sf):
    return continuous.switches(nq_front(spark, sf))


@check("j2_roll_overlap", f"SELECT root, trade_day, date, {rnds('old_close', 'new_close')} FROM roll_pairs WHERE old_close IS NOT NULL AND new_close IS NOT NULL")
def _(spark, sf):
    rows = nq_rows(spark, sf)
    pairs = continuous.overlap(rows, nq_front(spark, sf)).where("old_close IS NOT NULL AND new_close IS NOT NULL")
    return rounded(pairs.select("root", "trade_day", "date", "old_close", "new_close"))


@check("a3_roll_gaps", f"SELECT root, trade_day, old_symbol, new_symbol, source, {rnds('roll_gap')} FROM roll_table")
def _(spark, sf):
    return rounded(continuous.roll_gaps(nq_rows(spark, sf), nq_front(spark, sf)))


@check("w13_back_adjustments", f"SELECT root, trade_day, {rnds('roll_gap', 'back_adjustment')} FROM adjust_days")
def _(spark, sf):
    front = nq_front(spark, sf)
    return rounded(continuous.back_adjustments(front, continuous.roll_gaps(nq_rows(spark, sf), front)))


@check(
    "w13_later_total",
    f"""SELECT symbol, date, {rnd('coalesce(sum(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0.0)')}
    AS later_volume FROM bars15""",
)
def _(spark, sf):
    df = indexed(spark, sf)
    out = ordered.later_total(df, "volume", "later_volume", ordered.Blocks.of(df))
    return rounded(out.select("symbol", "date", "later_volume"))


@check("j1_front_rows", f"SELECT symbol, date, {rnds(*PX, 'volume')} FROM front_bars")
def _(spark, sf):
    return rounded(continuous.stitch(nq_rows(spark, sf), back_adjust=False))


@check(
    "j3_back_adjusted_series",
    "SELECT symbol, date, " + ", ".join(f"{rnd(f'{c} + coalesce(back_adjustment, 0)')} AS {c}" for c in PX)
    + f", {rnds('volume')} FROM front_bars LEFT JOIN adjust_days USING (trade_day)",
)
def _(spark, sf):
    return rounded(continuous.stitch(nq_rows(spark, sf)))


@check(
    "x2_date_functions",
    """SELECT symbol, date, CAST(date AS DATE) AS day, hour(date) * 60 + minute(date) AS minute_of_day,
    CAST(CAST(date AS DATE) - INTERVAL 2 YEAR AS DATE) AS two_years_back FROM bars15""",
)
def _(spark, sf):
    return bars(spark, sf).select(
        "symbol", "date", F.to_date("date").alias("day"), (F.hour("date") * 60 + F.minute("date")).alias("minute_of_day"),
        F.add_months("date", -24).alias("two_years_back"),
    )
