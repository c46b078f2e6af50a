from datetime import datetime

from barlight.operators import clean
from barlight.plans.research import load_bars
from barlight.sources.raw import read_minute_csv
from barlight.sources.runs import RunStore

HEADER = "ts_event,rtype,publisher_id,instrument_id,open,high,low,close,volume,symbol\n"


def write(tmp_path, lines):
    path = tmp_path / "raw.csv"
    path.write_text(HEADER + "\n".join(lines))
    return str(path)


def row(ts, symbol="NQH6", o="100", h="101", low="99", c="100.5", v="10"):
    return f"{ts},33,1,7,{o},{h},{low},{c},{v},{symbol}"


def test_sample_takes_the_first_minutes(spark, tmp_path):
    path = write(
        tmp_path,
        [row(f"2024-01-02T14:3{i}:00.000000000Z") for i in range(4)]
        + [row("2024-01-02T14:30:00Z", symbol="NQM6", v="50", c="100.7"), row("2024-01-02T14:31:00Z", symbol="NQH6-NQM6", v="900")]
        + [row("2024-01-02T14:29:00Z", h="98"), row("2024-01-02T14:28:00Z", v="x"), row("garbage")],
    )
    bars = load_bars(read_minute_csv(spark, path), ["NQ"], sample_rows=3).orderBy("date").collect()
    assert [r["date"] for r in bars] == [datetime(2024, 1, 2, 9, 30 + i) for i in range(3)]
    assert bars[0]["close"] == 100.7 and bars[0]["symbol"] == "NQ" and [r["idx"] for r in bars] == [0, 1, 2]


def test_full_load_stitches_and_adjusts(spark, tmp_path):
    day1 = [row("2024-01-02T15:00:00Z", "NQH6", v="100"), row("2024-01-02T15:00:00Z", "NQM6", v="10", o="110", h="111", low="109", c="110.5")]
    day2 = [row("2024-01-03T15:00:00Z", "NQH6", v="10"), row("2024-01-03T15:00:00Z", "NQM6", v="100", o="110", h="111", low="109", c="110.5")]
    records = read_minute_csv(spark, write(tmp_path, day1 + day2))
    whole = load_bars(records, ["NQ"]).orderBy("date").collect()
    assert [r["close"] for r in whole] == [110.5, 110.5]  # the first day is lifted by the gap of 10
    plain = load_bars(records, ["NQ"], back_adjust=False).orderBy("date").collect()
    assert [r["close"] for r in plain] == [100.5, 110.5]
    summary = clean.load_summary(load_bars(records, ["NQ"])).first()
    assert (summary["rows"], summary["trade_days"], summary["start_date"]) == (2, 2, "2024-01-02")
    assert load_bars(records, ["ES"], sample_rows=5).count() == 0


def test_tables_without_rows_keep_their_columns(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"))
    models = spark.createDataFrame([("AA", "m", 1, True)], "symbol string, model_id string, rank int, is_best boolean")
    trades = spark.createDataFrame([("AA", 1.5, "m")], "symbol string, pnl double, model_id string")
    store.write("models", models, "r1")
    store.write_by_model("trades", trades.where("pnl > 2"), "r1")
    empty = store.read("trades", "r1").select("symbol", "pnl")
    assert empty.count() == 0 and empty.dtypes == [("symbol", "string"), ("pnl", "double")]
    store.write("models", models, "r2")
    store.write_by_model("trades", trades, "r2")
    assert [r["pnl"] for r in store.read("trades", "r2").collect()] == [1.5]
    assert store.read("trades", "r1").count() == 0 and store.read("metrics", "r1").count() == 0
    assert store.manifests().count() == 0
