"""Answers must not depend on the session's time zone or on the order of files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barlight.functions.scalar import bucket_end
from barlight.operators import resample
from barlight.schema import RAW_MINUTES
from barlight.sources.raw import read_minute_csv, read_minute_files

ZONES = ["UTC", "America/New_York", "Asia/Kolkata"]


@pytest.fixture
def zone(spark):
    def use(name):
        spark.conf.set("spark.sql.session.timeZone", name)

    yield use
    spark.conf.set("spark.sql.session.timeZone", "UTC")


TIMES = [dt.datetime(2024, 1, 2, 10), dt.datetime(2024, 1, 2, 21, 0, 0, 1), dt.datetime(2024, 1, 3), dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(1969, 12, 31, 23, 59, 59, 999999)]


@pytest.mark.parametrize("name", ZONES)
def test_bucket_end_is_wall_clock(spark, zone, name):
    zone(name)
    rows = spark.createDataFrame([(t,) for t in TIMES], "ts timestamp_ntz")
    for micros in (60_000_000, 900_000_000, 86_400_000_000):
        for r in rows.select("ts", bucket_end(F.col("ts"), micros).alias("end")).collect():
            since = (r.ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
            assert r.end == dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=-(-since // micros) * micros)


def test_daily_bars_are_equal_in_all_zones(spark, zone):
    found = []
    for name in ZONES:
        zone(name)
        rows = [("X", dt.datetime(2024, 1, d, h), 1.0, 2.0, 0.5, float(h), 1.0) for d, h in ((2, 10), (2, 21), (3, 10))]
        bars = spark.createDataFrame(rows, "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double")
        found.append(sorted((r.date, r.close, r.volume) for r in resample.resampled(bars, "1D").collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 2


def csv(folder, name, columns, values):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(",".join(columns) + "\n" + ",".join(values[c] for c in columns) + "\n")


def test_files_with_another_header_fail(spark, tmp_path):
    names = [*RAW_MINUTES.names, "publisher_id"]
    values = {c: f"v_{c}" for c in names}
    folder = tmp_path / "same"
    csv(folder, "a.csv", names[::-1], values)
    csv(folder, "b.csv", names[::-1], values)
    rows = read_minute_csv(spark, str(folder)).collect()
    assert [tuple(r) for r in rows] == [tuple(f"v_{c}" for c in RAW_MINUTES.names)] * 2
    mixed = tmp_path / "mixed"
    csv(mixed, "a.csv", names, values)
    csv(mixed, "b.csv", ["symbol", *[c for c in names if c != "symbol"]], values)
    with pytest.raises(Exception, match="CSV header does not conform|conform to the schema"):
        read_minute_csv(spark, str(mixed)).collect()
    csv(tmp_path / "absent", "a.csv", names[1:], values)
    with pytest.raises(ValueError):
        read_minute_csv(spark, str(tmp_path / "absent"))


def test_headers_are_read_file_by_file(spark, tmp_path):
    names = [*RAW_MINUTES.names, "publisher_id"]
    values = {c: f"v_{c}" for c in names} | {"publisher_id": '"a, ""b"""'}
    csv(tmp_path, "a.csv", names, values)
    csv(tmp_path, "b.csv", names[::-1], values | {"close": ""})
    csv(tmp_path, "c.csv", [c for c in names if c != "volume"], values)
    (tmp_path / "d.csv").write_text("1,2,3\n")
    (tmp_path / "e.csv").write_text(",".join(names) + "\n1,2,3\n" + ",".join(names[::-1]) + "\n")
    (tmp_path / "f.csv").write_text(",".join(names) + "\n\n1,2,3\n" + ",".join(names) + "\n")
    rows, quarantine = read_minute_files(spark, str(tmp_path))
    good = tuple(values[c] for c in RAW_MINUTES.names)
    assert sorted((tuple(r) for r in rows.collect()), key=str) == sorted([good, tuple(None if c == "close" else values[c] for c in RAW_MINUTES.names)], key=str)
    reasons = {r.file.rsplit("/", 1)[1]: r.reason for r in quarantine.collect()}
    assert reasons == {"c.csv": "no column volume", "d.csv": "no header", "e.csv": "several headers", "f.csv": f"3 fields of {len(names)}"}


def test_bins_rolled_up_from_records_equal_those_of_the_bars(spark):
    """Weeks end with Friday, days take the midnight after them in: a record never lies in two bins."""
    friday = dt.datetime(2024, 1, 5, 23, 50)
    rows = [
        (k, friday + dt.timedelta(minutes=i), 1.0 + i, 3.0 + i % 7, 0.5 - i, 2.0 * i, 1.0 + i)
        for k, step in (("a", 3), ("b", 1)) for i in range(0, 4000, step)
    ]
    bars = spark.createDataFrame(rows, "symbol string, date timestamp_ntz, open double, high double, low double, close double, volume double")
    records = resample.partials(bars)
    for rule in (resample.FIVE_MINUTES, resample.DAY, resample.WEEK):
        want = sorted(tuple(r) for r in resample.resampled(bars, rule).select(*bars.columns).collect())
        assert sorted(tuple(r) for r in resample.rolled_up(records, rule).select(*bars.columns).collect()) == want
    assert resample.rolled_up(resample.partials(bars.limit(0)), resample.WEEK).count() == 0


def test_asof_takes_the_last_row_of_any_earlier_day(spark):
    at = dt.datetime.fromisoformat
    left = [("a", i, t) for i, t in enumerate([at("2024-01-01 10:00"), at("2024-01-02 00:00"), at("2024-01-04 09:00"), at("2024-01-04 10:00")])]
    left = spark.createDataFrame(left + [("b", 0, at("2024-01-04 10:00"))], "symbol string, idx int, date timestamp_ntz")
    slow = spark.createDataFrame([("a", at("2024-01-02 00:00"), 1), ("a", at("2024-01-04 10:00"), 2)], "symbol string, date timestamp_ntz, v int")
    fast = spark.createDataFrame([("a", at("2024-01-01 09:00"), None), ("a", at("2024-01-03 12:00"), 7)], "symbol string, date timestamp_ntz, w int")
    found = resample.asof_backward(left, {"slow": slow, "fast": fast}).select("symbol", "idx", "slow.v", "fast.date", "fast.w")
    assert sorted((tuple(r) for r in found.collect()), key=str) == [
        ("a", 0, None, at("2024-01-01 09:00"), None), ("a", 1, 1, at("2024-01-01 09:00"), None),
        ("a", 2, 1, at("2024-01-03 12:00"), 7), ("a", 3, 2, at("2024-01-03 12:00"), 7), ("b", 0, None, None, None),
    ]
