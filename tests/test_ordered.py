import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barlight.operators import ordered, quantiles
from barlight.operators.features import minute_features
from barlight.operators.ordered import BLOCK_ROWS_CONF, Blocks

from helpers import bars_frame, from_pandas


def table(df, *columns):
    return [tuple(r) for r in df.select("symbol", "idx", *columns).orderBy("symbol", "idx").collect()]


def test_ordinal_counts_rows_by_date(spark):
    df = bars_frame(spark)
    again = ordered.with_ordinal(df.drop("idx").repartition(5, "close"), total="n")
    assert table(again) == table(df)
    assert {r[0] for r in again.select("n").distinct().collect()} == {300}


def test_block_scans_equal_plain_windows(spark):
    df = bars_frame(spark).withColumn("x", F.when(F.col("volume") > 140, F.col("close")))
    b = Blocks.of(df)
    assert b.rows == 64
    so_far = Window.partitionBy("symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("symbol").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    assert table(ordered.forward_fill(df, ["x"], b), "x") == table(df.withColumn("x", F.last("x", True).over(so_far)), "x")
    assert table(ordered.running_peak(df, "close", "p", b), "p") == table(df.withColumn("p", F.max("close").over(so_far)), "p")
    for made, plain in (
        (ordered.running_product(df, F.col("close") / 100, "p", b), F.product(F.col("close") / 100).over(so_far)),
        (ordered.later_total(df, "volume", "p", b), F.coalesce(F.sum("volume").over(later), F.lit(0.0))),
    ):
        got, want = table(made, "p"), table(df.withColumn("p", plain), "p")
        assert np.allclose([r[2] for r in got], [r[2] for r in want], rtol=1e-12)


def test_rolling_features_do_not_depend_on_block_size(spark):
    df = bars_frame(spark)
    small = table(minute_features(df), "rolling_vol_long", "trend_strength", "momentum")
    spark.conf.set(BLOCK_ROWS_CONF, "100000")
    try:
        whole = table(minute_features(df), "rolling_vol_long", "trend_strength", "momentum")
    finally:
        spark.conf.set(BLOCK_ROWS_CONF, "64")
    assert small == whole and len(small) == 600


@pytest.mark.parametrize("points", [2, 7, 50, 299, 300, 1000])
def test_thinning_keeps_even_positions(spark, points):
    df = bars_frame(spark, symbols=("AA",))
    got = [r[1] for r in table(ordered.thin(df, points))]
    want = sorted(set(np.linspace(0, 299, points).astype(int))) if points < 300 else list(range(300))
    assert got == want


def test_tail_quantile_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 100)
    rng = np.random.default_rng(3)
    import pandas as pd

    big = np.round(rng.normal(0, 1, 20_000), 3)
    small = rng.normal(0, 1, 37)
    pdf = pd.DataFrame({"k": ["big"] * len(big) + ["small"] * len(small) + ["one"], "x": np.concatenate([big, small, [5.0]])})
    rows = {r["k"]: r for r in quantiles.tail_quantile(from_pandas(spark, pdf), ["k"], "x", 0.05).collect()}
    for k, values in (("big", big), ("small", small), ("one", np.array([5.0]))):
        q = np.percentile(values, 5)
        assert rows[k]["quantile"] == pytest.approx(q, abs=1e-12)
        assert rows[k]["tail_mean"] == pytest.approx(values[values <= q + 1e-12].mean(), abs=1e-12)


def test_distribution_by_rounds_of_counts(spark, monkeypatch):
    """Bins that hold more rows than are sorted at once are split until they don't; ties, zeros and huge values included."""
    import pandas as pd

    rng = np.random.default_rng(5)
    groups = {
        "close": 1.0 + rng.integers(0, 3_000, 6_000) * 2.0**-52,  # neighbouring doubles
        "ties": np.repeat([-2.0, 0.0, 3.0], [200, 3_000, 800]),
        "flat": np.full(3_000, 0.25),
        "wide": np.concatenate([rng.normal(0, 1e-5, 4_000), [1e300, -1e300, 5e-324, -5e-324]]),
        "none": np.zeros(50),
        "edge": np.arange(1.0, 22.0),
    }
    pdf = pd.DataFrame([(k, float(v)) for k, values in groups.items() for v in values], columns=["k", "x"])
    df = from_pandas(spark, pdf)
    for small in (1, 50, 10_000):
        monkeypatch.setattr(quantiles, "SMALL", small)
        for p in (0.05, 0.5, 1.0):
            rows = {r["k"]: r for r in quantiles.distribution(df, ["k"], "x", p).collect()}
            assert set(rows) == set(groups)
            for k, values in groups.items():
                at = (len(values) - 1) * p
                low, high = np.sort(values)[[int(np.floor(at)), int(np.ceil(at))]]
                assert rows[k]["quantile"] == pytest.approx(low + (at - np.floor(at)) * (high - low), rel=1e-15)
                assert rows[k]["count"] == len(values)
                assert rows[k]["share_above"] == pytest.approx((values > 0).mean())
                if k != "wide":
                    assert rows[k]["tail_mean"] == pytest.approx(values[values <= low].mean(), rel=1e-12)
                    assert rows[k]["mean"] == pytest.approx(values.mean(), rel=1e-12)
                    assert rows[k]["deviation"] == pytest.approx(values.std(), rel=1e-6, abs=1e-15)
    assert rows["flat"]["deviation"] == 0.0 and rows["flat"]["down_deviation"] is None
    assert rows["ties"]["down_deviation"] == 0.0
    assert quantiles.distribution(df.limit(0), ["k"], "x", 0.05).count() == 0
