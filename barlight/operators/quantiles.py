"""Moments, exact quantiles and tail means of large groups, from counts of value bins.

A first pass counts each group's values in bins whose width grows with the value. The bin that holds the wanted rank is
split again, in rounds that only count, until it holds few rows or the two neighbours of the rank are the ends of two
bins. No group is gathered or sorted whole in one task, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.session import sized

PER_OCTAVE = 32  # bins of the first pass for each doubling of the value
OFFSET = 40_000  # larger than PER_OCTAVE times the exponent of any double
SPLITS = 4_096  # parts of a bin in a further round
SMALL = 10_000  # rows of a bin that are sorted in one task rather than split again
MOMENTS = ["count", "mean", "deviation", "down_deviation", "share_above"]
_COUNTS = ["_c", "_s", "_lo", "_hi"]


def value_bin(x: Column) -> Column:
    """Number of the value's bin; a greater value never has a smaller one."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1025.0)) * PER_OCTAVE) + OFFSET
    bin_ = F.when(F.isnan(x), 3 * OFFSET).when(x > 0, size).when(x < 0, -size).otherwise(0)
    return bin_.cast("int")


def _counted(x: Column) -> list[Column]:
    return [F.count(x).alias("_c"), F.sum(x).alias("_s"), F.min(x).alias("_lo"), F.max(x).alias("_hi")]


def _picked(bins: DataFrame, keys: list[str], p: float, further: Sequence[Column] = ()) -> DataFrame:
    """Per group the bin that holds the rank, with what lies before it.

    ``bins`` carry ``_n`` (rows of the group), ``_rows0`` and ``_sum0`` (rows and sum before the first bin). ``_over`` is the
    value of the next higher rank, null as long as that needs a look into the bin.
    """
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns(
        {"_rows0": F.col("_rows0") + F.coalesce(F.sum("_c").over(before), F.lit(0)),
         "_sum0": F.col("_sum0") + F.coalesce(F.sum("_s").over(before), F.lit(0.0))}
    )
    rank = (F.col("_n") - 1) * p

    def holds(position: Column) -> Column:
        return (F.col("_rows0") <= position) & (position < F.col("_rows0") + F.col("_c"))

    found = bins.groupBy(*keys).agg(
        F.max(F.when(holds(F.floor(rank)), F.struct("_bin", *_COUNTS, "_n", "_rows0", "_sum0"))).alias("_at"),
        F.max(F.when(holds(F.ceil(rank)), F.struct("_bin", "_lo"))).alias("_up"),
        *further,
    )
    over = F.when(F.col("_at._bin") != F.col("_up._bin"), F.col("_up._lo")).when(F.col("_at._lo") == F.col("_at._hi"), F.col("_at._hi"))
    return found.withColumn("_over", over).select("*", "_at.*").drop("_at", "_up", "_bin")


def _first_pass(rows: DataFrame, keys: list[str], p: float) -> DataFrame:
    """Moments and the picked bin of every group from one pass over the rows."""
    x = F.col("_x")
    bins = rows.groupBy(*keys, value_bin(x).alias("_bin")).agg(*_counted(x), (F.var_pop(x) * F.count(x)).alias("_m2"))
    whole = Window.partitionBy(*keys)
    low = F.col("_bin") < 0
    bins = bins.withColumns({"_n": F.sum("_c").over(whole), "_rows0": F.lit(0).cast("long"), "_sum0": F.lit(0.0)})
    bins = bins.withColumns(
        {"_mean": F.sum("_s").over(whole) / F.col("_n"),
         "_down": F.sum(F.when(low, F.col("_s"))).over(whole) / F.sum(F.when(low, F.col("_c"))).over(whole)}
    )

    def deviation(mean: str, which: Column) -> Column:
        apart = F.col("_s") / F.col("_c") - F.col(mean)
        squares = F.sum(F.when(which, F.col("_m2") + F.col("_c") * apart * apart))
        return F.sqrt(squares / F.sum(F.when(which, F.col("_c"))))

    return _picked(bins, keys, p, [
        F.sum("_c").alias("count"),
        F.max("_mean").alias("mean"),
        deviation("_mean", F.lit(True)).alias("deviation"),
        deviation("_down", low).alias("down_deviation"),
        (F.sum(F.when(F.col("_bin") > 0, F.col("_c")).otherwise(0)) / F.sum("_c")).alias("share_above"),
    ])


def _inside(rows: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that lie in their group's picked bin."""
    ends = picked.select(*keys, *_COUNTS[2:], "_n", "_rows0", "_sum0")
    return rows.join(ends, keys).where(F.col("_x").between(F.col("_lo"), F.col("_hi")))


def _split(rows: DataFrame, wide: DataFrame, keys: list[str], p: float) -> DataFrame:
    """One further round: the picked bins in equal parts, and the part that holds the rank."""
    part = F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * SPLITS)
    parts = _inside(rows, wide, keys).withColumn("_bin", F.least(part, F.lit(SPLITS - 1)).cast("int"))
    bins = parts.groupBy(*keys, "_bin", "_n", "_rows0", "_sum0").agg(*_counted(F.col("_x")))
    return _picked(bins, keys, p).join(wide.select(*keys, *MOMENTS), keys)


def distribution(df: DataFrame, keys: Sequence[str], value: str, p: float) -> DataFrame:
    """Per group: count, mean, population deviation of all and of the negative values, share of positive ones, ``quantile``
    (linear between ranks) and ``tail_mean`` of the values up to it. Nulls don't count; a group of nulls alone has no row.

    Besides the first pass the rows are read once more for what the picked bins hold (some 0.4 % around a tail), and once
    for each round that a bin of more than ``SMALL`` rows needs.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    picked = sized(_first_pass(rows, keys, p))
    is_open = F.col("_over").isNull()
    while (most := picked.where(is_open).agg(F.max("_c")).first()[0]) is not None and most > SMALL:
        wide = F.col("_over").isNull() & (F.col("_c") > SMALL)
        picked = sized(picked.where(~wide).unionByName(_split(rows, picked.where(wide), keys, p)))
    closed = picked.select(
        *keys, *MOMENTS, "_n", F.col("_hi").alias("_low"), F.col("_over").alias("_high"),
        (F.col("_rows0") + F.col("_c")).alias("_rows"), (F.col("_sum0") + F.col("_s")).alias("_sum"),
    )
    rank = (F.col("_n") - 1) * p
    if most is not None:
        cells = _inside(rows, picked.where(is_open), keys).groupBy(*keys, "_x", "_n", "_rows0", "_sum0").agg(
            F.count(F.lit(1)).alias("_c"), F.sum("_x").alias("_s")
        )
        walk = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
        cells = cells.withColumns(
            {"_end": F.col("_rows0") + F.sum("_c").over(walk), "_sum": F.col("_sum0") + F.sum("_s").over(walk)}
        )

        def at(position: Column) -> Column:
            return F.min(F.when(position < F.col("_end"), F.col("_x")))

        sorted_ = cells.groupBy(*keys).agg(
            at(F.floor(rank)).alias("_l"), at(F.ceil(rank)).alias("_h"),
            F.min(F.when(F.floor(rank) < F.col("_end"), F.struct("_end", "_sum"))).alias("_tail"),
        )
        closed = closed.join(sorted_, keys, "left").withColumns(
            {"_low": F.coalesce("_l", "_low"), "_high": F.coalesce("_h", "_high"),
             "_rows": F.coalesce("_tail._end", "_rows"), "_sum": F.coalesce("_tail._sum", "_sum")}
        )
    # Equal neighbours need no step, whatever the value.
    step = F.when(F.col("_low") == F.col("_high"), 0.0).otherwise((rank - F.floor(rank)) * (F.col("_high") - F.col("_low")))
    return closed.select(
        *keys, *MOMENTS, (F.col("_low") + step).alias("quantile"), (F.col("_sum") / F.col("_rows")).alias("tail_mean")
    )


def tail_quantile(df: DataFrame, keys: Sequence[str], value: str, p: float) -> DataFrame:
    """Per group: ``quantile`` (linear between ranks) and ``tail_mean`` of the values up to it."""
    return distribution(df, keys, value, p).select(*keys, "quantile", "tail_mean")
