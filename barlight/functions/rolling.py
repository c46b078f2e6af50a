"""Rolling statistics over a row frame, null until enough values have been seen.

Frames count rows, null rows included; all deviations are population ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from barlight.functions.scalar import ratio


def gated(agg: Callable[[Column], Column], x: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(frame) >= least, agg(x).over(frame))


def mean(x: Column, frame: WindowSpec, least: int) -> Column:
    return gated(F.avg, x, frame, least)


def deviation(x: Column, frame: WindowSpec, least: int) -> Column:
    return gated(F.stddev_pop, x, frame, least)


def total(x: Column, frame: WindowSpec, least: int) -> Column:
    return gated(F.sum, x, frame, least)


def median(x: Column, frame: WindowSpec, least: int) -> Column:
    return gated(lambda c: F.percentile(c, F.lit(0.5)), x, frame, least)


def zscore(x: Column, frame: WindowSpec, least: int) -> Column:
    """Distance from the rolling mean in deviations; null where the deviation is zero."""
    return ratio(x - mean(x, frame, least), deviation(x, frame, least))


def rsi(gain: Column, loss: Column, frame: WindowSpec, n: int) -> Column:
    """Relative strength index from plain averages; null where there was no loss."""
    strength = ratio(mean(gain, frame, n), mean(loss, frame, n))
    return 100.0 - 100.0 / (1.0 + strength)
