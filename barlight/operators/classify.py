"""Learned signals: next-bar direction classifiers per symbol.

Symbols are keys: all of them are fitted together and scored together, none by a loop of the driver. Train rows per
symbol are thinned to at most ``max_train_rows`` (a rule of the method).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.operators import logistic, trees
from barlight.operators.features import CLASSIFIER_COLUMNS, classifier_features
from barlight.operators.ordered import evenly_spaced, with_ordinal
from barlight.schema import TINY
from barlight.session import sized, staged

LEARNED = ["ml_rf", "ml_logreg", "ml_gbrt"]
SEED = 181


def split_rows(bars: DataFrame, train_fraction: float = 0.60, max_train_rows: int = 50_000) -> DataFrame:
    """Complete feature rows marked train or test by time; train rows thinned evenly.

    The last train row's target looks one bar into the test part, and the very last bar's
    target is 0.
    """
    sizes = sized(bars.groupBy("symbol").agg(F.floor((F.max("idx") + 1) * train_fraction).alias("_split")))
    rows = classifier_features(bars).dropna(subset=CLASSIFIER_COLUMNS).join(sizes, "symbol")
    rows = rows.withColumn("part", F.when(F.col("idx") < F.col("_split"), "train").otherwise("test")).drop("_split")
    rows = with_ordinal(rows, ("symbol", "part"), ("date",), out="_ord", total="_n")
    keep = (F.col("part") == "test") | evenly_spaced(F.col("_ord"), F.col("_n"), max_train_rows)
    return rows.where(keep).drop("_ord", "_n")


def fittable(rows: DataFrame) -> DataFrame:
    """Symbols with enough train and test rows and both classes, with their class counts."""
    train = F.col("part") == "train"
    table = rows.groupBy("symbol").agg(
        F.count_if(train).alias("train_rows"),
        F.count_if(~train).alias("test_rows"),
        F.count_if(train & (F.col("target") == 1)).alias("ups"),
    )
    enough = (F.col("train_rows") >= 200) & (F.col("test_rows") >= 10)
    return table.where(enough & (F.col("ups") > 0) & (F.col("ups") < F.col("train_rows")))


def with_points(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """Add the raw and the scaled feature vector and the balancing class weight."""
    train = rows.where(F.col("part") == "train")
    scale = sized(train.groupBy("symbol").agg(
        F.array(*[F.avg(c) for c in CLASSIFIER_COLUMNS]).alias("_m"),
        F.array(*[F.stddev_pop(c) for c in CLASSIFIER_COLUMNS]).alias("_s"),
    ))
    out = rows.join(symbols, "symbol").join(scale, "symbol")
    scaled = []
    for i, c in enumerate(CLASSIFIER_COLUMNS):
        gap = F.col(c) - F.col("_m")[i]
        scaled.append(F.when(F.col("_s")[i] > TINY, gap / F.col("_s")[i]).otherwise(gap))
    of_class = F.when(F.col("target") == 1, F.col("ups")).otherwise(F.col("train_rows") - F.col("ups"))
    return out.select(
        "symbol", "idx", "date", "part", F.col("target").cast("double").alias("label"),
        F.array(*CLASSIFIER_COLUMNS).alias("raw"), F.array(*scaled).alias("scaled"),
        (F.col("train_rows") / (2.0 * of_class)).alias("weight"), "train_rows",
    )


def fit_logistic(points: DataFrame) -> DataFrame:
    """symbol, beta and the largest entry of the gradient: balanced classes, unit penalty on the summed loss, scaled inputs."""
    train = points.where("part = 'train'").select("symbol", F.col("scaled").alias("x"), "label", "weight")
    return logistic.fit(train, ["symbol"], len(CLASSIFIER_COLUMNS))


def probabilities(points: DataFrame, models: Sequence[str] = tuple(LEARNED)) -> DataFrame:
    """Chance of an up move on every test row, per symbol and model; ``points`` should be a written table."""
    if unknown := set(models) - set(LEARNED):
        raise ValueError(f"unknown classifiers {sorted(unknown)}")
    test = points.where("part = 'test'")
    made = []
    grown = [m for m in models if m != "ml_logreg"]
    if grown:
        fitted = trees.fit(points.where("part = 'train'"), grown, SEED)
        made.append(trees.scored(test, staged(fitted)))
    if "ml_logreg" in models:
        scored = test.join(fit_logistic(points), "symbol")
        up = 1 / (1 + F.exp(-logistic.margin(F.col("scaled"), F.col("beta"), len(CLASSIFIER_COLUMNS))))
        made.append(scored.select("symbol", "idx", "date", up.alias("up"), F.lit("ml_logreg").alias("model")))
    return reduce(DataFrame.unionByName, made)


def signal_from(up: Column) -> Column:
    """Long above 0.55, short below 0.45, else flat."""
    return F.when(up > 0.55, 1.0).when(up < 0.45, -1.0).otherwise(0.0)


def learned_signals(bars: DataFrame, models: Sequence[str] = tuple(LEARNED), **split) -> DataFrame:
    """One column per classifier; bars that were not tested, and symbols that cannot be fitted, are 0."""
    rows = staged(split_rows(bars, **split))
    symbols = sized(fittable(rows))
    scored = probabilities(staged(with_points(rows, symbols)), models)
    wide = scored.groupBy("symbol", "idx").pivot("model", list(models)).agg(F.first(signal_from(F.col("up"))))
    out = bars.select("symbol", "idx", "date").join(wide, ["symbol", "idx"], "left")
    return out.fillna(0.0, subset=list(models))
