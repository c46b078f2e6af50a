"""Regime detection: all feature families and model families compete, keyed by symbol."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.operators import features as fx
from barlight.operators import hmm, kmeans
from barlight.operators import regimes as rg
from barlight.operators import walkforward as wf
from barlight.operators.ordered import with_ordinal
from barlight.session import sized, staged

KMEANS, HMM = "kmeans_quadrant", "gaussian_hmm_quadrant"
MODEL = ["symbol", "candidate"]
FAMILY = [*MODEL, "model_family"]
SEED = 181
DIMS = max(len(c) for c in fx.COLUMNS.values())
_AXES_FIRST = {name: rg.AXES + [c for c in cols if c not in rg.AXES] for name, cols in fx.COLUMNS.items()}
AXES = (0, 1)  # places of the two axes in every point


@dataclass
class Detection:
    """Labels of the chosen models and everything known about the choice."""

    labels: DataFrame
    features: dict[str, DataFrame]
    scores: DataFrame
    stats: DataFrame
    transitions: DataFrame
    stability: DataFrame
    skipped: DataFrame | None = None
    blocks: DataFrame | None = None


def prepared(bars: DataFrame, candidates: Sequence[str] = tuple(fx.COLUMNS), short: int = fx.SHORT, long: int = fx.LONG) -> dict[str, DataFrame]:
    """Complete rows of each feature family, written once."""
    made = fx.candidate_features(bars, short, long)
    return {
        name: staged(rg.complete_rows(made[name], _AXES_FIRST[name]).withColumn("candidate", F.lit(name)))
        for name in candidates
    }


def _padded(columns: Sequence[str]) -> Column:
    return F.concat("z", F.array_repeat(F.lit(0.0), DIMS - len(columns)))


def points(rows: dict[str, DataFrame]) -> DataFrame:
    """All families in one table of points; shorter ones are filled with zeros, which add no distance."""
    out = None
    for name, frame in rows.items():
        columns = _AXES_FIRST[name]
        scaled = rg.standardised(frame, columns, sized(rg.scaling(frame, columns, MODEL)), MODEL)
        part = scaled.select(*MODEL, "idx", "date", "pos", *rg.AXES, _padded(columns).alias("z"))
        out = part if out is None else out.unionByName(part)
    return staged(out)


def clusters(train: DataFrame, keys: Sequence[str], starts: int, seed: int) -> DataFrame:
    """K-Means centers per key; both model families start from them."""
    return staged(kmeans.fit(train, list(keys), DIMS, AXES, starts, seed))


def fitted_labels(
    train: DataFrame, test: DataFrame | None, centers: DataFrame, keys: Sequence[str], family: str, hmm_steps: int
) -> DataFrame:
    """Fit on train, label test (train when none is given).

    Keys whose train rows do not fall in four clusters are left out.
    """
    keys = list(keys)
    target = train if test is None else test
    if family == KMEANS:
        mapping = sized(rg.quadrants(rg.axis_stats(rg.assigned(train, centers, keys), keys), keys))
        return staged(rg.with_regimes(rg.assigned(target, centers, keys), mapping, keys))
    model = staged(hmm.fit(train, centers, keys, DIMS, hmm_steps))
    fitted = staged(hmm.decode(train, model, keys, DIMS))
    mapping = staged(rg.quadrants(rg.axis_stats(fitted, keys), keys))
    decoded = fitted if test is None else hmm.decode(test, model, keys, DIMS)
    regimes_by_state = mapping.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("raw", "regime_id"))), lambda m: m["regime_id"]).alias("_regimes")
    )
    rows = rg.with_regimes(decoded, mapping, keys).join(regimes_by_state, keys)
    folded = rg.folded_posteriors(F.col("posterior"), F.col("_regimes"))
    return staged(rows.withColumn("posterior", folded).drop("_regimes"))


def _chosen(frame: DataFrame, best: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frame.join(best.select(*keys), list(keys), "left_semi")


def _stats(rows: dict[str, DataFrame], labelled: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Regime stats of the chosen models; columns of other families are null."""
    out = None
    for name, frame in rows.items():
        columns = [c for c in fx.COLUMNS[name]]
        named = labelled.where(F.col("candidate") == name).select(*MODEL, "idx", "regime_id")
        part = rg.regime_stats(frame.join(named, [*MODEL, "idx"]), columns, keys)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def detect(
    bars: DataFrame,
    short: int = fx.SHORT,
    long: int = fx.LONG,
    stability_window: int = 2_000,
    starts: int = 20,
    seed: int = SEED,
    candidates: Sequence[str] = tuple(fx.COLUMNS),
) -> Detection:
    """Production detector: K-Means on four feature families, the best score labels the symbol."""
    rows = prepared(bars, candidates, short, long)
    table = points(rows)
    centers = clusters(table, MODEL, starts, seed)
    labelled = fitted_labels(table, None, centers, MODEL, KMEANS, 0)
    scores = rg.candidate_scores(labelled, MODEL, stability_window).join(centers.select(*MODEL, "inertia"), MODEL)
    ranked = staged(rg.best_model(scores, "score"))
    best = staged(_chosen(labelled, ranked.where("is_best"), MODEL))
    tried = bars.select("symbol").distinct().withColumn("candidate", F.explode(F.array(*[F.lit(c) for c in candidates])))
    reason = F.lit("insufficient usable feature rows or columns").alias("reason")
    return Detection(
        labels=rg.label_table(best, F.col("candidate")),
        features=rows,
        scores=ranked,
        stats=_stats(rows, best),
        transitions=rg.transitions(best),
        stability=rg.stability(best, stability_window),
        skipped=tried.join(ranked.select(*MODEL), MODEL, "left_anti").select(*MODEL, reason),
    )


def hmm_status(detection: Detection, starts: int = 20, seed: int = SEED, steps: int = 100) -> DataFrame:
    """Log-likelihood of a hidden Markov model on the chosen features; labels are not touched."""
    best = detection.scores.where("is_best").select(*MODEL)
    rows = staged(points(detection.features).join(best, MODEL, "left_semi"))
    centers = staged(kmeans.fit(rows, MODEL, DIMS, AXES, starts, seed))
    return hmm.likelihoods(rows, hmm.fit(rows, centers, MODEL, DIMS, steps), MODEL, DIMS)


def families(include_hmm: bool) -> list[str]:
    return [KMEANS, HMM] if include_hmm else [KMEANS]


def detect_dev(
    bars: DataFrame,
    short: int = fx.SHORT,
    long: int = fx.LONG,
    stability_window: int = 2_000,
    include_hmm: bool = True,
    starts: int = 20,
    seed: int = SEED,
    hmm_steps: int = 200,
    candidates: Sequence[str] = tuple(fx.COLUMNS),
    model_families: Sequence[str] | None = None,
) -> Detection:
    """Development detector: feature families x model families, by the development score."""
    rows = prepared(bars, candidates, short, long)
    table = points(rows)
    centers = clusters(table, MODEL, starts, seed)
    labelled = None
    for family in model_families or families(include_hmm):
        part = fitted_labels(table, None, centers, MODEL, family, hmm_steps)
        part = part.select(*MODEL, "idx", "date", "pos", *rg.AXES, "z", "regime_id", "regime_name").withColumn("model_family", F.lit(family))
        labelled = part if labelled is None else labelled.unionByName(part)
    labelled = staged(labelled)
    model_id = F.concat_ws("::", "candidate", "model_family")
    scores = rg.candidate_scores(labelled, FAMILY, stability_window).withColumn("model_id", model_id)
    ranked = staged(rg.best_model(scores, "dev_score", model="model_id"))
    best = staged(_chosen(labelled, ranked.where("is_best"), FAMILY))
    return Detection(
        labels=rg.label_table(best, model_id),
        features=rows,
        scores=ranked,
        stats=_stats(rows, best),
        transitions=rg.transitions(best),
        stability=rg.stability(best, stability_window),
    )


def materialise(bars: DataFrame, candidate: str, family: str, **options) -> Detection:
    """Fit, score and label one named model."""
    return detect_dev(bars, candidates=[candidate], model_families=[family], **options)


def detect_walk_forward(
    bars: DataFrame,
    plan: wf.WalkForward,
    short: int = fx.SHORT,
    long: int = fx.LONG,
    stability_window: int = 2_000,
    include_hmm: bool = True,
    starts: int = 20,
    seed: int = SEED,
    hmm_steps: int = 200,
    candidates: Sequence[str] = tuple(fx.COLUMNS),
    model_families: Sequence[str] | None = None,
) -> Detection:
    """Fit on train and label test in every block; the best mean block score labels the symbol.

    Which columns and rows are usable is decided on the whole history, a mild look-ahead
    that is kept on purpose. Blocks, families and symbols are keys of the same jobs.
    """
    rows = prepared(bars, candidates, short, long)
    counts = staged(wf.bar_counts(bars))
    keys = [*MODEL, "block"]
    trains, tests, sizes = None, None, None
    for name, frame in rows.items():
        columns = _AXES_FIRST[name]
        train, test, valid = wf.scaled_sides(frame, columns, counts, plan, keys)
        cut = [*keys, "idx", "date", "pos", *rg.AXES]
        train, test = (side.select(*cut, _padded(columns).alias("z")) for side in (train, test))
        trains = train if trains is None else trains.unionByName(train)
        tests = test if tests is None else tests.unionByName(test)
        sizes = valid if sizes is None else sizes.unionByName(valid)
    sizes = staged(sizes)
    trains, tests = staged(trains), staged(tests)
    centers = clusters(trains, keys, starts, seed)
    labelled = None
    for family in model_families or families(include_hmm):
        part = fitted_labels(trains, tests, centers, keys, family, hmm_steps)
        part = part.withColumn("model_family", F.lit(family))
        if "posterior" not in part.columns:
            one_hot = F.array(*[F.when(F.col("regime_id") == k, 1.0).otherwise(0.0) for k in range(rg.STATES)])
            part = part.withColumn("posterior", one_hot)
        part = part.select(*keys, "model_family", "idx", "date", *rg.AXES, "z", "regime_id", "regime_name", "posterior")
        labelled = part if labelled is None else labelled.unionByName(part)
    labelled = staged(labelled)
    block_keys = [*FAMILY, "block"]
    blocks = staged(wf.block_scores(labelled, block_keys).join(sizes, keys))
    tried = bars.select("symbol").distinct()
    tried = tried.withColumn("candidate", F.explode(F.array(*[F.lit(c) for c in candidates])))
    used = list(model_families or families(include_hmm))
    tried = tried.withColumn("model_family", F.explode(F.array(*[F.lit(f) for f in used])))
    model_id = F.concat_ws("::", "candidate", "model_family")
    usable = None
    for frame in rows.values():
        part = frame.select("symbol", "candidate").distinct()
        usable = part if usable is None else usable.unionByName(part)
    ranking = wf.rank_models(blocks, tried, FAMILY, sizes, usable).withColumn("model_id", model_id)
    ranked = staged(rg.best_model(ranking.withColumn("_s", F.coalesce("oos_score_mean", F.lit(-1.0))), "_s", model="model_id").drop("_s"))
    best = staged(_chosen(labelled, ranked.where(F.col("is_best") & (F.col("status") == "ok")), FAMILY))
    label_rows = rg.label_table(best, F.concat(model_id, F.lit("::wf")), ("symbol", "block"), F.col("posterior"))
    ordered = with_ordinal(best, ("symbol",), ("date", "block"), out="pos")
    return Detection(
        labels=wf.with_ranges(label_rows, wf.slices(counts, plan)),
        features=rows,
        scores=ranked,
        stats=_stats(rows, best),
        transitions=rg.transitions(ordered, order="pos"),
        stability=rg.stability(ordered, stability_window),
        blocks=blocks,
    )


def train_labels(
    bars: DataFrame, detection: Detection, plan: wf.WalkForward, starts: int = 20, seed: int = SEED, hmm_steps: int = 200
) -> DataFrame:
    """Labels of the train rows by each block's own chosen model, for the train-learned filter."""
    counts = staged(wf.bar_counts(bars))
    keys = [*MODEL, "block"]
    best = detection.scores.where(F.col("is_best") & (F.col("status") == "ok")).select(*FAMILY)
    out = None
    for family in [r[0] for r in best.select("model_family").distinct().collect()]:
        table = None
        wanted = best.where(F.col("model_family") == family).select(*MODEL)
        for name, frame in detection.features.items():
            columns = _AXES_FIRST[name]
            train, _, _ = wf.scaled_sides(frame.join(wanted, MODEL, "left_semi"), columns, counts, plan, keys)
            part = train.select(*keys, "idx", "date", "pos", *rg.AXES, _padded(columns).alias("z"))
            table = part if table is None else table.unionByName(part)
        table = staged(table)
        part = fitted_labels(table, None, clusters(table, keys, starts, seed), keys, family, hmm_steps)
        part = part.select("symbol", "block", "idx", "date", "regime_id", "regime_name")
        out = part if out is None else out.unionByName(part)
    return out
