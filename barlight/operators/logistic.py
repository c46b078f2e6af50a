"""Penalised logistic regression for many keys at once, by Newton steps.

A step is one job for all keys: every row meets the small table of its key's candidate, and the loss, its gradient and its Hessian
are summed before the shuffle, so a key with most of the rows costs no task more than the others. What comes back is
one row for each key, on which the next candidate is found. Keys whose gradient vanishes stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from barlight.session import staged


def _state(dims: int) -> pa.Schema:
    vector = pa.list_(pa.float64())
    return pa.schema([("base", vector), ("value", pa.float64()), ("step", vector), ("size", pa.float64()), ("slope", pa.float64()), ("off", pa.float64())])


STATE_SQL = "base array<double>, value double, step array<double>, size double, slope double, off double"


def margin(x: Column, beta: Column, dims: int) -> Column:
    """Intercept (the last entry of beta) and weighted inputs."""
    return sum((x[j] * beta[j] for j in range(dims)), beta[dims])


def looked_at(points: DataFrame, candidates: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """Per key: loss, gradient and upper triangle of the Hessian of the summed loss at the candidate, without the penalty."""
    rows = points.join(candidates.select(*keys, F.zip_with("base", "step", lambda b, s: b - s * F.col("size")).alias("beta")), list(keys))
    rows = rows.withColumn("m", margin(F.col("x"), F.col("beta"), dims)).withColumn("up", 1 / (1 + F.exp(-F.col("m"))))
    # log(1 + exp(m)) - y m, without overflow.
    loss = F.greatest(F.col("m"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("m"))) - F.col("label") * F.col("m")
    pull = F.col("weight") * (F.col("up") - F.col("label"))
    bend = F.col("weight") * F.col("up") * (1 - F.col("up"))
    inputs = [F.col("x")[j] for j in range(dims)] + [F.lit(1.0)]
    pairs = [(i, j) for i in range(dims + 1) for j in range(i, dims + 1)]
    sums = rows.groupBy(*keys).agg(
        F.sum(F.col("weight") * loss).alias("loss"),
        F.array(*[F.sum(pull * v) for v in inputs]).alias("gradient"),
        F.array(*[F.sum(bend * inputs[i] * inputs[j]) for i, j in pairs]).alias("bends"),
    )
    return candidates.join(sums, list(keys))


def _advanced(base, value, step, size, slope, loss, gradient, bends, penalty: np.ndarray, dims: int) -> tuple:
    """The next candidate of one key: Newton's step from a point that was good enough, else a shorter step from the last one."""
    beta = np.asarray(base) - size * np.asarray(step)
    now = loss + 0.5 * float(penalty @ beta**2)
    if now > value - 1e-4 * size * slope + 1e-12 * abs(now) and size > 1e-10:
        return base, value, step, size / 2, slope, np.inf
    full = np.zeros((dims + 1, dims + 1))
    full[np.triu_indices(dims + 1)] = bends
    hessian = full + np.triu(full, 1).T + np.diag(penalty)
    down = np.asarray(gradient) + penalty * beta
    newton = np.linalg.lstsq(hessian, down, rcond=None)[0]
    return beta.tolist(), now, newton.tolist(), 1.0, float(down @ newton), float(np.abs(down).max())


def fit(points: DataFrame, keys: Sequence[str], dims: int, penalty: float = 1.0, tolerance: float = 1e-9, max_iter: int = 500) -> DataFrame:
    """keys, beta (inputs, then intercept) and the largest entry of the gradient there.

    points holds the keys, x (array of dims numbers), label (0 or 1) and weight, and should be a written table: it is read once for each
    step. The loss is the weighted sum of log losses plus half the penalty times the squared inputs' weights; the intercept is free.
    Steps end when every key's gradient is within tolerance of its summed weight; a key without rows is not there.
    """
    ridge = np.append(np.full(dims, penalty), 0.0)
    zeros = F.array(*[F.lit(0.0)] * (dims + 1))
    points = points.select(*keys, "x", "label", "weight")
    state = points.groupBy(*keys).agg(F.sum("weight").alias("total")).select(
        *keys, "total", zeros.alias("base"), F.lit(float("inf")).alias("value"), zeros.alias("step"), F.lit(1.0).alias("size"), F.lit(0.0).alias("slope"), F.lit(float("inf")).alias("off")
    )
    state = staged(state)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in state.select(*keys).schema), "total double", STATE_SQL])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["base", "value", "step", "size", "slope", "loss", "gradient", "bends"]).to_pylist()
            after = [_advanced(**r, penalty=ridge, dims=dims) for r in rows]
            columns = list(zip(*after, strict=True)) or [[]] * 6
            kept = [batch.column(c) for c in (*keys, "total")]
            made = [pa.array(list(c), f.type) for c, f in zip(columns, _state(dims), strict=True)]
            yield pa.RecordBatch.from_arrays(kept + made, names=[*keys, "total", *_state(dims).names])

    for _ in range(max_iter):
        seen = Observation()
        state = staged(looked_at(points, state, keys, dims).mapInArrow(advance, schema).observe(seen, F.max(F.col("off") / F.col("total")).alias("off")))
        if (seen.get["off"] or 0.0) <= tolerance:
            break
    return state.select(*keys, F.col("base").alias("beta"), F.col("off").alias("gradient"))
