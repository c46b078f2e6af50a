"""Four-state Gaussian hidden Markov models with diagonal covariance, many at once.

A model's rows are one unbroken sequence. It is cut into blocks of ``BLOCK_ROWS`` only to share out the work: the first pass
turns each block into a 4 x 4 matrix (what reaches its last row from its first, scaled, and the same for best paths); a scan
over the small table of matrices, one row for each block, gives every block the state distribution it is entered
with, the weight of what comes after it, and the state its best path ends in; the second pass works inside the blocks. The
result doesn't depend on the length of the blocks.

The expectation step returns sums per batch; the sums are added by Spark; the maximisation step works on one
row per model. The blocks are written once, bucketed by model and number; a step is one job that deals out only the
small tables to the buckets (a row of parameters for each model, one of matrices for each block), so points never move.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from barlight.operators.regimes import STATES
from barlight.session import bucketed, forget_bucketed, staged

BLOCK_ROWS = 2_048
BATCH_BLOCKS = 64  # blocks worked on together
COVARIANCE_PRIOR = 1e-2
PARAMETERS = "start array<double>, moves array<double>, means array<double>, spreads array<double>"


def blocks(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per block: its number, positions and points, in order, as one flat array."""
    rows = points.groupBy(*keys, F.floor(F.col("pos") / BLOCK_ROWS).alias("part")).agg(F.sort_array(F.collect_list(F.struct("pos", "z"))).alias("_s"))
    return rows.select(
        *keys, "part", F.transform("_s", lambda p: p["pos"]).alias("positions"), F.flatten(F.transform("_s", lambda p: p["z"])).alias("points")
    )


def settled(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The blocks, written in buckets that joins with a row for each block keep to."""
    return bucketed(blocks(points, keys), *keys, "part")


def first_parameters(centers: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """Cluster centers as means, unit spreads, every start and move equally likely."""
    even = F.lit(1.0 / STATES)
    return centers.select(
        *keys,
        F.array_repeat(even, STATES).alias("start"),
        F.array_repeat(even, STATES * STATES).alias("moves"),
        F.flatten("centers").alias("means"),
        F.array_repeat(F.lit(1.0), STATES * dims).alias("spreads"),
    )


def _padded(pdf: pd.DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of all blocks as (block, time, dimension), and which cells are real."""
    lengths = np.array([len(p) for p in pdf["positions"]])
    x = np.zeros((len(pdf), lengths.max(), dims))
    for i, flat in enumerate(pdf["points"]):
        x[i, : lengths[i]] = np.asarray(flat).reshape(-1, dims)
    return x, np.arange(x.shape[1]) < lengths[:, None]


def _model(pdf: pd.DataFrame, dims: int) -> tuple[np.ndarray, ...]:
    first = pdf.iloc[0]
    start = np.asarray(first["start"], dtype=float)
    moves = np.asarray(first["moves"], dtype=float).reshape(STATES, STATES)
    means = np.asarray(first["means"], dtype=float).reshape(STATES, dims)
    spreads = np.asarray(first["spreads"], dtype=float).reshape(STATES, dims)
    return start, moves, means, spreads


def _log_density(x: np.ndarray, means: np.ndarray, spreads: np.ndarray) -> np.ndarray:
    out = np.empty((*x.shape[:2], STATES))
    for k in range(STATES):
        gap = (x - means[k]) ** 2 / spreads[k]
        out[..., k] = -0.5 * (gap.sum(axis=2) + np.log(2 * np.pi * spreads[k]).sum())
    return out


def _forward_backward(logs, real, entering, moves, before=None, after=None):
    """Posteriors, expected moves and log-likelihood of a batch of blocks, scaled per step.

    ``entering``: state distribution for the first rows; ``before``: that of the row in front of each block (rows of
    zeros where there is none); ``after``: weight of what follows each block, by the state of its last row.
    """
    top = np.where(real, logs.max(axis=2), 0.0)
    dens = np.where(real[..., None], np.exp(np.minimum(logs - top[..., None], 0.0)), 1.0)
    n, steps, _ = logs.shape
    ahead, scale = np.zeros_like(dens), np.ones((n, steps))
    for t in range(steps):
        a = entering * dens[:, 0] if t == 0 else (ahead[:, t - 1] @ moves) * dens[:, t]
        total = np.maximum(a.sum(axis=1), 1e-300)
        live = real[:, t]
        ahead[:, t] = np.where(live[:, None], a / total[:, None], ahead[:, t - 1] if t else a)
        scale[:, t] = np.where(live, total, 1.0)
    last = ahead[:, -1]
    weight = np.ones((n, STATES)) if after is None else np.asarray(after)
    back = np.ones_like(dens)
    back[:, -1] = weight / np.maximum((last * weight).sum(axis=1, keepdims=True), 1e-300)
    expected = np.zeros((STATES, STATES))
    for t in range(steps - 2, -1, -1):
        inside = real[:, t + 1][:, None]
        later = np.where(inside, dens[:, t + 1] * back[:, t + 1] / scale[:, t + 1, None], 0.0)
        back[:, t] = np.where(inside, later @ moves.T, back[:, t + 1])
        expected += moves * np.einsum("ni,nj->ij", ahead[:, t], later)
    if before is not None:
        expected += moves * np.einsum("ni,nj->ij", np.asarray(before), dens[:, 0] * back[:, 0] / scale[:, 0, None])
    posterior = ahead * back
    posterior /= np.maximum(posterior.sum(axis=2, keepdims=True), 1e-300)
    likelihood = ((np.log(scale) + top) * real).sum()
    return posterior * real[..., None], expected, likelihood


def _best_states(logs, real, entering, moves, last=None):
    """Most likely states of each block, given log scores (or probabilities) for its first row and the state of its last."""
    with np.errstate(divide="ignore"):
        log_moves = np.log(moves)
        log_entering = np.log(entering) if last is None else np.asarray(entering)
    n, steps, _ = logs.shape
    score = log_entering + logs[:, 0]
    came = np.zeros((n, steps, STATES), dtype=int)
    for t in range(1, steps):
        options = score[:, :, None] + log_moves
        moved = options.max(axis=1) + logs[:, t]
        live = real[:, t][:, None]
        came[:, t] = np.where(live, options.argmax(axis=1), np.arange(STATES))
        score = np.where(live, moved, score)
    path = np.zeros((n, steps), dtype=int)
    path[:, -1] = score.argmax(axis=1) if last is None else last
    for t in range(steps - 2, -1, -1):
        path[:, t] = came[np.arange(n), t + 1, path[:, t + 1]]
    return path


def _through(logs, real, moves):
    """From first to last row of each block: scaled sums over all paths, and log scores of the best, both (block, from, to)."""
    top = np.where(real, logs.max(axis=2), 0.0)
    dens = np.exp(np.minimum(logs - top[..., None], 0.0))
    with np.errstate(divide="ignore"):
        log_moves = np.log(moves)
    n, steps, _ = logs.shape
    sums = np.tile(np.eye(STATES), (n, 1, 1))
    with np.errstate(divide="ignore"):
        best = np.log(sums)
    for t in range(1, steps):
        live = real[:, t][:, None, None]
        moved = (sums @ moves) * dens[:, t][:, None, :]
        moved /= np.maximum(moved.max(axis=(1, 2), keepdims=True), 1e-300)
        sums = np.where(live, moved, sums)
        further = (best[:, :, :, None] + log_moves).max(axis=2) + logs[:, t][:, None, :]
        best = np.where(live, further, best)
    return dens[:, 0], logs[:, 0], sums, best


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(v.sum(), 1e-300)


def _linked(first, first_logs, sums, best, start, moves):
    """Scan over one model's blocks in order: entering, before, after, best scores at entry and end states."""
    with np.errstate(divide="ignore"):
        log_start, log_moves = np.log(start), np.log(moves)
    n = len(first)
    entering, before, after = np.zeros((n, STATES)), np.zeros((n, STATES)), np.ones((n, STATES))
    scores, ends = np.zeros((n, STATES)), np.zeros(n, dtype=int)
    state, score, at_end = None, None, np.zeros((n, STATES))
    for b in range(n):
        entering[b] = start if b == 0 else _unit(state @ moves)
        before[b] = 0.0 if b == 0 else state
        state = _unit((entering[b] * first[b]) @ sums[b])
        scores[b] = log_start if b == 0 else (score[:, None] + log_moves).max(axis=0)
        score = (scores[b] + first_logs[b])[:, None] + best[b]
        score = score.max(axis=0)
        score -= score.max()
        at_end[b] = score
    for b in range(n - 1, -1, -1):
        if b == n - 1:
            ends[b] = at_end[b].argmax()
        else:
            nxt = b + 1
            head = (scores[nxt] + first_logs[nxt] + best[nxt][:, ends[nxt]]).argmax()
            ends[b] = (at_end[b] + log_moves[:, head]).argmax()
            after[b] = _unit(moves @ (first[nxt] * (sums[nxt] @ after[nxt])))
    return entering, before, after, scores, ends


ENTRIES = "entering array<double>, before array<double>, after array<double>, scores array<double>, last int"


def _by_model(batch: pd.DataFrame, keys: list[str]):
    """Slices of a batch that belong to one model; padding is bounded by the number of blocks of a slice."""
    for key, pdf in batch.groupby(keys, sort=False):
        for at in range(0, len(pdf), BATCH_BLOCKS):
            yield key, pdf.iloc[at : at + BATCH_BLOCKS]


def entered(cut: DataFrame, params: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """How each block is entered and left, with its model: keys, part and the columns of PARAMETERS and ENTRIES."""
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    typed = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, pdf in _by_model(batch, keys):
                _, moves, means, spreads = _model(pdf, dims)
                x, real = _padded(pdf, dims)
                first, first_logs, sums, best = _through(_log_density(x, means, spreads), real, moves)
                frame = pd.DataFrame({"part": pdf["part"].to_numpy(), "matrix": [np.concatenate([a, b, c.ravel(), d.ravel()]) for a, b, c, d in zip(first, first_logs, sums, best)]})
                for name, value in zip(keys, key):
                    frame[name] = value
                yield frame[[*keys, "part", "matrix"]]

    # One row of parameters for each block goes to the block's bucket.
    dealt = cut.select(*keys, "part").join(params.select(*keys, "start", "moves", "means", "spreads"), keys).hint("shuffle_hash")
    matrices = cut.join(dealt, [*keys, "part"]).mapInPandas(kernel, f"{typed}, part bigint, matrix array<double>")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        rows = np.stack(pdf["matrix"].to_numpy())
        start, moves = (np.asarray(pdf.iloc[0][c], dtype=float) for c in ("start", "moves"))
        square = (len(rows), STATES, STATES)
        got = _linked(rows[:, :4], rows[:, 4:8], rows[:, 8:24].reshape(square), rows[:, 24:].reshape(square), start, moves.reshape(STATES, STATES))
        frame = pdf[[*keys, "part", "start", "moves", "means", "spreads"]].reset_index(drop=True)
        for name, value in zip(("entering", "before", "after", "scores"), got):
            frame[name] = list(value)
        frame["last"] = got[4]
        return frame

    # One row of 40 numbers for each block of BLOCK_ROWS rows.
    return matrices.join(params.select(*keys, "start", "moves", "means", "spreads"), keys).groupBy(*keys).applyInPandas(scan, f"{typed}, part bigint, {PARAMETERS}, {ENTRIES}")


def _with_entries(cut: DataFrame, params: DataFrame, keys: list[str], dims: int) -> DataFrame:
    # The hash table is of the entries, so the blocks are neither moved nor sorted.
    entries = entered(cut, params, keys, dims).hint("shuffle_hash")
    return cut.join(entries, [*keys, "part"])


def _stack(pdf: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in pdf[column]])


def expectation(cut: DataFrame, params: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """Summed statistics per model: one row with an array ``sums``."""
    keys = list(keys)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, pdf in _by_model(batch, keys):
                _, moves, means, spreads = _model(pdf, dims)
                x, real = _padded(pdf, dims)
                before = _stack(pdf, "before")
                post, expected, likelihood = _forward_backward(_log_density(x, means, spreads), real, _stack(pdf, "entering"), moves, before, _stack(pdf, "after"))
                opening = post[:, 0][before.sum(axis=1) == 0].sum(axis=0)
                mass = post.sum(axis=(0, 1))
                first = np.einsum("ntk,ntd->kd", post, x)
                second = np.einsum("ntk,ntd->kd", post, x * x)
                out.append((*key, np.concatenate([[likelihood], opening, expected.ravel(), mass, first.ravel(), second.ravel()])))
            yield pd.DataFrame(out, columns=[*keys, "parts"])

    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", parts array<double>"
    width = 1 + STATES + STATES * STATES + STATES + 2 * STATES * dims
    parts = _with_entries(cut, params, keys, dims).mapInPandas(kernel, schema)
    return parts.groupBy(*keys).agg(F.array(*[F.sum(F.col("parts")[i]) for i in range(width)]).alias("sums"))


def maximisation(stats: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """New parameters and the log-likelihood of the old ones; one small row per model."""
    keys = list(keys)

    def update(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cuts = np.cumsum([1, STATES, STATES * STATES, STATES, STATES * dims])
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                likelihood, start, moves, mass, first, second = np.split(np.asarray(row.sums, dtype=float), cuts)
                moves = moves.reshape(STATES, STATES)
                first, second = first.reshape(STATES, dims), second.reshape(STATES, dims)
                held = np.maximum(mass, 1e-10)[:, None]
                means = first / held
                spreads = (COVARIANCE_PRIOR + second - 2 * means * first + means**2 * mass[:, None]) / np.maximum(
                    mass[:, None], 1e-5
                )
                row_sums = moves.sum(axis=1, keepdims=True)
                moves = np.where(row_sums > 0, moves / np.maximum(row_sums, 1e-300), 1.0 / STATES)
                out.append(
                    (
                        *[getattr(row, k) for k in keys], start / max(start.sum(), 1e-300), moves.ravel(),
                        means.ravel(), np.maximum(spreads, 1e-6).ravel(), float(likelihood[0]),
                    )
                )
            names = [*keys, "start", "moves", "means", "spreads", "log_likelihood"]
            yield pd.DataFrame(out, columns=names)

    kinds = {f.name: f.dataType.simpleString() for f in stats.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {PARAMETERS}, log_likelihood double"
    return stats.mapInPandas(update, schema)


def fit(
    points: DataFrame, centers: DataFrame, keys: Sequence[str], dims: int, max_iter: int = 200, tolerance: float = 1e-2
) -> DataFrame:
    """Parameters and log-likelihood per key; stops when no key improves by more than the tolerance."""
    keys = list(keys)
    cut = settled(points, keys)
    params = staged(first_parameters(centers, keys, dims).withColumn("log_likelihood", F.lit(None).cast("double")))
    for _ in range(max_iter):
        before = params.select(*keys, F.col("log_likelihood").alias("_before"))
        after = maximisation(expectation(cut, params, keys, dims), keys, dims).join(before, keys)
        seen = Observation()
        after = staged(after.observe(seen, F.max(F.col("log_likelihood") - F.col("_before")).alias("gain"), F.count("_before").alias("known")).drop("_before"))
        params = after
        if seen.get["known"] and seen.get["gain"] <= tolerance:
            break
    forget_bucketed(cut)
    return params


def decode(points: DataFrame, params: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """Add ``raw``, the state on the most likely path, and ``posterior`` by state."""
    keys = list(keys)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, pdf in _by_model(batch, keys):
                _, moves, means, spreads = _model(pdf, dims)
                x, real = _padded(pdf, dims)
                logs = _log_density(x, means, spreads)
                post, _, _ = _forward_backward(logs, real, _stack(pdf, "entering"), moves, None, _stack(pdf, "after"))
                path = _best_states(logs, real, _stack(pdf, "scores"), moves, pdf["last"].to_numpy())
                frame = pd.DataFrame(
                    {"pos": np.concatenate(pdf["positions"].to_list()), "raw": path[real], "posterior": list(post[real])}
                )
                for name, value in zip(keys, key):
                    frame[name] = value
                yield frame[[*keys, "pos", "raw", "posterior"]]

    rows = _with_entries(settled(points, keys), params, keys, dims)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", pos long, raw int, posterior array<double>"
    return points.join(rows.mapInPandas(kernel, schema), [*keys, "pos"])


def likelihoods(points: DataFrame, params: DataFrame, keys: Sequence[str], dims: int) -> DataFrame:
    """Log-likelihood of the points per model, and the status text of the comparison."""
    stats = expectation(settled(points, keys), params.select(*keys, "start", "moves", "means", "spreads"), keys, dims)
    value = F.col("sums")[0]
    text = F.concat(F.lit("available_fit_success log_likelihood="), F.format_string("%.2f", value))
    return stats.select(*keys, value.alias("log_likelihood"), text.alias("hmm_status"))
