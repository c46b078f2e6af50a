"""Resampled return paths: one row per path, each of its steps drawn from a hash of its key.

A draw depends only on the seed and the cell, so paths do not change with the
partitioning of the input or when a lost task is run again. A path is an array of the horizon's length: draws, wealth and
drawdown are made inside its row. Returns that are taken from a pool are looked up in pieces of ``CHUNK`` consecutive
ones, one row for each piece a path draws from, not one for each step. Equity comes as a row for each step, or, for what
is asked of all steps, as a row for each ``PIECE`` of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlight.functions.scalar import fast_uniform, uniforms
from barlight.functions.scalar import uniform as text_uniform
from barlight.operators.ordered import Blocks, forward_fill, with_ordinal
from barlight.schema import CAPITAL, STRESS_MODELS
from barlight.session import sized, staged

SCENARIO = ["symbol", "strategy", "regime_filter", "stress_model"]
PATH = [*SCENARIO, "simulation"]
PERCENTILES = [0.05, 0.5, 0.95]
CHUNK = 4_096  # consecutive returns of a pool in one row
PIECE = 64  # consecutive steps of a path in one row


def dated_regimes(returns: DataFrame, labels: DataFrame) -> DataFrame:
    """Every return date of a symbol once, with its label filled forward; ``idx`` counts the dates."""
    dates = with_ordinal(returns.select("symbol", "date").distinct())
    named = labels.groupBy("symbol", "date").agg(
        F.min_by(F.struct("regime_id", "regime_name"), "idx").alias("_l")
    ).select("symbol", "date", "_l.*")
    rows = dates.join(named, ["symbol", "date"], "left")
    return forward_fill(rows, ["regime_id", "regime_name"], Blocks.of(rows))


def regime_filters(regimes: DataFrame, requested: Sequence[str] | None) -> DataFrame:
    """Wanted filters per symbol in order, once each: 'all', 'each' (every regime seen) or a name.

    Names not seen are left out; nothing left means 'all'.
    """
    seen = regimes.groupBy("symbol").agg(F.sort_array(F.collect_set("regime_name")).alias("seen"))
    parts = []
    for item in requested or ["all"]:
        if item == "each":
            parts.append(F.col("seen"))
        elif item == "all":
            parts.append(F.array(F.lit("all")))
        else:
            parts.append(F.array_intersect(F.array(F.lit(item)), "seen"))
    wanted = F.array_distinct(F.concat(*parts))
    wanted = F.when(F.size(wanted) > 0, wanted).otherwise(F.array(F.lit("all")))
    return seen.select("symbol", F.posexplode(wanted).alias("position", "regime_filter"))


def return_pools(returns: DataFrame, regimes: DataFrame | None) -> DataFrame:
    """Returns numbered inside each pool: all bars of a strategy, and the bars of each regime."""
    rows = returns.select("symbol", "strategy", "date", F.coalesce("return", F.lit(0.0)).alias("return"))
    if regimes is None:
        pools = F.array(F.lit("all"))
    else:
        rows = rows.join(regimes.select("symbol", "date", "regime_name"), ["symbol", "date"], "left")
        pools = F.when(F.col("regime_name").isNull(), F.array(F.lit("all"))).otherwise(
            F.array(F.lit("all"), F.col("regime_name"))
        )
    rows = rows.select("symbol", "strategy", "date", "return", F.explode(pools).alias("pool"))
    keys = ("symbol", "strategy", "pool")
    return with_ordinal(rows, keys, ("date",), out="ord").select(*keys, "ord", "return")


def scenarios(pools: DataFrame, filters: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per scenario with its pool's size, mean and deviation and the regime mix it draws from."""
    stats = pools.groupBy("symbol", "strategy", "pool").agg(
        F.count(F.lit(1)).alias("n"), F.avg("return").alias("mean"), F.stddev_pop("return").alias("deviation")
    )
    stats = staged(stats)
    mix = stats.where(F.col("pool") != "all").groupBy("symbol", "strategy").agg(
        F.sort_array(F.collect_list(F.struct("pool", "n"))).alias("mix")
    )
    rows = stats.withColumnRenamed("pool", "regime_filter").join(filters.select("symbol", "regime_filter"), ["symbol", "regime_filter"])
    rows = rows.join(mix, ["symbol", "strategy"], "left")
    own = F.filter("mix", lambda m: m["pool"] == F.col("regime_filter"))
    rows = rows.withColumn("mix", F.when(F.col("regime_filter") == "all", F.col("mix")).otherwise(own))
    return rows.withColumn("stress_model", F.explode(F.array(*[F.lit(m) for m in models])))


def grid(scenario_rows: DataFrame, simulations: int) -> DataFrame:
    """Every simulation of every scenario, dealt out evenly: with a given number of parts, as small rows would be put together again."""
    rows = scenario_rows.withColumn("simulation", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))))
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PATH)


def normal_return(mean: Column, deviation: Column, u1: Column, u2: Column) -> Column:
    """Normal draw from two uniform ones."""
    return mean + deviation * F.sqrt(-2.0 * F.ln(1.0 - u1)) * F.cos(2.0 * math.pi * u2)


def from_mixture() -> Column:
    """Whether a scenario's regimes are drawn; without regimes the mixture is the normal model."""
    return (F.col("stress_model") == "regime_mixture_gbm") & (F.coalesce(F.size("mix"), F.lit(0)) > 0)


def takes_bars() -> Column:
    return from_mixture() | (F.col("stress_model") == "block_bootstrap")


def many_draws(uniform: Callable[..., Column], numbers: Sequence[int], mark: str, count: Column, seed: int) -> Column:
    """A path's draws for the first ``count`` numbers."""
    key = [seed, *[F.col(c) for c in PATH]]
    if uniform is text_uniform:
        return uniforms(key, [f"{number}:{mark}" for number in numbers], count)
    texts = F.slice(F.array(*[F.lit(str(number)) for number in numbers]), F.lit(1), count)
    return F.transform(texts, lambda text: uniform(*key, text, mark))


def normal_paths(rows: DataFrame, horizon: int, seed: int, uniform: Callable[..., Column]) -> DataFrame:
    """PATH and returns of the paths of the normal model."""
    u1, u2 = (many_draws(uniform, range(1, horizon + 1), mark, F.lit(horizon), seed) for mark in "ab")
    drawn = rows.select(*PATH, "mean", "deviation", u1.alias("u1"), u2.alias("u2"))
    returns = F.zip_with("u1", "u2", lambda a, b: normal_return(F.col("mean"), F.col("deviation"), a, b))
    return drawn.select(*PATH, returns.alias("returns"))


def taken_bars(rows: DataFrame, horizon: int, seed: int, block: int, uniform: Callable[..., Column]) -> DataFrame:
    """The bars whose returns a path takes: a row for each pool and CHUNK of it, with the steps and the places in the chunk.

    The mixture draws a regime by its share of the bars, then one of its bars; the bootstrap draws the first bar of each block.
    """
    by_blocks = F.col("stress_model") == "block_bootstrap"
    size = F.greatest(F.lit(1), F.least(F.lit(block), F.col("n").cast("int")))
    blocks = F.when(by_blocks, F.ceil(F.lit(horizon) / size).cast("int")).otherwise(0)
    single = F.when(by_blocks, 0).otherwise(horizon)
    u1, u2 = (many_draws(uniform, range(1, horizon + 1), mark, single, seed) for mark in "ab")
    starts = many_draws(uniform, range(horizon), "s", blocks, seed)
    names = F.when(by_blocks, F.array("regime_filter")).otherwise(F.transform("mix", lambda m: m["pool"]))
    bars = F.when(by_blocks, F.array("n")).otherwise(F.transform("mix", lambda m: m["n"]))
    drawn = rows.select(*PATH, size.alias("size"), names.alias("names"), bars.alias("bars"), u1.alias("u1"), u2.alias("u2"), starts.alias("starts"))
    chunk, step = CHUNK, np.arange(horizon)

    def taken(size: int, bars: np.ndarray, u1: np.ndarray, u2: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the pool and ordinal of the bar, for each step."""
        if len(starts):
            first = np.floor(starts * (bars[0] - size + 1)).astype(np.int64)
            return np.zeros(horizon, np.int64), first[step // size] + step % size
        ends = np.cumsum(bars)
        pool = np.searchsorted(ends, np.floor(u1 * ends[-1]), side="right")
        return pool, np.floor(u2 * bars[pool]).astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            paths = batch[PATH].itertuples(index=False, name=None)
            for path, names, *rest in zip(paths, batch["names"], *[batch[c] for c in ("size", "bars", "u1", "u2", "starts")]):
                pool, place = taken(*rest)
                number = place // chunk
                for p, c in sorted(set(zip(pool.tolist(), number.tolist()))):
                    steps = np.flatnonzero((pool == p) & (number == c))
                    out.append((*path, names[p], c, steps, place[steps] % chunk))
            yield pd.DataFrame(out, columns=[*PATH, "pool", "chunk", "steps", "at"])

    kinds = [rows.schema[c] for c in PATH] + [T.StructField("pool", T.StringType()), T.StructField("chunk", T.LongType())]
    schema = T.StructType(kinds + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("steps", "at")])
    return drawn.mapInPandas(run, schema)


def chunked(pools: DataFrame) -> DataFrame:
    """Pools in rows of CHUNK consecutive returns."""
    keys = ["symbol", "strategy", "pool"]
    own = pools.groupBy(*keys, F.floor(F.col("ord") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("ord", "return"))).alias("_r"))
    return own.select(*keys, "chunk", F.transform("_r", lambda r: r["return"]).alias("held"))


def looked_up(taken: DataFrame, pools: DataFrame) -> DataFrame:
    """PATH and returns of paths given by the bars they take."""
    met = taken.join(sized(chunked(pools)), ["symbol", "strategy", "pool", "chunk"])
    found = met.select(*PATH, "steps", F.transform("at", lambda i: F.get("held", i)).alias("found"))
    # A path gathers its own steps, as many as the horizon; one that took all from one row has them in order.
    whole = found.groupBy(*PATH).agg(F.collect_list(F.struct("steps", "found")).alias("_p"))
    zipped = F.flatten(F.transform("_p", lambda p: F.arrays_zip(p["steps"].alias("step"), p["found"].alias("return"))))
    returns = F.when(F.size("_p") == 1, F.get("_p", F.lit(0))["found"]).otherwise(F.transform(F.array_sort(zipped), lambda f: f["return"]))
    return whole.select(*PATH, returns.alias("returns"))


def simulated_paths(
    pools: DataFrame,
    filters: DataFrame,
    simulations: int = 500,
    horizon: int = 390,
    block: int = 30,
    seed: int = 181,
    models: Sequence[str] = tuple(STRESS_MODELS),
    uniform: Callable[..., Column] = fast_uniform,
) -> DataFrame:
    """The returns of every simulation of every scenario, in order of their steps."""
    unknown = set(models) - set(STRESS_MODELS)
    if unknown:
        raise ValueError(f"unknown stress models: {sorted(unknown)}")
    rows = grid(scenarios(pools, filters, models), simulations)
    # Told apart by their model, before anything is drawn: a condition on what was drawn would draw it again.
    normal = normal_paths(rows.where(~takes_bars()), horizon, seed, uniform)
    return normal.unionByName(looked_up(taken_bars(rows.where(takes_bars()), horizon, seed, block, uniform), pools))


def simulated_returns(pools: DataFrame, filters: DataFrame, *args, **options) -> DataFrame:
    """One return per scenario, simulation and step; arguments are those of ``simulated_paths``."""
    paths = simulated_paths(pools, filters, *args, **options)
    return paths.select(*PATH, F.posexplode("returns").alias("step", "return")).withColumn("step", F.col("step") + 1)


def saved_paths(paths: DataFrame, keep: int = 50, capital: float = CAPITAL) -> DataFrame:
    """Equity along the first ``keep`` simulations of every scenario."""
    return equity_paths(paths.where(F.col("simulation") < keep), capital)


def equity_along(returns: Column, capital: float) -> Column:
    """Equity after each return of an array, multiplied up in their order."""

    def grown(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda r: capital * np.cumprod(1 + r))

    return F.pandas_udf(grown, T.ArrayType(T.DoubleType()))(returns)


def equity_pieces(paths: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Equity along every path, a row for each PIECE of steps: ``step`` is the first, ``equity`` an array."""
    rows = paths.select(*PATH, equity_along(F.col("returns"), capital).alias("_e"))
    rows = rows.select(*PATH, "_e", F.explode(F.sequence(F.lit(1), F.size("_e"), F.lit(PIECE))).alias("step"))
    return rows.select(*PATH, "step", F.slice("_e", F.col("step"), F.lit(PIECE)).alias("equity"))


def equity_paths(paths: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Equity along every path, a row for each step."""
    rows = paths.select(*PATH, "returns", equity_along(F.col("returns"), capital).alias("_e"))
    steps = F.arrays_zip(F.col("returns").alias("return"), F.col("_e").alias("equity"))
    rows = rows.select(*PATH, F.posexplode(steps).alias("step", "_s"))
    return rows.select(*PATH, (F.col("step") + 1).alias("step"), F.col("_s.return").alias("return"), F.col("_s.equity").alias("equity"))


def path_ends(paths: DataFrame) -> DataFrame:
    """Terminal return and worst fall from the path's own peak."""

    def end(returns: np.ndarray) -> tuple[float, float]:
        wealth = np.cumprod(1 + returns)
        peak = np.maximum(np.maximum.accumulate(wealth), 1e-12)
        return wealth[-1] - 1, min(0.0, (wealth / peak - 1).min())

    def ends(arrays: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([end(r) for r in arrays], columns=["terminal", "max_drawdown"])

    kind = T.StructType([T.StructField(c, T.DoubleType()) for c in ("terminal", "max_drawdown")])
    rows = paths.select(*PATH, F.size("returns").cast("long").alias("horizon"), F.pandas_udf(ends, kind)("returns").alias("_e"))
    return rows.select(*PATH, F.col("_e.terminal").alias("terminal"), F.col("_e.max_drawdown").alias("max_drawdown"), "horizon")


def summary(ends: DataFrame, capital: float = CAPITAL, drawdown_threshold: float = 0.20) -> DataFrame:
    """Terminal distribution, tail mean and risk shares per scenario.

    A scenario holds one row per simulation, a number set by the caller, so the built-in
    exact percentile is bounded.
    """
    equity = capital * (1 + F.col("terminal"))

    def share(condition: Column) -> Column:
        return F.avg(F.when(condition, 1.0).otherwise(0.0))

    ps = F.array(*[F.lit(p) for p in PERCENTILES])
    table = ends.groupBy(*SCENARIO).agg(
        F.count(F.lit(1)).alias("simulations"),
        F.max("horizon").alias("horizon"),
        F.avg("terminal").alias("terminal_mean"),
        F.stddev_pop("terminal").alias("terminal_std"),
        F.percentile("terminal", ps).alias("_t"),
        F.percentile(equity, ps).alias("_e"),
        F.percentile("max_drawdown", F.array(F.lit(0.5), F.lit(0.05))).alias("_d"),
        share(F.col("terminal") < 0).alias("probability_of_loss"),
        share(F.col("max_drawdown") <= -abs(drawdown_threshold)).alias("prob_drawdown_exceed"),
        share(equity <= capital * 0.5).alias("risk_of_ruin"),
    )
    tail = (
        ends.join(table.select(*SCENARIO, F.col("_t")[0].alias("_v")), SCENARIO)
        .groupBy(*SCENARIO)
        .agg(F.coalesce(F.avg(F.when(F.col("terminal") <= F.col("_v"), F.col("terminal"))), F.max("_v")).alias("terminal_cvar_95"))
    )
    return table.join(tail, SCENARIO).select(
        *SCENARIO, "simulations", "horizon", "terminal_mean", "terminal_std",
        *[F.col("_t")[i].alias(f"terminal_p{p}") for i, p in enumerate((5, 50, 95))],
        "terminal_cvar_95",
        *[F.col("_e")[i].alias(f"terminal_equity_p{p}") for i, p in enumerate((5, 50, 95))],
        F.col("_d")[0].alias("max_drawdown_p50"), F.col("_d")[1].alias("max_drawdown_p95"),
        "probability_of_loss", "prob_drawdown_exceed", "risk_of_ruin",
    )


@dataclass
class Stress:
    summary: DataFrame
    paths: DataFrame  # the first simulations, to look at
    equity: DataFrame  # all simulations, for distributions
    pieces: DataFrame  # the same, a row for each PIECE of steps


def run_stress(
    returns: DataFrame,
    labels: DataFrame | None = None,
    regime_requests: Sequence[str] | None = None,
    capital: float = CAPITAL,
    keep_paths: int = 50,
    drawdown_threshold: float = 0.20,
    **options,
) -> Stress:
    """All scenarios of all strategies. All simulations are summed up; only the first few are kept as paths."""
    if labels is None:
        regimes = None
        filters = returns.select("symbol").distinct().withColumn("regime_filter", F.lit("all"))
    else:
        regimes = staged(dated_regimes(returns, labels))
        filters = regime_filters(regimes, regime_requests)
    pools = staged(return_pools(returns, regimes))
    paths = staged(simulated_paths(pools, filters, **options))
    ends = staged(path_ends(paths))
    return Stress(
        summary(ends, capital, drawdown_threshold), saved_paths(paths, keep_paths, capital), equity_paths(paths, capital), equity_pieces(paths, capital)
    )
