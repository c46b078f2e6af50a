"""Forests and boosted trees for many keys at once.

The rule of the method thins a key's train rows to a stated number (50,000 by default), so the rows of one fit are bounded,
whatever the size of the key. A fit is one group of a grouped map: a key's boosting, or some trees of its forest. The fitted trees are rows of
arrays; rows to score are cut into blocks of bars, and each block meets its key's trees in a co-group, so a
key with most of the rows is scored by many tasks.

Trees are arrays in heap order: node i has the children 2 i + 1 (input <= threshold) and 2 i + 2; a leaf has feature -1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOREST = dict(trees=80, depth=6, least_rows=50)
BOOSTING = dict(trees=80, depth=2, rate=0.05)
CHUNK = 10  # trees of a forest that one task grows
BLOCK_ROWS = 65_536  # bars that one task scores together
TREES = "symbol string, model string, tree int, feature array<int>, threshold array<double>, value array<double>, rows array<long>"
SCORES = "symbol string, idx long, date timestamp_ntz, up double, model string"


class Ranked:
    """Inputs as ranks of their distinct values, so that a node's rows are put in order by sorting small integers."""

    def __init__(self, x: np.ndarray):
        self.levels, ranks = [], []
        for column in x.T:
            levels, rank = np.unique(column, return_inverse=True)
            self.levels.append(levels)
            ranks.append(rank.astype(np.uint16 if len(levels) <= 1 << 16 else np.uint32))
        self.ranks = ranks

    def split(self, feature: int, rows: np.ndarray, target: np.ndarray, weight: np.ndarray, least_rows: int) -> tuple[float, float] | None:
        """Best threshold of one input and its gain (squared sums over weights, before the node's own); None if no cut is allowed."""
        rank = self.ranks[feature][rows]
        order = np.argsort(rank, kind="stable")
        rank, own = rank[order], rows[order]
        n, sums, weights = len(rows), np.cumsum(weight[own] * target[own]), np.cumsum(weight[own])
        cut = np.flatnonzero(rank[1:] != rank[:-1])
        cut = cut[(cut + 1 >= least_rows) & (n - cut - 1 >= least_rows)]
        if not len(cut):
            return None
        gain = sums[cut] ** 2 / weights[cut] + (sums[-1] - sums[cut]) ** 2 / (weights[-1] - weights[cut])
        best = int(gain.argmax())
        low, high = self.levels[feature][rank[cut[best]]], self.levels[feature][rank[cut[best] + 1]]
        middle = (low + high) / 2
        return float(gain[best]), float(middle if middle < high else low)


def grown(x: np.ndarray, ranked: Ranked, target: np.ndarray, weight: np.ndarray, depth: int, least_rows: int = 1, draw=None, tried: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature and threshold of every node, and the leaf of every row (-1 for rows of weight 0).

    A node is cut where the weighted squared error of the target falls most, unless its rows are alike; the first of equal cuts
    counts. draw gives a node's order of inputs, of which `tried` that aren't constant there are looked at (all, without it).
    """
    size = (1 << (depth + 1)) - 1
    feature, threshold, leaf = np.full(size, -1, np.int32), np.zeros(size), np.full(len(x), -1, np.int64)
    nodes = {0: np.flatnonzero(weight > 0)}
    for node in range(size):
        rows = nodes.pop(node, None)
        if rows is None or not len(rows):
            continue
        leaf[rows] = node
        t = target[rows]
        if 2 * node + 2 >= size or t.max() - t.min() <= 1e-8:
            continue
        best, seen = None, 0
        for f in range(x.shape[1]) if draw is None else draw():
            rank = ranked.ranks[f][rows]
            if rank.min() == rank.max():
                continue
            found = ranked.split(f, rows, target, weight, least_rows)
            if found is not None and (best is None or found[0] > best[0]):
                best = (*found, f)
            seen += 1
            if seen == tried:
                break
        if best is None:
            continue
        feature[node], threshold[node] = best[2], best[1]
        low = x[rows, best[2]] <= best[1]
        nodes[2 * node + 1], nodes[2 * node + 2] = rows[low], rows[~low]
    return feature, threshold, leaf


def forest(x: np.ndarray, y: np.ndarray, trees: range, seed: int, key: str, depth: int, least_rows: int) -> Iterator[tuple]:
    """Trees on draws with repeats, the square root of the number of inputs tried at each node; a leaf's value is its share of ups."""
    ranked, tried = Ranked(x), max(1, int(np.sqrt(x.shape[1])))
    for tree in trees:
        rng = np.random.default_rng([seed, zlib.crc32(key.encode()), tree])
        weight = np.bincount(rng.integers(0, len(x), len(x)), minlength=len(x)).astype(float)
        feature, threshold, leaf = grown(x, ranked, y, weight, depth, least_rows, lambda: rng.permutation(x.shape[1]), tried)
        own = leaf >= 0
        total = np.bincount(leaf[own], weights=weight[own], minlength=len(feature))
        ups = np.bincount(leaf[own], weights=(weight * y)[own], minlength=len(feature))
        yield tree, feature, threshold, np.divide(ups, total, out=np.zeros_like(ups), where=total > 0), np.bincount(leaf[own], minlength=len(feature))


def boosted(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float) -> Iterator[tuple]:
    """Log-odds of the share of ups (tree -1, a single leaf), then trees on what is left, each leaf one Newton step."""
    ranked = Ranked(x)
    base = float(np.log(y.mean() / (1 - y.mean())))
    size = (1 << (depth + 1)) - 1
    score, one = np.full(len(x), base), np.ones(len(x))
    empty = np.full(size, -1, np.int32), np.zeros(size)
    yield -1, *empty, np.append(base, np.zeros(size - 1)), np.append(len(x), np.zeros(size - 1, np.int64))
    for tree in range(trees):
        up = 1 / (1 + np.exp(-score))
        left = y - up
        feature, threshold, leaf = grown(x, ranked, left, one, depth)
        top = np.bincount(leaf, weights=left, minlength=size)
        bend = np.bincount(leaf, weights=up * (1 - up), minlength=size)
        value = rate * np.divide(top, bend, out=np.zeros(size), where=bend > 1e-150)
        score = score + value[leaf]
        yield tree, feature, threshold, value, np.bincount(leaf, minlength=size)


def leaves(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The leaf each row ends in."""
    node = np.zeros(len(x), np.int64)
    while True:
        f = feature[node]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return node
        node[inner] = 2 * node[inner] + np.where(x[inner, f[inner]] <= threshold[node[inner]], 1, 2)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def fit(train: DataFrame, models: list[str], seed: int) -> DataFrame:
    """The trees of every symbol and model: forests are ml_rf, boosting is ml_gbrt.

    train: symbol, idx, label and raw (array of inputs), at most the stated number of rows for each symbol. `rows` counts a leaf's train rows.
    """
    tasks = []
    if "ml_rf" in models:
        tasks += [("ml_rf", at) for at in range(0, FOREST["trees"], CHUNK)]
    if "ml_gbrt" in models:
        tasks.append(("ml_gbrt", 0))
    task = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(at).alias("first")) for m, at in tasks])).alias("task")
    rows = train.select("symbol", "idx", "label", "raw", task).select("symbol", "task.model", "task.first", "idx", "label", "raw")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        symbol, model, first = (table.column(c)[0].as_py() for c in ("symbol", "model", "first"))
        x, y = _matrix(table.column("raw")), table.column("label").to_numpy().astype(float)
        if model == "ml_rf":
            made = list(forest(x, y, range(first, min(first + CHUNK, FOREST["trees"])), seed, symbol, FOREST["depth"], FOREST["least_rows"]))
        else:
            made = list(boosted(x, y, **BOOSTING))
        tree, *arrays = zip(*made, strict=True)
        kinds = pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())
        columns = [pa.array([symbol] * len(tree)), pa.array([model] * len(tree)), pa.array(tree, pa.int32()), *(pa.array([list(v) for v in a], k) for a, k in zip(arrays, kinds, strict=True))]
        return pa.Table.from_arrays(columns, names=["symbol", "model", "tree", "feature", "threshold", "value", "rows"])

    return rows.groupBy("symbol", "model", "first").applyInArrow(run, TREES)


def scored(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """Chance of an up move on every row (symbol, idx, date, raw) under every model of its symbol.

    A forest gives the mean of its trees' values, boosting the logistic of their sum.
    """
    block = F.floor(F.col("idx") / BLOCK_ROWS)
    rows = rows.select("symbol", block.alias("block"), "idx", "date", "raw")
    # One row for each symbol and block of rows.
    blocks = rows.select("symbol", "block").distinct().toDF("symbol", "cell")
    sent = trees.select("symbol", "model", "tree", "feature", "threshold", "value").join(blocks, "symbol")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x = _matrix(left.column("raw")) if left.num_rows else np.zeros((0, 1))
        out = []
        for model in sorted(set(right.column("model").to_pylist())) if left.num_rows else []:
            total, count = np.zeros(len(x)), 0
            for t in right.filter(pc.equal(right.column("model"), model)).sort_by("tree").to_pylist():
                total += np.array(t["value"])[leaves(x, np.array(t["feature"]), np.array(t["threshold"]))]
                count += 1
            up = total / count if model == "ml_rf" else 1 / (1 + np.exp(-total))
            out.append(pa.Table.from_arrays([left.column("symbol"), left.column("idx"), left.column("date"), pa.array(up), pa.array([model] * len(x))], names=["symbol", "idx", "date", "up", "model"]))
        return pa.concat_tables(out) if out else pa.table({"symbol": pa.array([], pa.string()), "idx": pa.array([], pa.int64()), "date": pa.array([], pa.timestamp("us")), "up": pa.array([], pa.float64()), "model": pa.array([], pa.string())})

    return rows.groupBy("symbol", "block").cogroup(sent.groupBy("symbol", "cell")).applyInArrow(run, SCORES)
