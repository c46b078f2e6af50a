import itertools

import numpy as np
import pytest

from barlight.operators import classify, trees
from barlight.session import staged

from helpers import bars_frame


def naive(x, t, w, rows, depth, least_rows):
    """Nested cuts by trying every threshold of every input: (input, threshold, below, above), or the rows of a leaf."""
    rows = np.array(rows)
    if not depth or t[rows].max() == t[rows].min():
        return sorted(rows.tolist())
    best = None
    for f in range(x.shape[1]):
        for low, high in itertools.pairwise(np.unique(x[rows, f])):
            below = x[rows, f] <= low
            if min(below.sum(), (~below).sum()) < least_rows:
                continue
            error = sum((w[r] * (t[r] - np.average(t[r], weights=w[r])) ** 2).sum() for r in (rows[below], rows[~below]))
            if best is None or error < best[0] - 1e-9:
                best = (error, f, (low + high) / 2, rows[below], rows[~below])
    if best is None:
        return sorted(rows.tolist())
    return (best[1], pytest.approx(best[2]), naive(x, t, w, best[3], depth - 1, least_rows), naive(x, t, w, best[4], depth - 1, least_rows))


def nested(feature, threshold, leaf, node=0):
    if feature[node] < 0:
        return sorted(np.flatnonzero(leaf == node).tolist())
    return (feature[node], threshold[node], nested(feature, threshold, leaf, 2 * node + 1), nested(feature, threshold, leaf, 2 * node + 2))


@pytest.mark.parametrize(("seed", "depth", "least_rows"), [(1, 2, 1), (2, 3, 5), (3, 4, 1), (4, 1, 30), (5, 3, 60)])
def test_grown_tree_equals_all_cuts(seed, depth, least_rows):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=90), rng.integers(0, 4, 90), np.full(90, 2.0)])
    t = rng.normal(size=90) + (x[:, 0] > 0.3) * x[:, 1]
    w = rng.integers(0, 3, 90).astype(float)
    feature, threshold, leaf = trees.grown(x, trees.Ranked(x), t, w, depth, least_rows)
    assert nested(feature, threshold, leaf) == naive(x, t, w, np.flatnonzero(w), depth, least_rows)
    assert (leaf[w == 0] == -1).all() and (trees.leaves(x, feature, threshold)[w > 0] == leaf[w > 0]).all()


def test_boosting_equals_a_plain_version():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.5, 150) > 0.4).astype(float)
    made = list(trees.boosted(x, y, 12, 2, 0.05))
    score = np.full(150, np.log(y.mean() / (1 - y.mean())))
    assert made[0][0] == -1 and made[0][3][0] == pytest.approx(score[0])
    loss = []
    for tree, feature, threshold, value, rows in made[1:]:
        p = 1 / (1 + np.exp(-score))
        want = naive(x, y - p, np.ones(150), range(150), 2, 1)
        leaf = trees.leaves(x, feature, threshold)
        assert nested(feature, threshold, leaf) == want and rows.sum() == 150
        for node in np.unique(leaf):
            own = leaf == node
            assert value[node] == pytest.approx(0.05 * (y - p)[own].sum() / (p * (1 - p))[own].sum())
        score = score + value[leaf]
        loss.append(-(y * np.log(1 / (1 + np.exp(-score))) + (1 - y) * np.log(1 - 1 / (1 + np.exp(-score)))).sum())
    assert loss == sorted(loss, reverse=True)


def test_forest_learns_and_repeats():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(800, 8))
    y = (x[:, 2] > 0).astype(float)
    first = list(trees.forest(x, y, range(0, 6), 181, "AA", 6, 50))
    again = list(trees.forest(x, y, range(3, 6), 181, "AA", 6, 50))
    for a, b in zip(first[3:], again, strict=True):  # a tree doesn't depend on the chunk it is grown in
        assert all(np.array_equal(u, v) for u, v in zip(a[1:], b[1:], strict=True))
    up = np.mean([t[3][trees.leaves(x, t[1], t[2])] for t in first], axis=0)
    assert ((up > 0.5) == (y > 0)).mean() > 0.9
    assert all((t[4][t[4] > 0] >= 50).all() and (t[1] >= 0).sum() <= 63 for t in first)


def test_scores_do_not_depend_on_the_blocks(spark, monkeypatch):
    bars = bars_frame(spark, rows=700, symbols=("AA", "BB"))
    rows = staged(classify.split_rows(bars))
    points = staged(classify.with_points(rows, classify.fittable(rows)))
    monkeypatch.setitem(trees.FOREST, "trees", 12)
    monkeypatch.setitem(trees.BOOSTING, "trees", 6)
    found = []
    for block in (65_536, 50):
        monkeypatch.setattr(trees, "BLOCK_ROWS", block)
        made = classify.probabilities(points, ["ml_rf", "ml_gbrt"]).collect()
        found.append(sorted((r["symbol"], r["model"], r["idx"], round(r["up"], 12)) for r in made))
    assert found[0] == found[1] and {r[1] for r in found[0]} == {"ml_rf", "ml_gbrt"}
    assert len(found[0]) == 2 * points.where("part = 'test'").count()
