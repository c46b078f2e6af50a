import math
import random

import numpy as np
import pyarrow as pa

from barlight.llm import topk


def brute(rows, asks, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if asks(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(b) == len(a))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score string").repartition(5)
    return [tuple(r) for r in topk.exact_top_k(df, df.vec_id % 5 == 0, k).collect()]


def as_float(v):
    return v if v is None else [x if x is None else float(np.float32(x)) for x in v]


def test_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(37)]) for i in range(160)]
    rows += [(200, None), (205, []), (210, [None] * 37), (215, [float("nan")] * 37), (220, [float("inf")] + [0.0] * 36), (225, [0.5] * 8), (230, [0.25] * 8), (None, [1.0] * 37)]
    rows += [(i, [0.125] * 37) for i in range(300, 340)]  # ties
    got = run(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute([(i, as_float(v)) for i, v in rows], lambda q: q % 5 == 0, 5)


def test_few_rows_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 2.0])]) == []
    assert set(run(spark, [(0, [1.0, 2.0]), (5, [3.0, 4.0])])) == {(0, 1, 5, 256 * 256 * 11), (5, 1, 0, 256 * 256 * 11)}


def test_pruning_keeps_the_best():
    rng = np.random.default_rng(6)
    queries, rows = (np.floor(rng.normal(0, 300, (64, n))) for n in (9, 3000))
    ids = rng.permutation(3000)
    j, i, s = topk.best(np.arange(9), queries, ids, rows, 5)
    for q in range(9):
        scores = queries[:, q] @ rows
        want = [ids[x] for x in np.lexsort((ids, -scores)) if ids[x] != q][:5]
        assert i[j == q].tolist() == want


def test_wide_integers():
    big = 2.0**40
    j, i, s = topk.best(np.array([9]), np.array([[big], [3.0]]), np.array([1, 2]), np.array([[1.0, 2.0], [big, 5.0]]), 5)
    assert i.tolist() == [1, 2] and s.tolist() == [4 * 2**40, 2 * 2**40 + 15]


def test_pack_skips_unusable_vectors():
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "ask": [True, False], "vector": pa.array([[1.0], None], pa.list_(pa.float32()))})
    assert sum(len(b.column(3)[0].as_py()) for b in topk._pack(iter([batch]))) == 16
