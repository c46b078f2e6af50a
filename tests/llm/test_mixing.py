import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from barlight.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(text):
    text = text or ""
    n = len(WORD.findall(text))
    share = {k: len(re.findall(p, text)) / max(len(text), 1) for k, p in mixing.CLASSES.items()}
    bins = {f"b_{k}": min(11, math.floor(math.log2(1 + 2000 * s))) for k, s in share.items()}
    bins["b_length"] = min(11, math.floor(math.log2(1 + len(text) / 16)))
    bins["b_word"] = min(11, len(text) // max(n, 1))
    return n, bins


def brute(rows, domain_of):
    """Posterior of every row under naive Bayes with half a count added to each bin."""
    described = {i: features(t) for i, t in rows}
    counts = Counter((d, k, b) for i, d in domain_of.items() for k, b in described[i][1].items())
    size = Counter(domain_of.values())
    out = {}
    for i, (_, bins) in described.items():
        logs = {d: math.log(size[d] / len(domain_of)) + sum(math.log((counts[d, k, b] + 0.5) / (size[d] + 6)) for k, b in bins.items()) for d in size}
        peak = max(logs.values())
        whole = sum(math.exp(x - peak) for x in logs.values())
        out[i] = {d: math.exp(x - peak) / whole for d, x in logs.items()}
    return out


def corpus(rng):
    rows, domain_of = [(900, None), (901, ""), (902, "%%% ###")], {}
    for i in range(120):
        kind = i % 3
        words = ["".join(rng.choice(["aeth", "éèox", "äöüz"][kind]) for _ in range(rng.randrange(2, 7))) + rng.choice(["", "", ".", "%"]) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words)))
        if i % 2:
            domain_of[i] = ["a", "b", "c"][kind]
    return rows, domain_of


def test_posteriors_and_totals(spark, documents):
    rows, domain_of = corpus(random.Random(1))
    labelled = spark.createDataFrame(list(domain_of.items()) + [(None, "a"), (3, None)], "doc_id bigint, domain string")
    targets = {"a": 5.0, "b": 3.0, "c": 2.0}
    got = mixing.mix(documents(rows), labelled, targets).collect()
    assert len(got) == len(rows)
    want = brute(rows, domain_of)
    for r in got:
        assert r.n_tokens == features(dict(rows)[r.doc_id])[0]
        assert r.p == pytest.approx(want[r.doc_id], abs=1e-9)
        assert r.rate >= 0 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1)
    before = {d: sum(r.n_tokens * r.p[d] for r in got) for d in targets}
    total = max(10 * before[d] / w for d, w in targets.items())
    for d, w in targets.items():
        assert sum(r.rate * r.n_tokens * r.p[d] for r in got) == pytest.approx(w / 10 * total, abs=2e-4 * total)
    assert {r.rate for r in got if not r.n_tokens} == {1.0}


def test_bounds_and_given_budget(spark, documents):
    rows, domain_of = corpus(random.Random(2))
    labelled = spark.createDataFrame(list(domain_of.items()), "doc_id bigint, domain string")
    got = mixing.mix(documents(rows), labelled, {"a": 1.0}, total_tokens=500.0).collect()
    totals = {d: sum(r.rate * r.n_tokens * r.p[d] for r in got) for d in "abc"}
    assert min(r.rate for r in got) == 0.0
    assert totals["a"] == pytest.approx(500, rel=0.05) and totals["b"] + totals["c"] < 50
    kept = mixing.mix(documents(rows), labelled, least_rate=1.0).collect()
    assert all(r.rate >= 1 and r.copies >= 1 for r in kept)


def least_squares(a, goal, least, steps=60_000):
    """Non-negative least squares by plain projected gradients on every document, accelerated; slow and simple."""
    size = 1 / np.linalg.eigvalsh(a.T @ a).max()
    rate = ahead = np.maximum(least, np.ones(len(a)))
    pace = 1.0
    for _ in range(steps):
        after = np.maximum(least, ahead - size * (a @ (a.T @ ahead - goal)))
        if ((ahead - after) * (after - rate)).sum() > 0:
            pace = 1.0
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, rate, pace = after + (pace - 1) / faster * (after - rate), after, faster
    return ((a.T @ rate - goal) ** 2).sum()


@pytest.mark.parametrize(("seed", "least", "weights", "total"), [(3, 1.0, {"a": 1.0, "b": 1.0, "c": 1.0}, None), (4, 1.0, {"a": 6.0, "b": 1.0, "c": 2.0}, None), (5, 0.5, {"a": 1.0, "b": 4.0}, 1500.0), (6, 0.0, {"a": 1.0, "c": 9.0}, 3000.0)])
def test_rates_are_the_constrained_optimum(spark, documents, seed, least, weights, total):
    rows, domain_of = corpus(random.Random(seed))
    labelled = spark.createDataFrame(list(domain_of.items()), "doc_id bigint, domain string")
    got = [r for r in mixing.mix(documents(rows), labelled, weights, total, least_rate=least).collect() if r.n_tokens]
    a = np.array([[r.n_tokens * r.p[d] for d in "abc"] for r in got])
    rate = np.array([r.rate for r in got])
    share = np.array([weights.get(d, 0.0) for d in "abc"]) / sum(weights.values())
    total = total or max(t / w for t, w in zip(a.sum(axis=0), share, strict=True) if w)
    goal = share * total
    off = a.T @ rate - goal
    assert off / total == pytest.approx([got[0].off_target[d] for d in "abc"], abs=1e-9)
    # The distance is that of a brute-force fit, and no rate can move without making it longer.
    assert math.sqrt((off**2).sum()) <= math.sqrt(least_squares(a, goal, least)) + 2e-3 * total
    p = np.array([[r.p[d] for d in "abc"] for r in got])
    pull = p @ off / np.linalg.eigvalsh((a.T / a.sum(axis=1)) @ a).max()
    assert (np.where(rate > least + 1e-12, np.abs(pull), np.maximum(0, -pull)) <= 1e-5 * (1 + np.abs(rate))).all()


def test_no_labels_no_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    assert {(r.rate, r.copies) for r in mixing.mix(documents([(1, "a b"), (1, "a b"), (None, "c")]), none).collect()} == {(1.0, 1)}
    assert mixing.mix(documents([]), none).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(documents([(1, "a")]), none, {"elsewhere": 1.0})


def test_repeats_take_effect(spark, documents):
    docs = documents([(1, "a"), (2, "b"), (3, "c"), (None, "d")])
    rated = spark.createDataFrame([(1, 0), (2, 1), (3, 3), (None, 2)], "doc_id bigint, copies bigint")
    out = mixing.repeated(docs, rated)
    assert out.schema == docs.schema
    assert sorted((r.text for r in out.collect())) == ["b", "c", "c", "c", "d", "d"]


def test_query_is_native(spark, sf):
    out = queries.op3_source_mixing(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
