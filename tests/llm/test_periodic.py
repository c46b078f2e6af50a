import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from barlight.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """(start, length, period) of all runs: every period tried, smallest first."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def looped(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def found(words):
    numbers = np.append(np.array(words, np.int64) + 2, [0, 1])  # the last two stand once
    return [(s, e - s, q) for s, e, q in periodic.runs_of(numbers, len(words)).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6))
def test_runs_equal_those_of_all_periods(parts):
    words = [x for cycle, times in parts for x in cycle * times]
    assert found(words) == [tuple(r) for r in brute(words)]


def test_hard_sequences():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    thue = [bin(i).count("1") % 2 for i in range(512)]
    rng = random.Random(4)
    noise = [rng.randrange(3) for _ in range(400)]
    cases = [b, thue, [0] * 700, ([0] * 37 + [1]) * 19, thue[:61] * 9 + noise, noise * 4 + noise[:50], ([0, 1] * 20 + [2]) * 8, [0] * 5, [0] * 6, [0, 1] * 4, [0, 1] * 3, []]
    for words in cases:
        assert found(words) == brute(words), words[:50]


def test_transform_counts_differences_exactly():
    rng = np.random.default_rng(7)
    for size in (1, 2, 8, 64, 512):
        x = rng.integers(0, 2 ** ((30 - int(np.log2(size))) // 2), 6 * size).astype(np.uint64)
        x[size : 3 * size] = np.tile(x[:size], 2)
        at, distance = periodic.occurrences(np.append(x, np.zeros(3 * size, np.uint64)), np.arange(0, 3 * size, size), size)
        want = {(b, d) for b in range(0, 3 * size, size) for d in range(size, 2 * size) if np.array_equal(x[b : b + size], x[b + d : b + d + size])}
        assert set(zip(at.tolist(), distance.tolist(), strict=True)) == want and (0, size) in want


def test_matches_brute_force(documents):
    rng = random.Random(11)
    rows = [(-1, None), (0, ""), (1, " \t\n"), (2, "one"), (2, "one"), (None, "a " * 9), (3, "z " * 5000), (4, "q" * 9000)]
    for i in range(5, 150):
        words = [rng.choice("abcdefgh") + rng.choice("xyzé🙂") for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [f"c{k}" for k in range(rng.randrange(1, 30))] * rng.randrange(2, 8)
        rows.append((i, rng.choice(["  ", " ", "\n", "\x0b"]).join(words)))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(documents(rows, 4)).collect()), key=str)
    want = []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        runs = brute(words)
        want.append((doc_id, len(words), runs, collapsed(words, runs)))
    assert got == sorted(want, key=str) and periodic.periodic_runs(documents([])).count() == 0


def test_long_text_is_one_run():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["ab cd ef " * 300_000, "x " * 900_000])], names=["doc_id", "text"])
    out = periodic.collapsed(batch)
    assert out.column("runs").to_pylist() == [[{"start": 0, "length": 900_000, "period": 3}], [{"start": 0, "length": 900_000, "period": 1}]]
    assert out.column("collapsed").to_pylist() == ["ab cd ef", "x"]


def test_loops(documents):
    rows = [(i, f"w{i} " + " ".join(f"x{k}" for k in range(i % 40))) for i in range(300)] + [(None, "a b"), (301, None), (302, "")]
    assert sorted((r.doc_id, WORD.findall(r.text or "")) for r in periodic.with_loops(documents(rows)).collect() if r.doc_id is not None) == [(i, looped(i, t)) for i, t in rows if i is not None]


def test_query_on_the_table(spark, sf):
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = looped(r.doc_id, r.text)
        if len(words) > 3000:  # brute force is quadratic
            continue
        runs = brute(words)
        top = min(((-n, s, q) for s, n, q in runs), default=None)
        most = (None,) * 4 if top is None else (top[1], -top[0], top[2], -1000 * top[0] // top[2])
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((r.doc_id, len(runs), *most, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    ids = {w[0] for w in want}
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()]
    assert sorted(g for g in got if g[0] in ids) == sorted(want) and sum(w[1] > 0 for w in want) > 5
