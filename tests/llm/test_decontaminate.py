import hashlib
import random
import re

import numpy as np
import pytest

from barlight.llm import decontaminate as D
from barlight.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def windows(items, width):
    out = {}
    for item, text in items:
        w = words(text)
        m = min(width, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            out.setdefault(tuple(w[i : i + m]), set()).add(item)
    return out


def brute(docs, items, width):
    known = windows(items, width)
    lengths = {len(k) for k in known}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in known:
                    hit |= set(range(i, i + m))
                    found |= known[tuple(w[i : i + m])]
        out.append((doc_id, len(w), sorted(hit), sorted(found - {None})))
    return sorted(out, key=str)


def rows(frame):
    return sorted(((r.doc_id, r.n_words, [i for s in r.spans for i in range(s.start, s.start + s.length)], r["items"]) for r in frame.collect()), key=str)


@pytest.fixture
def benchmark(spark):
    return lambda items: spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, row int, spans string").repartition(2)


def corpus(rng):
    def some(n):
        return [rng.choice(["a", "b", "été", "Ünd", "x9", "long" * 5, "🙂"]) for _ in range(n)]

    items = [(i, rng.choice([" ", "-", "\n"]).join(some(rng.randrange(1, 25)))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "... !"), (None, "secret words stand here alone"), (None, "b b b"), (53, "Only"), (54, items[3][1]), (54, items[4][1]), (55, "q w " * 60)]
    docs = [(-1, None), (0, ""), (1, " .,\t"), (2, "ONLY"), (2, "ONLY"), (None, "no id but secret-words, stand here: alone"), (3, "q w " * 300 + "tail")]
    for i in range(10, 120):
        w = some(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            piece = words(rng.choice(items)[1])
            at, cut = rng.randrange(len(w) + 1), rng.randrange(25)
            w[at:at] = piece[cut:] if rng.random() < 0.5 else [x.upper() if x.isascii() else x for x in piece[:cut]]
        docs.append((i, rng.choice([" ", "; ", "_"]).join(w)))
    return docs, items


def test_matches_brute_force(documents, benchmark):
    docs, items = corpus(random.Random(12))
    for width, shard in ((10, D.SHARD_BYTES), (4, D.SHARD_BYTES), (10, 700), (1, 900), (2, D.SHARD_BYTES)):
        assert rows(D.contaminated(documents(docs), benchmark(items), width, shard)) == brute(docs, items, width), (width, shard)


def test_long_items_are_cut_without_losing_windows(documents, benchmark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_WINDOWS", 3)
    docs, items = corpus(random.Random(1))
    assert rows(D.contaminated(documents(docs), benchmark(items), 6, 500)) == brute(docs, items, 6)


def test_equal_hashes_are_told_apart_by_bytes():
    text = np.frombuffer(b"ab ac ab ", np.uint8)
    begin, end = np.array([0, 3, 6]), np.array([3, 6, 9])
    assert D.distinct(np.zeros(3, np.uint64), begin, end, text).tolist() == [0, 1, 0]


def test_lanes_do_not_matter(monkeypatch):
    docs, items = corpus(random.Random(3))
    w = D.Spaced(D.pa.array([t for _, t in docs], D.pa.large_string()))
    table = D.compiled(3, list(range(3)), ["b a b a x9 ", "q w q w ", "a b a "])
    found = set()
    for lane in (1, 2, 7, 512):
        monkeypatch.setattr(D, "LANE", lane)
        found.add(tuple(sorted(zip(*(x.tolist() for x in D.search(table, w)), strict=True))))
    assert len(found) == 1 and found.pop()


def test_empty_tables(documents, benchmark):
    assert D.contaminated(documents([]), benchmark([(1, "a b")])).count() == 0
    assert rows(D.contaminated(documents([(1, "a b"), (2, None)]), benchmark([]))) == [(1, 2, [], []), (2, 0, [], [])]


def test_query_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [(d, n, len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)) for d, n, hit, found in brute(docs, items, 10)]
    got = [tuple(r) for r in queries.op12_wu_manber_decontamination(spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(g[5] for g in got) and not all(g[5] for g in got)
