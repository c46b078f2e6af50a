import random
import re

import numpy as np
import pytest

from barlight.llm import jaccard, queries
from barlight.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width):
    sets = [(i, shingles(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def some_rows(rng, groups=12):
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "É two"), (7, "é two"), (None, "one two"), (8, "a b c d e"), (8, "a b c d e")]
    line = " ".join(rng.choice("abcdefgh") + rng.choice("wxyz") for _ in range(20))
    n = 10
    for _ in range(groups):
        base = [rng.choice("abcdefgh") + rng.choice("stuvwxyz") for _ in range(rng.randrange(4, 80))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice("abcdefgh")
            if rng.random() < 0.3:
                words = words + line.split()
            rows.append((n, rng.choice([" ", "\n", "\x0c "]).join(words)))
            n += 1
    rng.shuffle(rows)
    return rows


def answer(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_matches_brute_force(documents):
    rows = some_rows(random.Random(1))
    assert answer(jaccard.near_duplicates(documents(rows, 4), 3)) == brute(rows, 3)


@pytest.mark.parametrize("seed", [2, 3])
def test_large_groups_in_parts(documents, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "GROUP_SETS", 3)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 600)
    rng = random.Random(seed)
    # A chain of texts: neighbours link, the ends don't.
    base = [f"w{i}" for i in range(60)]
    rows = [(100 + 3 * k, " ".join(base[k:] + [f"new{i}" for i in range(k)])) for k in range(0, 40, 2)]
    rows += some_rows(rng, 3)
    rows = [(i, t) for i, t in rows]
    assert answer(jaccard.near_duplicates(documents(rows, 3), 3)) == brute(rows, 3)


@pytest.mark.parametrize("kind", ["template", "hub", "mixed", "bands"])
def test_no_task_of_a_large_group_holds_it_whole(documents, monkeypatch, kind):
    rng = random.Random(4)
    rows = []
    if kind in ("template", "hub"):  # pages share 85 of 100 words and none link; the hub links with those that share most
        rows = [(i, " ".join([f"t{k}" for k in range(85)] + [f"own{i}x{k}" for k in range(15)])) for i in range(10, 70)]
        if kind == "hub":
            rows += [(5, " ".join(f"t{k}" for k in range(85))), (6, " ".join(f"t{k}" for k in range(70)))]
    else:
        words = [f"h{k}" for k in range(100)]
        for i in range(10, 70):
            n = 60 if kind == "mixed" else rng.randrange(10, 95)
            rows.append((i, " ".join(rng.sample(words, n))))
        rows += [(200 + i, t.rsplit(" ", 2)[0] + " near") for i, t in rows[::7]]
    most = 40
    monkeypatch.setattr(jaccard, "GROUP_SETS", 4)
    original = jaccard._joined

    def bounded(group):
        if group.num_rows > most:
            raise ValueError(f"a task holds {group.num_rows} sets")
        return original(group)

    monkeypatch.setattr(jaccard, "_joined", bounded)
    assert answer(jaccard.near_duplicates(documents(rows, 3), 1)) == brute(rows, 1)


def test_threshold_is_exact(documents):
    words = [f"w{i}" for i in range(11)]
    rows = [(1, " ".join(words[:9])), (2, " ".join(words[:9] + ["x"])), (3, "a b c d"), (4, "a b c e")]
    # One-word shingles: 9 of 10 shared; 3 of 5 shared.
    assert answer(jaccard.near_duplicates(documents(rows), 1)) == [(1, 9, 1), (2, 10, 1), (3, 4, 3), (4, 4, 4)]
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i j"), (3, "k l m n"), (4, "k l m n o p")]  # 8 of 10: linked; 4 of 6: not
    assert answer(jaccard.near_duplicates(documents(rows), 1)) == [(1, 8, 1), (2, 10, 1), (3, 4, 3), (4, 6, 4)]


def test_tree_finds_all_links():
    rng = random.Random(9)
    sets = []
    for _ in range(25):
        base = rng.sample(range(1000), rng.randrange(5, 40))
        for _ in range(4):
            s = set(base)
            for _ in range(rng.randrange(4)):
                s ^= {rng.choice(base), rng.randrange(1000)}
            sets.append(s or {1})
    tree = jaccard.PrefixTree(list(range(len(sets))))
    for x, s in enumerate(sets):
        tokens = np.array(sorted(s), np.uint64)
        tree.link(x, tokens, len(s))
        tree.add(x, tokens, len(s))
    for x, a in enumerate(sets):
        for y, b in enumerate(sets):
            if 100 * len(a & b) >= 80 * len(a | b):
                assert tree.find(x) == tree.find(y)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (None, 3)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        return i if root[i] == i else find(root[i])

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_of_each_group_stays(documents):
    rows = some_rows(random.Random(6)) + [(8, "a b c d e")]
    docs = documents(rows, 4)
    kept = jaccard.without_near_duplicates(docs, 3)
    assert kept.schema == docs.schema
    want = [i for i, n, c in brute(rows, 3) if i is None or not n] + sorted({c for i, n, c in brute(rows, 3) if i is not None and n})
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)


def test_no_documents(documents):
    assert jaccard.near_duplicates(documents([])).count() == 0
    assert jaccard.without_near_duplicates(documents([])).count() == 0


def test_query_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert answer(queries.op7_prefix_tree_join(spark, sf).select("doc_id", "n_shingles", "component_id")) == brute(rows, 5)
