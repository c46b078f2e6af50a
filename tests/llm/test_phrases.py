import hashlib
import random
import re
from collections import Counter

from barlight.llm import phrases, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """Per row: number of words, removed positions, kept text."""
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def test_matches_brute_force(documents):
    rng = random.Random(3)
    passage = [rng.choice("ab") + rng.choice("éxy") for _ in range(14)]
    rows = [(-1, None), (0, ""), (1, " \t\n "), (2, "one"), (2, "one"), (None, "no id")]
    for i in range(3, 90):
        words = [rng.choice("abcdefgh") + rng.choice("xyzé🙂") for _ in range(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            at, cut = rng.randrange(len(words) + 1), rng.randrange(15)
            words[at:at] = passage[cut:] if rng.random() < 0.5 else passage[:cut]
        rows.append((i, rng.choice(["  ", " ", "\n", "\x0b"]).join(words)))
    rows += [(200 + i, rows[20][1]) for i in range(3)] + [(300, "z " * 100), (301, "long " + "q" * 5000)]
    for width, gram in ((5, 2), (9, 3), (5, 5)):
        got = phrases.without_repeated_phrases(documents(rows, 4), width, gram).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str) == brute(rows, width)
        assert all(sum(s.length for s in r.spans) == r.n_removed for r in got)


def test_words_do_not_meet_inside_other_words(documents):
    rows = [(1, "xab cd ef gh"), (2, "ab cd ef ghx"), (3, "ab cd ef gh"), (4, "ab cd\nef  gh")]
    got = {r.doc_id: r.n_removed for r in phrases.without_repeated_phrases(documents(rows), 4, 2).collect()}
    assert got == {1: 0, 2: 0, 3: 4, 4: 4}


def test_no_documents(documents):
    assert phrases.without_repeated_phrases(documents([])).count() == 0


def test_query_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute(rows, 35))
    got = sorted(tuple(r)[:4] for r in queries.op2_repeated_phrases(spark, sf).collect())
    assert got == want and any(g[2] for g in got)
