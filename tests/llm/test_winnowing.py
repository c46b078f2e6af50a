import hashlib
import random

import numpy as np

from barlight.llm import winnowing
from barlight.llm.common import GOLD, MASK

W = winnowing.Winnow(gram=4, window=5)


def mix(h):
    for shift, by in ((31, 0xBF58476D1CE4E5B9), (29, 0x94D049BB133111EB)):
        h = ((h ^ (h >> shift)) * by) & MASK
    return h ^ (h >> 32)


def brute(text, winnow):
    k = winnow.gram
    if text and len(text) < k:
        return [(0, winnowing.Winnow._whole(np.array([ord(c) for c in text])))]
    hashes = []
    for i in range(len(text) - k + 1):
        h = 0
        for c in text[i : i + k]:
            h = (h * GOLD + mix(((ord(c) + 1) * GOLD) & MASK)) & MASK
        hashes.append(mix(h) >> 32)
    kept = set()
    for i in range(max(1, len(hashes) - winnow.window + 1) if hashes else 0):
        window = hashes[i : i + winnow.window]
        low = min(window)
        kept.add((i + max(j for j, h in enumerate(window) if h == low), low))
    return sorted(kept)


TEXTS = ["", "ab", "abcd", "abcdefg", "aaaaaaaaaaaaaaaaaaaaaa", "the quick brown fox jumps over the lazy dog", "ünï çödé 🙂🙂🙂 x" * 5, None]


def test_kept_grams_match_brute_force(documents):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abc ") for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = winnowing.fingerprints(documents(list(enumerate(texts))), W).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(g.position, g.hash) for g in r.grams] == brute(texts[r.doc_id] or "", W), texts[r.doc_id]


def test_shared_passage_is_always_met():
    rng = random.Random(1)
    for _ in range(50):
        passage = "".join(rng.choice("abcdefgh") for _ in range(W.gram + W.window - 1))
        a, b = ("".join(rng.choice("xyz") for _ in range(rng.randrange(30))) for _ in range(2))
        owner, _, kept = W.select(*reversed(winnowing._codes([a + passage + b, b + passage + a])))
        assert set(kept[owner == 0]) & set(kept[owner == 1])


def edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_edits_across_ranges(documents):
    rng = random.Random(2)
    rows = [(i * 3 - 20, None if i % 11 == 0 else "".join(rng.choice("äbc 🙂") for _ in range(rng.randrange(40)))) for i in range(120)]
    rows += [(7, "again"), (7, "again"), (7, "other"), (10, ""), (1 << 60, "far"), (None, "no id")]
    got = winnowing.compare_with_edits(documents(rows, 5), W, block_chars=200).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == edits(rows)


def test_likeness(documents):
    long = "".join(random.Random(3).choice("abcdefghij") for _ in range(4000))
    rows = {r.doc_id: r for r in winnowing.compare_with_edits(documents([(1, long), (2, long), (3, ""), (4, None), (5, "xyz")])).collect()}
    assert rows[1].near_next == 1.0 and rows[1].fingerprint == rows[2].fingerprint
    assert 0.4 < rows[2].near_edited <= 1.0  # the next text is empty: the text is cut short
    assert rows[3].near_next == 1.0 and rows[4].near_next == 0.0 and rows[3].fingerprint == ""
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows.values())


def test_single_and_empty(documents):
    assert winnowing.compare_with_edits(documents([])).count() == 0
    row = winnowing.compare_with_edits(documents([(9, "abcdefgh")])).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
