import hashlib
import random

from barlight.llm import queries, suffixes


def brute(rows, width):
    texts = [((-(2**63) if i is None else i), (t or "").encode(), i) for i, t in rows]
    first = {}
    for key, raw, _ in texts:
        for at in range(len(raw) - width + 1):
            s = raw[at : at + width]
            first[s] = min(key, first.get(s, key))
    out = []
    for key, raw, doc_id in texts:
        gone = bytearray(len(raw))
        for at in range(len(raw) - width + 1):
            if first[raw[at : at + width]] < key:
                gone[at : at + width] = b"\1" * width
        spans = sum(g and not b for g, b in zip(gone, [0, *gone], strict=False))
        out.append((doc_id, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return sorted(out, key=str)


def rows_with_copies(rng, n=80):
    passage = "".join(rng.choice("abcdé🙂 ") for _ in range(60))
    rows = [(-1, None), (0, ""), (1, "short"), (None, passage), (5, passage), (5, passage + "x")]
    for i in range(10, 10 + n):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(80)))
        for _ in range(rng.randrange(3)):
            at, a, b = rng.randrange(len(text) + 1), rng.randrange(40), rng.randrange(20, 60)
            text = text[:at] + passage[a:b] + text[at:]
        rows.append((i, text))
    rows += [(200 + i, rows[20][1]) for i in range(3)] + [(300, "z" * 300), (299, "z" * 40), (301, "zy" * 3000)]
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(documents):
    for seed, width in ((1, 8), (2, 13), (3, 20)):
        rows = rows_with_copies(random.Random(seed))
        got = suffixes.without_earlier_substrings(documents(rows, 4), width).collect()
        assert sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got], key=str) == brute(rows, width)


def test_very_common_anchors_are_dealt_out(documents, monkeypatch):
    decide = suffixes.B.met_elsewhere
    monkeypatch.setattr(suffixes.B, "met_elsewhere", lambda data: decide(data, hot=1))
    rows = rows_with_copies(random.Random(4))
    got = suffixes.without_earlier_substrings(documents(rows, 6), 10).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got], key=str) == brute(rows, 10)


def test_trimmed_keeps_columns_and_characters(documents):
    docs = documents([(1, "x" * 9 + "é" + "abcdefgh"), (2, "é" + "abcdefgh" + "y" * 5), (3, None)])
    out = suffixes.trimmed(docs, 9)
    assert out.schema == docs.schema
    assert {r.doc_id: r.text for r in out.collect()} == {1: "x" * 9 + "éabcdefgh", 2: "y" * 5, 3: None}
    # A string of 9 bytes may begin in the middle of a character.
    half = documents([(1, "è" + "abcdefgh"), (2, "ȩ" + "abcdefgh")])
    assert {r.doc_id: r.text for r in suffixes.trimmed(half, 9).collect()}[2] in ("", "ȩabcdefgh")


def test_no_documents(documents):
    assert suffixes.without_earlier_substrings(documents([])).count() == 0


def test_query_on_the_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in brute(rows, 50))
    got = sorted(tuple(r)[:5] for r in queries.op4_suffix_buckets(spark, sf).collect())
    assert got == want and any(g[2] for g in got)
