import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barlight.llm import packing


def reference():
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID]


ENCODE = reference()
LOOKUP = packing.ByteLevelIds(packing.tokenizer_path())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab c. ,Tthe  \n\t\r\x00éß🙂's1²_.-<|endoftext>  "), max_size=40))
def test_ids_equal_the_tokenizers(text):
    assert np.frombuffer(LOOKUP(text), "<u4").tolist() == ENCODE(text)[:-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext|", "|>", " ", "a", "\n", "<|", "é", " " * 1500, "\t" * 1001, "\u2003" * 1000 + "x", "\x1f" * 1200]), max_size=8))
def test_added_tokens_and_long_space(parts):
    assert np.frombuffer(LOOKUP("".join(parts)), "<u4").tolist() == ENCODE("".join(parts))[:-1]


def test_added_token_has_its_id():
    assert np.frombuffer(LOOKUP("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]


def test_very_long_runs():
    for run in (" ", "\t", "\n", "a", "\u3000"):
        for text in (run * 1_000_000, run * 1_000_000 + "x", "x" + run * 1_000_000 + " x"):
            assert np.frombuffer(LOOKUP(text), "<u4").tolist() == ENCODE(text)[:-1]


def check(rows, pieces, length):
    left = {}
    for i, t in rows:
        left.setdefault(i, []).append(ENCODE(t))
    stream = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    place = 0
    for p in stream:  # gapless, every sequence full but the last
        assert p.sequence_id * length + p.offset == place and p.length > 0
        place += p.length
    assert place == sum(len(x) for xs in left.values() for x in xs)
    found = {}
    for p in sorted(stream, key=lambda p: p.start):
        found.setdefault((p.doc_id, (p.sequence_id * length + p.offset) - p.start), []).append(p)
    for (doc, _), own in found.items():
        ids = [x for p in own for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert len(ids) == own[0].doc_tokens and ids in left[doc]
        left[doc].remove(ids)
    assert not any(left.values())


def test_pieces_hold_every_id_once(documents):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["word", "été", "x", "\n", "longerword"]) for _ in range(rng.randrange(90)))) for i in range(70)]
    rows += [(100, None), (101, ""), (102, "same"), (102, "same"), (None, "no id"), (103, "y " * 3000), (104, "<|endoftext|>"), (105, "a <|endoftext|> b"), (106, " " * 1_000_000 + "x")]
    check(rows, packing.pack(documents(rows), length=64).collect(), 64)
    check(rows, packing.pack(documents(rows, 1)).collect(), 2048)


def test_no_documents(documents):
    assert packing.pack(documents([])).count() == 0


def test_query_on_the_table(spark, sf):
    from barlight.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_packing(spark, sf).collect()
    assert {r.doc_id for r in rows} == texts.keys()
    for r in rows[:200]:
        ids = np.array(ENCODE(texts[r.doc_id]), "<u4")
        assert len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
