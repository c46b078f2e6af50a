import random

import pytest
from pyspark.sql import functions as F

from barlight.llm import queries, toxicity
from barlight.llm.toxicity import LexiconAutomaton, quotation


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    terms = {"idiot": 1, "moron": 1, "worthless": 2, "disgusting": 2, "scum": 0, "abcde": 1, "abcdf": 1}
    automaton = LexiconAutomaton(terms)
    words = list(terms) + ["", "s", "scu", "idiott", "dioti"]
    for _ in range(3000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = [rng.choice("abcdeimorst")] * rng.randrange(2)
        words.append("".join(w))
    for w in words:
        near = min((distance(w, t), t) for t, allowed in terms.items() if distance(w, t) <= allowed) if any(distance(w, t) <= k for t, k in terms.items()) else None
        assert automaton.look(w) == (near and near[::-1]), w


def test_stems_begin_words():
    automaton = LexiconAutomaton({"lowei*": 0, "trash": 1})
    assert automaton.look("loweichen") == ("lowei*", 0) == automaton.look("lowei")
    assert automaton.look("lowe") is None and automaton.look("xlowei") is None and automaton.look("trsh") == ("trash", 1)


def test_quotation_is_told_from_abuse():
    tokens = lambda s: toxicity.TOKEN.findall(s.lower())
    for text, low, high in (('you are an idiot', 0, 0.1), ('he said "you idiot" to them', 0.9, 1), ("er nannte ihn „idiot“ gestern", 0.9, 1), ('"fine" you idiot "ok"', 0, 0.1), ("« idiot » a dit", 0.9, 1)):
        t = tokens(text)
        assert low <= quotation(t, t.index("idiot")) <= high, text


def corpus(rng, n=400):
    vocabulary = ["".join(rng.choice("abcdeghlnr") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["stinkytoad", "mudbrain", "fishface"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id bigint, toxic int")
    return toxicity.learn(docs, marks, F.col("doc_id") % 4 != 2)


def test_held_out_accuracy_and_misspellings(documents, model):
    assert {"stinkytoad", "mudbrain", "fishface"} <= set(model.weights)
    rows, labels = corpus(random.Random(4))
    scores = {r.doc_id: r.score for r in toxicity.score(documents(rows), model).collect()}
    assert all((scores[i] >= 0.3) == bool(t) for i, t in labels)
    plain = " ".join("abcd" for _ in range(30))
    odd = [(1, f"{plain} stinkytod mudbran fishfacee xmudbrain"), (2, None), (3, ""), (3, ""), (4, "stinkytoad " * 5000), (None, plain)]
    rows = toxicity.score(documents(odd), model).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 6 and got[1].score >= 0.3 and {h.term for h in got[1].hits} == {"stinkytoad", "mudbrain", "fishface"}
    assert got[2].score == got[3].score < 0.3 and got[4].score > 0.9 and got[None].score < 0.3


def test_kept_rows(documents, model):
    docs = documents([(1, "mudbrain stinkytoad fishface"), (2, "calm words"), (3, None)])
    kept = toxicity.kept_rows(docs, model)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {2, 3}


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.learn(documents([(1, "a")]), none, F.lit(True))
    assert model.weights == {} and 0 <= toxicity.score(documents([(1, "a")]), model).first().score <= 1
    assert toxicity.score(documents([]), model).count() == 0


def test_query_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)
