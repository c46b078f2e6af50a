import random
from collections import Counter

import corpus_pipeline as P
from test_jaccard import brute as near
from test_packing import check
from test_suffixes import brute as trimmed
from test_toxicity import corpus

from barlight.llm import toxicity
from pyspark.sql import functions as F


def tables(spark, folder):
    rng = random.Random(11)
    rows, labels = corpus(rng, 240)
    passage = " ".join(f"shared{i}" for i in range(60))
    rows += [(300 + i, f"{rows[1][1]} tail{i}") for i in range(3)] + [(310, passage), (311, " ".join(f"own{i}" for i in range(40)) + " " + passage), (320, None), (321, ""), (330, "mudbrain fishface stinkytoad mudbrain")]
    langs = ["en", "de", None]
    spark.createDataFrame([(i, t, langs[i % 3], "src0", None if t is None else len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, t) for i, t in labels], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_every_stage_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    rows = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "packing"]
    for k, (name, stage) in enumerate(P.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.schema == docs.schema, name
        out.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        if name == "packing":
            check(before, docs.collect(), 2048)
            break
        after = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        if name == "toxicity":
            model = toxicity.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
            assert after == sorted((x for x in before if model.score(*model.hits(x[1])) < 0.3), key=str)
            assert {i for i, _ in before} - {i for i, _ in after} == {i for i in range(0, 240, 5)} | {330}
        elif name == "ngram_jaccard_join":
            stays = {i for i, n, c in near(before, 5) if not n or i == c}
            assert {i for i, _ in after} == stays and not {300, 301, 302} & stays
        elif name == "suffix_array_dedup":
            cut = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in trimmed(before, 50)}
            assert after == sorted(((i, None if t is None else cut[i]) for i, t in before), key=str)
            assert "shared30" not in dict(after)[311] and "own39" in dict(after)[311]
        else:
            assert Counter(i for i, _ in after).keys() == {i for i, _ in before} and set(after) == set(before)


def test_run_on_the_table(spark, sf):
    out = P.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
