"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.llm import jaccard, mixing, packing, suffixes, toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go. The model learns from the labels of rows whose crc32(doc_id) mod 4 is not 2."""
    model = toxicity.learn(docs, _labels(spark, sf_dir), usable=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    return toxicity.kept_rows(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 80 % shared five-word shingles connect, the one with the smallest doc_id stays."""
    return jaccard.without_near_duplicates(docs)


def trim_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that start in a document with a smaller doc_id are cut out of the texts; n_chars follows."""
    trimmed = suffixes.trimmed(docs)
    if "n_chars" not in trimmed.columns:
        return trimmed
    return trimmed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that languages keep their share and good documents gain; every document stays once at least."""
    labelled = mixing.languages_by_quality(docs, _labels(spark, sf_dir))
    rated = mixing.mix(docs, labelled, mixing.production_targets(labelled) or None, least_rate=1.0)
    return mixing.repeated(docs, rated)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", trim_repeats),
    ("source_mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, tokens and removed substrings can't be expressed in SQL; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlight.session import staged

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
