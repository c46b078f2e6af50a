import os

import pytest


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def documents(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "src0", None if t is None else len(t), 7, "x") for i, t in rows]
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, block int, ids string"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make
