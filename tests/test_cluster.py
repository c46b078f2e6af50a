"""The shared folder off a local master, and shared intermediates whose files have gone."""

import os

import pytest

import __spark_entry__ as entry
from barlight import session
from checks import registry
from checks.compare import connect, difference

SF = "/root/testdata/sf0.01"
QUERIES = ["a10_balance_persistence"]


@pytest.fixture
def cluster(spark, monkeypatch, tmp_path):
    """As on a cluster whose machines mount one folder: another master, spark.checkpoint.dir on the local file system."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://driver:7077")
    monkeypatch.setattr(session, "_SEEN", set(), raising=False)
    monkeypatch.setattr(registry, "_SHARED", {})
    get = spark.conf.get
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *rest: f"file://{tmp_path}" if key == "spark.checkpoint.dir" else get(key, *rest))
    return spark


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql_on_a_cluster(cluster, name):
    assert difference(entry.queries()[name](cluster, SF), connect(SF), entry.oracle_sql()[name]) is None


def test_staged_in_a_mounted_folder(cluster, tmp_path):
    assert session.staged(cluster.range(7)).count() == 7
    assert list(tmp_path.glob("staged/*"))


def test_own_disks_are_refused(cluster, monkeypatch):
    """Executors whose files the driver does not find leave an empty table."""
    monkeypatch.setattr(type(cluster.range(1)), "count", lambda self: 0)
    with pytest.raises(RuntimeError, match="do not share"):
        session.shared_folder(cluster)


def test_shared_intermediate_is_made_anew_without_its_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(registry, "_SHARED", {})
    made = []

    @registry.shared
    def numbers(spark, sf):
        made.append(len(made))
        path = f"{tmp_path}/{len(made)}"
        spark.range(5).write.parquet(path)
        out = spark.read.parquet(path)
        return {"rows": out}

    def clear(folder):
        for file in folder.iterdir():
            file.unlink()

    assert [numbers(spark, SF)["rows"].count() for _ in range(2)] == [5, 5] and made == [0]
    clear(tmp_path / "1")
    assert numbers(spark, SF)["rows"].count() == 5 and made == [0, 1]
