"""Whole versions: a writer that dies leaves the old one, of two writers one wins, a batch counts once."""

import os

import pytest

from attestra.sources import versions
from attestra.sources.versions import Conflict, VersionedTables, finalize


def rows(spark, *numbers):
    return spark.createDataFrame([(n, f"v{n}") for n in numbers], "n long, v string")


def held(store, table="t", version=None):
    return sorted(r.n for r in store.read(table, version).collect())


def test_appends_and_time(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "s"))
    assert store.version() == 0 and store.tables() == []
    assert store.append({"t": rows(spark, 1, 2)}, "a") and store.append({"t": rows(spark, 3), "u": rows(spark, 9)}, "b")
    before = store.read("t")
    assert store.append({"t": rows(spark)}, "empty") and store.append({"t": rows(spark, 4)}, "c")
    assert held(store) == [1, 2, 3, 4] and held(store, version=1) == [1, 2] and held(store, "u") == [9] and sorted(r.n for r in before.collect()) == [1, 2, 3]
    assert not store.append({"t": rows(spark, 4)}, "c") and held(store) == [1, 2, 3, 4] and store.batches() == ["a", "b", "c", "empty"]
    with pytest.raises(KeyError):
        store.read("none")
    with pytest.raises(ValueError, match="other columns"):
        store.append({"t": spark.createDataFrame([(1,)], "n int")}, "d")


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = VersionedTables(spark, str(tmp_path / "s"))
    store.append({"t": rows(spark, 1)}, "a")
    monkeypatch.setattr(versions.Manifests, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.append({"t": rows(spark, 2), "u": rows(spark, 3)}, "b")
    with pytest.raises(OSError):
        store.replace({"t": rows(spark, 5)}, 1)
    monkeypatch.undo()
    # what was staged is there and counts for nothing
    assert len(os.listdir(tmp_path / "s" / "data")) == 4 and held(store) == [1] and store.tables() == ["t"]
    assert store.append({"t": rows(spark, 2)}, "b") and held(store) == [1, 2]


def test_of_two_writers_one_wins(spark, tmp_path, monkeypatch):
    one, two = (VersionedTables(spark, str(tmp_path / "s")) for _ in range(2))
    one.append({"t": rows(spark, 1)}, "a")
    based = one.version()
    assert two.replace({"t": rows(spark, 7)}, based) == based + 1
    with pytest.raises(Conflict):
        one.replace({"t": rows(spark, 8)}, based)
    assert held(one) == [7]
    # both read the same version and commit; the manifest of the first stays
    number, document = one.manifests.latest()
    one.manifests.commit(number + 1, {**document, "who": "one"})
    with pytest.raises(Conflict):
        two.manifests.commit(number + 1, {**document, "who": "two"})
    assert one.manifests.latest()[1]["who"] == "one"
    # an append that was overtaken is repeated on the new version
    stale = two.manifests.latest()
    one.append({"t": rows(spark, 10)}, "b")
    real, calls = versions.Manifests.latest, []
    monkeypatch.setattr(versions.Manifests, "latest", lambda self: calls.append(1) or (stale if len(calls) <= 2 else real(self)))
    assert two.append({"t": rows(spark, 11)}, "c")
    monkeypatch.undo()
    assert held(one) == [7, 10, 11] and one.batches() == ["a", "b", "c"]


def test_a_dataset_is_finalised_once_and_whole(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "s"))
    parts = [spark.createDataFrame([("d1", n)], "dataset_id string, n long") for n in (1, 2, 3)]
    assert finalize(store, "d1", *parts) and not finalize(store, "d1", *parts)
    assert store.version() == 1 and store.tables() == ["dataset_records", "dataset_sources", "datasets"] and store.read("dataset_records").count() == 1
