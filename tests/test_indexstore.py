"""The index on disk: write, replace, delete, readers of one version, stops between two steps, two writers."""

import pytest
from pyspark.sql import functions as F

from supportlake.operators import index
from supportlake.operators.indexstore import IndexStore

SHAPE = "source_file string, chunk_index int, text string, access_level int"


def rows(spark, *sources, text="t"):
    return spark.createDataFrame([(s, i, f"{text}{i}", None) for s in sources for i in range(2)], SHAPE)


def held(store, version=None):
    return sorted((r.source_file or "", r.chunk_index, r.text) for r in store.read(version).collect())


def test_writing_one_source_again_keeps_the_others(spark, tmp_path):
    many = spark.range(200).select(F.concat(F.lit("s"), "id").alias("source_file"), F.lit(0).alias("chunk_index"), F.lit("x").alias("text"), F.lit(None).cast("int").alias("access_level"))
    index.write_index(many, f"file://{tmp_path}/ix", None)
    store = index.write_index(many.filter("source_file = 's0'"), f"file://{tmp_path}/ix", None)
    assert store.read().count() == 200 and store.read().select("source_file").distinct().count() == 200


def test_replace_delete_and_old_versions(spark, tmp_path):
    store = IndexStore(spark, f"{tmp_path}/ix", 4)
    assert store.read() is None and store.delete("d", rows(spark, "a")).count() == 0
    assert store.replace("1", rows(spark, "a", "b", None)) and not store.replace("1", rows(spark, "c"))
    first = store.read()
    assert store.replace("2", rows(spark, "a", text="new").filter("chunk_index = 0").withColumn("extra", F.lit(5)))
    assert held(store) == sorted([("a", 0, "new0"), *[(s, i, f"t{i}") for s in ("b", "") for i in range(2)]]) and store.read().filter("extra = 5").count() == 1
    assert first.count() == 6 and held(store, 1) == sorted((s, i, f"t{i}") for s in ("a", "b", "") for i in range(2))
    assert [tuple(r) for r in store.delete("3", rows(spark, "b", "zz")).collect()] == [("b", 2)] and store.delete("3", rows(spark, "a")).count() == 0
    assert {s for s, *_ in held(store)} == {"a", ""} and store.delete("4", rows(spark, None)).first().deleted == 2
    assert store.replace("5", rows(spark).limit(0), rows(spark, "a").select("source_file")) and held(store) == []
    assert IndexStore(spark, f"{tmp_path}/ix", 64).manifest()["n_buckets"] == 4
    assert store.replace("6", rows(spark, "n")) and [s for s, *_ in held(store)] == ["n", "n"]
    assert len(store.vacuum(keep=1, older_than_seconds=-10)) >= 3 and len(held(store)) == 2 and store.versions() == [6]


def test_a_stop_between_two_steps_changes_nothing(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, f"{tmp_path}/ix", 4)
    store.replace("1", rows(spark, "a", "b"))
    before = held(store)

    def stop(self, manifest):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(IndexStore, "_publish", stop)
        with pytest.raises(RuntimeError):
            store.replace("2", rows(spark, "a", text="half"))
    assert held(store) == before and store.versions() == [1]
    assert store.replace("2", rows(spark, "a", text="whole")) and not store.replace("2", rows(spark, "a", text="whole"))
    assert [t for s, _, t in held(store) if s == "a"] == ["whole0", "whole1"]
    assert len(store.vacuum(keep=1, older_than_seconds=-10)) == 1  # what the stopped one left


def test_of_two_writers_both_end_up_in_the_index(spark, tmp_path, monkeypatch):
    store, other = IndexStore(spark, f"{tmp_path}/ix", 1), IndexStore(spark, f"{tmp_path}/ix", 1)
    store.replace("1", rows(spark, "a"))
    publish, met = IndexStore._publish, []

    def late(self, manifest):
        if self is store and not met:  # another commit comes between this one's reading and its rename
            met.append(True)
            assert other.replace("3", rows(spark, "c"))
        return publish(self, manifest)

    monkeypatch.setattr(IndexStore, "_publish", late)
    assert store.replace("2", rows(spark, "b")) and met == [True]
    assert {s for s, *_ in held(store)} == {"a", "b", "c"} and store.versions() == [1, 2, 3]
    assert store._publish({"version": 2}) is False
