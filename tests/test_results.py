"""Results that are replaced by experiment: failing writes, second writers, odd names."""

import threading

import pytest
from pyspark.sql import functions as F

from docsift.sources.results import Store
from docsift.sources.sinks import merge_results


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_failed_writes_change_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "r"))
    assert store.read() is None
    store.replace(spark.createDataFrame([("a", 1), ("b", 2)], "exp string, v int"))
    bad = spark.range(100).select(F.lit("a").alias("exp"), F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("int").alias("v"))
    with pytest.raises(Exception, match="lost"):
        store.replace(bad)
    assert rows(store.read()) == [("a", 1), ("b", 2)] and store.version()[0] == 1
    assert store.replace(spark.createDataFrame([("a", 9), ("a", 8)], "exp string, v int")) == 2
    assert rows(store.read()) == [("a", 8), ("a", 9), ("b", 2)] and rows(store.read(1)) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="columns"):
        store.replace(spark.createDataFrame([("a", "x")], "exp string, other string"))
    store.vacuum()
    assert rows(store.read()) == [("a", 8), ("a", 9), ("b", 2)]


def test_a_reader_keeps_its_version_while_others_write(spark, tmp_path):
    path = str(tmp_path / "r")
    before = merge_results(spark, path, spark.createDataFrame([("a", 1)], "exp string, v int"))
    merge_results(spark, path, spark.createDataFrame([("a", 2)], "exp string, v int"))
    assert rows(before) == [("a", 1)]


def test_writers_at_the_same_time(spark, tmp_path):
    path, failed = str(tmp_path / "r"), []

    def write(i):
        try:
            Store(spark, path).replace(spark.createDataFrame([(f"e{i}", i), ("shared", i)], "exp string, v int"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    got = rows(Store(spark, path).read())
    assert [r for r in got if r[0] != "shared"] == [(f"e{i}", i) for i in range(6)] and len(got) == 7
    assert Store(spark, path).version()[0] == 6


def test_odd_names_and_no_rows(spark, tmp_path):
    store, names = Store(spark, str(tmp_path / "r")), ["exp 1/2", "Threshold=0.3", "ü%20", "25% (low)", "a:b"]
    store.replace(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "exp string, v int"))
    assert {r["exp"] for r in store.read().collect()} == set(names)
    store.replace(spark.createDataFrame([], "exp string, v int"))
    assert store.read().count() == len(names)
