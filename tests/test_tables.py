"""Keyed tables, caches and chats: only touched buckets change, writers and readers don't disturb one another."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import links, store
from tessera.sources.keyed import KeyedTable, Taken

SCHEMA = "k string, v long"


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def _all(df):
    return sorted(tuple(r) for r in df.collect())


def test_put_get_delete(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 8)
    assert t.version() == 0 and _all(t.read()) == [] and _all(t.get(_rows(spark, ("a", 0)))) == []
    assert t.delete(_rows(spark, ("a", 0))) == 1 and t.put(_rows(spark, *((f"k{i}", i) for i in range(40)))) == 2
    t.put(_rows(spark, ("k1", 100), ("new", 7), (None, 1)))
    want = {f"k{i}": i for i in range(40)} | {"k1": 100, "new": 7}
    assert dict(_all(t.read())) == want
    assert _all(t.get(_rows(spark, ("k1", 0), ("k2", 0), ("gone", 0), (None, 0)))) == [("k1", 100), ("k2", 2)]
    t.delete(_rows(spark, ("k2", 0), ("never", 0)))
    assert dict(_all(t.read())) == {k: v for k, v in want.items() if k != "k2"}
    # an older version can still be read, until it is vacuumed
    assert dict(_all(t.read(2))) == {f"k{i}": i for i in range(40)}
    t.expire(F.col("v") < 10)
    assert all(v < 10 for _, v in _all(t.read()))
    now = _all(t.read())
    assert t.vacuum() > 0 and _all(t.read()) == now and KeyedTable(spark, t.path, SCHEMA, "k", 99).buckets == 8
    t.clear()
    assert _all(t.read()) == []
    t.put(_rows(spark, ("z", 1)))
    assert _all(t.read()) == [("z", 1)]


def test_repeated_keys_and_order(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 4)
    t.put(_rows(spark, ("a", 1), ("a", 9), ("a", 5), ("b", 2)), "v")
    assert _all(t.read()) == [("a", 9), ("b", 2)]
    with pytest.raises(ValueError, match="'a' exists"):
        t.put_new(_rows(spark, ("c", 3), ("a", 1)))
    t.put_new(_rows(spark, ("c", 3)))
    assert _all(t.read()) == [("a", 9), ("b", 2), ("c", 3)]


def _files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, "k", 16)
    t.put(_rows(spark, *((f"k{i}", i) for i in range(200))))
    before = _files(t.path)
    t.put(_rows(spark, ("k5", 1)))
    after = _files(t.path)
    assert len(before) == 16 and len(after) == 17 and all(after[p] == m for p, m in before.items())
    # a lookup opens one bucket's file alone
    asked = t.get(_rows(spark, ("k5", 0)))
    assert len({f for f in asked.inputFiles() if t.path in f}) == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    a, b = (KeyedTable(spark, path, SCHEMA, "k", 2) for _ in range(2))
    a.put(_rows(spark, ("a", 1)))
    publish, first = KeyedTable._publish, []

    def late(self, version, state):
        if not first:  # the other writer is faster, once
            first.append(1)
            b.put(_rows(spark, ("b", 2)))
        publish(self, version, state)

    monkeypatch.setattr(KeyedTable, "_publish", late)
    a.put(_rows(spark, ("a", 10), ("c", 3)))
    assert _all(a.read()) == [("a", 10), ("b", 2), ("c", 3)] and a.version() == 3
    monkeypatch.setattr(KeyedTable, "_publish", lambda self, version, state: (_ for _ in ()).throw(Taken("never")))
    with pytest.raises(Taken):
        a.put(_rows(spark, ("x", 1)))
    assert _all(a.read()) == [("a", 10), ("b", 2), ("c", 3)]


@pytest.mark.parametrize("kind", ["answers", "pages"])
def test_caches(spark, tmp_path, kind):
    at = lambda hour: F.lit(dt.datetime(2024, 1, 1, hour)).cast("timestamp")
    cache = store.Cache(spark, str(tmp_path / kind), hours=2)
    asked = spark.createDataFrame([("http://a",), ("http://b",), ("http://c",)], "url string").withColumn("cache_key", links.cache_key("url"))
    assert cache.get(asked, at(0)).count() == 0 and cache.missing(asked, at(0)).count() == 3
    cache.put(asked.where("url <> 'http://c'").withColumn("value", F.concat(F.lit("text of "), "url")), at(1))
    cache.put(asked.where("url = 'http://c'").withColumn("value", F.lit(None).cast("string")), at(1))
    got = {r["value"] for r in cache.get(asked, at(2)).collect()}
    assert got == {"text of http://a", "text of http://b"}
    assert [r["url"] for r in cache.missing(asked, at(2)).collect()] == ["http://c"]
    cache.put(asked.where("url = 'http://b'").withColumn("value", F.lit("again")), at(3))
    assert {r["value"] for r in cache.get(asked, at(4)).collect()} == {"again"}
    cache.expire(at(4))
    assert cache.table.read().count() == 1
    cache.delete(asked.where("url = 'http://b'"))
    assert cache.table.read().count() == 0
    cache.put(asked.withColumn("value", F.lit("x")), at(5))
    cache.clear()
    assert cache.get(asked, at(5)).count() == 0


def test_cache_without_an_end(spark, tmp_path):
    cache = store.Cache(spark, str(tmp_path / "c"))
    rows = spark.createDataFrame([("k", "v")], "cache_key string, value string")
    cache.put(rows, F.lit("1999-01-01").cast("timestamp"))
    assert [r["value"] for r in cache.get(rows, F.lit("2999-01-01").cast("timestamp")).collect()] == ["v"]


def test_chats_rewrite_one_bucket(spark, tmp_path):
    path = str(tmp_path / "chats")
    for i in range(4):
        store.save_chat(spark, path, (f"c{i}", "q", "r", dt.datetime(2024, 1, i + 1)))
    assert [r["id"] for r in store.chats(spark, path).collect()] == ["c3", "c2", "c1", "c0"]
    before = set(_files(path))
    store.delete_chat(spark, path, "c2")
    assert [r["id"] for r in store.chats(spark, path).collect()] == ["c3", "c1", "c0"]
    assert len(set(_files(path)) - before) <= 1
