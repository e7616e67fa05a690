"""Tables with a key whose changes rewrite only the hash buckets they touch.

A change writes the touched buckets to a folder of its own and then publishes a pointer, a small file
that names each bucket's folder. Readers follow the newest pointer, so they see a change whole or not at
all; a pointer's name can be taken once, so of two writers one has to start over from the other's state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, settle

#: Hash buckets of a new table, times a change is tried against other writers.
BUCKETS, TRIES = 32, 20
_BUCKET = "__bucket"


class Taken(Exception):
    """Another writer has published first."""


class KeyedTable:
    """Rows of ``schema`` with one row for each value of ``key``; null keys are never stored."""

    def __init__(self, spark, path: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.columns = spark.createDataFrame([], schema).columns
        self.buckets = self._state()[1].get("buckets", buckets)

    # pointers

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _pointers(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/_pointers")
        if not fs.exists(where):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(int(n) for n in names if n.isdigit())

    def _state(self, version: int | None = None) -> tuple[int, dict]:
        """A version's number and pointer; 0 and none for a table that isn't there."""
        known = self._pointers()
        if not known:
            return 0, {}
        version = known[-1] if version is None else version
        fs, where = self._fs(f"{self.path}/_pointers/{version}")
        stream = fs.open(where)
        try:
            raw = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        return version, json.loads(raw)

    def _publish(self, version: int, state: dict) -> None:
        """Write the pointer beside, then give it its name: renaming fails if the name is taken."""
        fs, draft = self._fs(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        _, final = self._fs(f"{self.path}/_pointers/{version}")
        fs.mkdirs(final.getParent())
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Taken(f"version {version} of {self.path}")

    def version(self) -> int:
        return self._state()[0]

    # reading

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _load(self, state: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        folders = state.get("folders", {})
        wanted = folders if buckets is None else [str(b) for b in buckets if str(b) in folders]
        paths = sorted(f"{self.path}/{folders[b]}/{_BUCKET}={b}" for b in wanted if folders[b])
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the newest version or another that is still there."""
        return self._load(self._state(version)[1])

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r[0] for r in keys.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect()]  # at most one row a bucket

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of these keys, from their buckets alone."""
        keys = keys.select(F.col(self.key)).where(F.col(self.key).isNotNull()).distinct()
        return self._load(self._state()[1], self._touched(keys)).join(keys, self.key, "left_semi")

    # changes

    def _change(self, touched: list[int] | None, make: Callable[[DataFrame], DataFrame]) -> int:
        """Put what ``make`` gives for the rows of the touched buckets in their place; the new version."""
        for _ in range(TRIES):
            version, state = self._state()
            folders = dict(state.get("folders", {}))
            some = [int(b) for b in folders] if touched is None else touched
            if not some:
                return version
            folder = f"g={uuid.uuid4().hex}"
            new = make(self._load(state, some)).select(*self.columns).withColumn(_BUCKET, self._bucket(F.col(self.key)))
            # a bucket is one file: they are small beside what a change would rewrite otherwise
            new.repartition(len(some), _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
            fs, where = self._fs(f"{self.path}/{folder}")
            filled = {s.getPath().getName().split("=")[1] for s in fs.listStatus(where) if s.isDirectory()}
            for b in map(str, some):
                folders[b] = folder if b in filled else ""
            try:
                self._publish(version + 1, {"buckets": self.buckets, "folders": folders})
                return version + 1
            except Taken:
                fs.delete(where, True)
        raise Taken(f"{TRIES} writers were faster at {self.path}")

    def put(self, rows: DataFrame, order: str | None = None) -> int:
        """Add rows, each in place of the one with its key. Of several rows with one key the greatest by
        ``order`` stays, and any one of them without an order."""
        rows = rows.where(F.col(self.key).isNotNull()).select(*self.columns)
        one = F.struct(*self.columns)
        best = F.max_by(one, order) if order else F.first(one)
        # settled, as they are read to find their buckets and again for every try
        rows = settle(rows.groupBy(F.col(self.key).alias("__key")).agg(best.alias("__row")).select("__row.*"))
        try:
            return self._change(self._touched(rows), lambda old: old.join(rows.select(self.key), self.key, "left_anti").unionByName(rows))
        finally:
            discard(rows)

    def put_new(self, rows: DataFrame) -> int:
        """Add rows; raises before anything is written if a key is there already."""

        def make(old: DataFrame) -> DataFrame:
            there = old.join(rows.select(self.key), self.key, "left_semi").select(self.key).first()
            if there:
                raise ValueError(f"{self.key} {there[0]!r} exists")
            return old.unionByName(rows.select(*self.columns))

        return self._change(self._touched(rows.where(F.col(self.key).isNotNull())), make)

    def delete(self, keys: DataFrame) -> int:
        keys = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        return self._change(self._touched(keys), lambda old: old.join(keys, self.key, "left_anti"))

    def expire(self, kept: Column) -> int:
        """Drop the rows for which ``kept`` isn't true."""
        return self._change(None, lambda old: old.where(F.coalesce(kept, F.lit(False))))

    def clear(self) -> int:
        return self.expire(F.lit(False))

    def vacuum(self, keep: int = 1) -> int:
        """Delete what only versions before the newest ``keep`` use; the folders deleted. No reader or writer may be at these."""
        known = self._pointers()
        used = {f for v in known[-keep:] for f in self._state(v)[1]["folders"].values()}
        fs, where = self._fs(self.path)
        gone = [s.getPath() for s in (fs.listStatus(where) if known else []) if s.getPath().getName().startswith("g=") and s.getPath().getName() not in used]
        for path in gone:
            fs.delete(path, True)
        for v in known[:-keep]:
            fs.delete(self._fs(f"{self.path}/_pointers/{v}")[1], False)
        return len(gone)
