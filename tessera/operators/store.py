"""Stored objects: collections, caches by key, chats, centroids, instances; names and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import col, iso_utc
from tessera.sources import sinks
from tessera.sources.keyed import KeyedTable

#: What a stored object has, and what stands in for missing values.
PROPERTIES = {"text": "", "source": "unknown", "filetype": "unknown", "page": 0}
CENTROIDS = "name string, centroid array<double>, n long, updated_at timestamp"
CHATS = "id string, question string, response string, created_at timestamp"


def properties(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The stored properties with their defaults, typed, and ``extra`` columns as they are."""
    have = [
        F.coalesce(F.col(c).try_cast("int" if isinstance(d, int) else "string"), F.lit(d)).alias(c) if c in df.columns else F.lit(d).alias(c)
        for c, d in PROPERTIES.items()
    ]
    return df.select(*have, *(extra or []))


def metadata(files: DataFrame, now=None) -> DataFrame:
    """``files`` with source, created and modified (RFC 3339), page, content_flags and error_messages.

    A column ``created`` of times, ``page``, ``content_flags`` or ``error_messages`` stays as it is. File systems
    expose no time of creation, so without one the time of modification stands for it, and ``now`` for
    a missing time, with a line in error_messages.
    """
    have = set(files.columns)
    lost = F.col("modified").isNull()
    when = iso_utc(F.coalesce(F.col("modified"), now if now is not None else F.current_timestamp()))
    made = iso_utc(F.coalesce(F.col("created"), F.col("modified"))) if "created" in have else when
    none = F.array().cast("array<string>")
    kept = lambda c: F.coalesce(F.col(c), none) if c in have else none
    errors = F.when(lost, F.concat(kept("error_messages"), F.array(F.lit("no time of modification")))).otherwise(kept("error_messages"))
    name = F.element_at(F.split("path", "/"), -1)
    page = F.coalesce(F.col("page").try_cast("int"), F.lit(0)) if "page" in have else F.lit(0)
    return files.withColumns({"source": name, "created": made, "modified": when, "page": page, "content_flags": kept("content_flags"), "error_messages": errors})


def store(df: DataFrame, path: str, vector: str = "embedding") -> int:
    """Appends objects with their vectors; raises before writing if any vector is missing. The rows written."""
    rows, vectors = df.agg(F.count(F.lit(1)), F.count(vector)).first()
    if rows != vectors:
        raise ValueError(f"{rows} objects but {vectors} vectors")
    sinks.append(df, path)
    return rows


def create_collection(spark, name: str, schema: str) -> None:
    """A Parquet table of this schema, unless there is one of this name."""
    if not (name and all(c.isascii() and (c.isalnum() or c == "_") for c in name)):
        raise ValueError(f"not a name for a collection: {name!r}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet")


def is_collection_name(name) -> Column:
    return F.coalesce(col(name).rlike("^[A-Za-z0-9_]+$"), F.lit(False))


def is_instance_name(name, most: int = 50) -> Column:
    return F.coalesce(col(name).rlike("^[a-zA-Z0-9_-]+$") & (F.length(col(name)) <= most), F.lit(False))


def ingestion_counts(df: DataFrame, chars="n_chars", least: int = 50) -> DataFrame:
    """One row: processed, rejected (too short) and failed (no text) objects."""
    size = col(chars)
    return df.agg(
        F.count_if(size >= least).alias("processed"), F.count_if(size < least).alias("rejected"), F.count_if(size.isNull()).alias("failed")
    )


def file_sizes(files: DataFrame, kind: str = "filetype", size: str = "length") -> DataFrame:
    """filetype, files, total, mean and share of all files."""
    each = files.groupBy(F.col(kind).alias("filetype")).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("total"), F.avg(size).alias("mean"))
    whole = files.agg(F.count(F.lit(1)).alias("n"))  # one row
    return each.join(F.broadcast(whole)).select("filetype", "files", "total", "mean", (F.col("files") / F.col("n")).alias("share"))


def batch_size(files: DataFrame, memory_gb: float = 8.0, kind: str = "filetype", size: str = "length") -> DataFrame:
    """batch: how many files to take at a time, one row. Half as many where files are large (over 10 MB on
    average) or mostly PDFs, twice as many where they are small (up to 1 MB) and few are; 10 without files."""
    base = 2 if memory_gb < 2 else 4 if memory_gb < 4 else 8
    mean, pdfs = F.avg(size) / (1 << 20), F.avg((F.lower(F.ltrim(F.col(kind), F.lit("."))) == "pdf").cast("int"))
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(pdfs, F.lit(0.0)).alias("pdfs"))
    heavy, middling = (F.col("mean") > 10) | (F.col("pdfs") > 0.7), (F.col("mean") > 1) | (F.col("pdfs") > 0.3)
    batch = F.when(F.col("n") == 0, 10).when(heavy, max(2, base // 2)).when(middling, max(4, base)).otherwise(max(6, 2 * base))
    return seen.select(batch.alias("batch"))


def lookup(asked: DataFrame, cache: DataFrame, key: str, value: str, computed=None, now=None, ttl_hours: float | None = None, at: str = "fetched_at", order=None) -> DataFrame:
    """``asked`` with hit and value: the cached one if there is a fresh one, else ``computed``.

    A key that was written several times gives its newest value, or its greatest by ``order``, a column of the cache.
    """
    known = cache.where(F.col(key).isNotNull())
    if ttl_hours is not None:
        known = known.where(F.unix_timestamp(now) - F.unix_timestamp(at) <= ttl_hours * 3600)
    newest = known.groupBy(key).agg(F.max_by(value, at if order is None else order).alias("__cached"), F.lit(True).alias("__hit"))
    out = asked.join(newest, key, "left")
    fallback = F.lit(None) if computed is None else col(computed)
    return out.withColumn("hit", F.coalesce("__hit", F.lit(False))).withColumn(value, F.when(F.col("hit"), F.col("__cached")).otherwise(fallback)).drop("__cached", "__hit")


def clear(spark, path: str, schema: str) -> int:
    """A cache's next version, empty."""
    return sinks.write_version(spark.createDataFrame([], schema), path)


def chat_table(spark, path: str) -> KeyedTable:
    return KeyedTable(spark, path, CHATS, "id")


def save_chat(spark, path: str, chat: tuple) -> int:
    """Adds (id, question, response, created_at); an id that is there already raises. Only the id's bucket is rewritten."""
    return chat_table(spark, path).put_new(spark.createDataFrame([chat], CHATS))


def delete_chat(spark, path: str, id_: str) -> int:
    return chat_table(spark, path).delete(spark.createDataFrame([(id_,)], "id string"))


def chats(spark, path: str) -> DataFrame:
    return newest_first(chat_table(spark, path).read(), "created_at", "id")


class Cache:
    """Values by key with the time they were fetched: answers by the md5 of the question and its history,
    pages by the md5 of their address. ``hours`` is how long a value is fresh; without it, for good."""

    def __init__(self, spark, path: str, kind: str = "string", hours: float | None = None):
        self.table = KeyedTable(spark, path, f"cache_key string, value {kind}, fetched_at timestamp", "cache_key")
        self.hours = hours

    def _fresh(self, now: Column) -> Column:
        return F.lit(True) if self.hours is None else F.unix_timestamp(now) - F.unix_timestamp("fetched_at") <= self.hours * 3600

    def put(self, rows: DataFrame, now: Column, key: str = "cache_key", value: str = "value") -> int:
        """Stores the rows' values as fetched at ``now``; of repeated keys one value stays. Null values are not stored."""
        return self.table.put(rows.where(F.col(value).isNotNull()).select(F.col(key).alias("cache_key"), F.col(value).alias("value"), now.alias("fetched_at")), "fetched_at")

    def get(self, keys: DataFrame, now: Column, key: str = "cache_key") -> DataFrame:
        """cache_key, value and fetched_at of the keys that are there and fresh."""
        return self.table.get(keys.select(F.col(key).alias("cache_key"))).where(self._fresh(now))

    def missing(self, keys: DataFrame, now: Column, key: str = "cache_key") -> DataFrame:
        """The rows of ``keys`` without a fresh value: what is to be computed or fetched."""
        return keys.join(self.get(keys, now, key).select(F.col("cache_key").alias(key)), key, "left_anti")

    def delete(self, keys: DataFrame, key: str = "cache_key") -> int:
        return self.table.delete(keys.select(F.col(key).alias("cache_key")))

    def expire(self, now: Column) -> int:
        """Drops what is no longer fresh."""
        return self.table.expire(self._fresh(now))

    def clear(self) -> int:
        return self.table.clear()


def newest_first(df: DataFrame, at: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(at), key)


def save_centroid(centroid: DataFrame, path: str, name: str, now) -> int:
    """The centroid (columns centroid and n) as the next version of its own table, with its time."""
    return sinks.write_version(centroid.select(F.lit(name).alias("name"), "centroid", F.col("n").cast("long").alias("n"), now.alias("updated_at")), path)


def load_centroid(spark, path: str) -> DataFrame:
    return sinks.read_version(spark, path, CENTROIDS)


def active_first(instances: DataFrame, active, name: str) -> DataFrame:
    return instances.orderBy(F.when(col(active), 0).otherwise(1), name)


def preview(df: DataFrame, key: str, n: int = 50, vector: str = "embedding") -> DataFrame:
    """The first n objects by key, without their vector."""
    return df.drop(vector).orderBy(key).limit(n)


def size_options(n, step: int = 10) -> Column:
    """step, 2 step, ... below n, and n itself."""
    most = col(n)
    return F.array_distinct(F.concat(F.when(most >= step, F.sequence(F.lit(step), most, F.lit(step))).otherwise(F.array().cast("array<int>")), F.array(most)))


def toggled(active, term) -> Column:
    """An array of active terms with ``term`` switched."""
    one = F.array(col(term))
    return F.when(F.array_contains(col(active), col(term)), F.array_except(col(active), one)).otherwise(F.array_union(col(active), one))


def term_line(term, score) -> Column:
    return F.concat(col(term), F.lit(": "), F.format_string("%.4f", col(score)))


def parsed_line(line) -> Column:
    """struct<term, score> of a line `term : score`; null if it has no such score."""
    parts = F.split(col(line), " : ", 2)
    score = F.get(parts, F.lit(1)).try_cast("double")
    return F.when(score.isNotNull(), F.struct(F.trim(F.get(parts, F.lit(0))).alias("term"), score.alias("score")))
