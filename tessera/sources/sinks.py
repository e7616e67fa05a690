"""Writers: collections, manifests as versions, caches, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Adds rows to a Parquet collection, in folders ``by`` if given."""
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def _pointer(spark, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark, path: str) -> list[int]:
    """Finished versions of a table in ``path``, oldest first."""
    fs, where = _pointer(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(done)


def write_version(df: DataFrame, path: str) -> int:
    """Writes the next version beside the old ones, so a table may be read while it is replaced.
    A version counts once it is complete."""
    version = (versions(df.sparkSession, path) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{path}/v={version}")
    return version


def read_version(spark, path: str, schema: str) -> DataFrame:
    """The newest complete version; no rows if there is none."""
    known = versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/v={known[-1]}") if known else spark.createDataFrame([], schema)


def log_row(spark, path: str, name: str, parameters: str, outputs: str) -> None:
    """Adds a line to an experiment log in CSV."""
    row = spark.createDataFrame([(name, parameters, outputs)], "experiment_name string, parameters string, outputs string")
    row.select(F.current_timestamp().alias("timestamp"), "*").write.mode("append").csv(path, header=True, escape='"')


def keyword_file(terms: DataFrame, path: str) -> None:
    """A bounded keyword list as one comma-separated line, sorted."""
    one = terms.agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def without(df: DataFrame, key: str, value) -> DataFrame:
    """A table without one key, to be written as its next version."""
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))
