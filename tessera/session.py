"""Session helpers: code shipping, shared scratch tables, partition counts."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of an Arrow batch that a Python worker holds.
BATCH_BYTES = 4 << 20
ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver has it in."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
    # long texts come in small batches, so a Python worker's memory stays bounded
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared folder; a local one only on a local master, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or 'file:///tmp/checkpoints').rstrip('/')}/tessera/{spark.sparkContext.applicationId}"


#: Tables written in each open scratch scope; applications whose folder goes when the driver ends.
_SCOPES: list[list[str]] = []
_ENDS: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _at_end(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:  # not stopped yet
        _delete(spark, root)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``settle`` writes inside go when the block ends, so write the result inside."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def settle(df: DataFrame, outlive: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as a table in the shared scratch folder and read it back.

    This cuts the lineage: lost executors cost only what has not been written yet. The table goes with
    the innermost ``scratch`` block (with the one around it for ``outlive``), or when the driver ends. ``options`` go to the writer.
    """
    spark = df.sparkSession
    root = scratch_root(spark)
    if root not in _ENDS:
        _ENDS.add(root)
        atexit.register(_at_end, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    scopes = _SCOPES[:-1] if outlive else _SCOPES
    if scopes:
        scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``settle`` wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        _delete(df.sparkSession, path)
