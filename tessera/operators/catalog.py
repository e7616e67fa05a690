"""Counts over collections and their sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """collection and objects of each table."""
    each = [t.agg(F.count(F.lit(1)).alias("objects")).select(F.lit(name).alias("collection"), "objects") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, each)


def schema_listing(spark, tables: dict[str, DataFrame]) -> DataFrame:
    """collection, property and type of each table's columns, from metadata alone."""
    rows = [(name, f.name, f.dataType.simpleString()) for name, t in tables.items() for f in t.schema]
    return spark.createDataFrame(rows, "collection string, property string, type string")


def by_source(df: DataFrame, source: str = "source") -> DataFrame:
    return df.where(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("objects"))


def source_summary(df: DataFrame, source: str = "source") -> DataFrame:
    """Number of sources and mean rows of a source to two places, 0 if there is none."""
    return by_source(df, source).agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.round(F.avg("objects"), 2), F.lit(0.0)).alias("mean_objects"))


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """``df`` with batch, the number of its slice of ``size`` rows within ``order``.

    Ranges of the order are numbered in parallel; only a count of each range is gathered.
    """
    from pyspark.sql import Window

    from tessera.session import shuffle_partitions

    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), order).withColumn("__p", F.spark_partition_id())
    local = ranged.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(order)))
    sizes = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    starts = sizes.select("__p", F.coalesce(before, F.lit(0)).alias("__start"))
    numbered = local.join(F.broadcast(starts), "__p")
    return numbered.withColumn("batch", F.floor((F.col("__start") + F.col("__i") - 1) / size)).drop("__p", "__i", "__start")
