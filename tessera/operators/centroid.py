"""Centroids of embedding tables: mean, statistics, histogram, drift and renewal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vector import cosine, cosine_distance, l2_distance, vector


def vectors(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows that have a vector, with it alone beside their other columns."""
    return df.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0))


def centroid(df: DataFrame, by: list[str] | None = None, embedding: str = "embedding") -> DataFrame:
    """The element-wise mean of all vectors, of each group ``by`` if given.

    One row per position is aggregated, with partial sums before the shuffle: what moves is
    dimensions times groups times tasks, whatever the number of vectors.
    """
    by = by or []
    parts = vectors(df, embedding).select(*by, F.posexplode(vector(embedding)).alias("pos", "x"))
    means = parts.groupBy(*by, "pos").agg(F.avg("x").alias("m"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    return means.groupBy(*by).agg(whole.alias("centroid"))


def centroid_or_zero(df: DataFrame, dim: int, embedding: str = "embedding") -> DataFrame:
    """One row: the centroid, or a zero vector of ``dim`` for an empty collection."""
    return centroid(df, embedding=embedding).select(F.when(F.size("centroid") > 0, F.col("centroid")).otherwise(F.array_repeat(F.lit(0.0), dim)).alias("centroid"))


def statistics(one: DataFrame, centroid_col: str = "centroid") -> DataFrame:
    """Size, mean, population deviation, quartiles by interpolation, extremes and length of a vector."""
    x = one.select(F.explode(centroid_col).alias("x"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return x.agg(
        F.count("x").alias("dimension_count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std_dev"), F.min("x").alias("min"), q.alias("q"), F.max("x").alias("max"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("l2_norm")
    ).select("dimension_count", "mean", "std_dev", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "max", "l2_norm")


def histogram(one: DataFrame, bins: int = 50, centroid_col: str = "centroid") -> DataFrame:
    """Equal-width bins (1-based) of a vector's values; the last is closed, equal values are one bin."""
    v = F.col(centroid_col)
    x = one.select(F.explode(v).alias("x"), F.array_min(v).alias("low"), F.array_max(v).alias("high"))
    bin_ = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * bins) + 1, F.lit(bins))).otherwise(1)
    return x.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def insight(query, centre) -> Column:
    """struct<distance, similarity> of a query vector to a centroid."""
    return F.struct(l2_distance(query, centre).alias("distance"), cosine(query, centre).alias("similarity"))


def drift(old, new) -> Column:
    """How far a centroid has moved; null if either is missing."""
    return l2_distance(old, new)


def needs_renewal(n_new, n_all, old, mean_all, share: float = 0.5, diversity: float = 0.01) -> Column:
    """Whether to compute the centroid anew: no vectors, many new ones, or a mean that has moved.
    A zero old centroid has no direction and doesn't count as moved."""
    moved = F.coalesce(cosine_distance(old, mean_all) >= diversity, F.lit(False))
    return (n_all == 0) | (n_new / n_all >= share) | moved


def renewal_allowed(mode, needed) -> Column:
    return F.when(mode == "always", True).when(mode == "auto", needed).otherwise(False)
