"""The domain gate: dense and sparse relevance of queries, fused and compared with a threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.scalars import clamp, col, let
from tessera.functions.vector import cosine
from tessera.plans.config import GateConfig

LEAST_QUERY = 3


def sanitized(df: DataFrame, query: str = "text") -> DataFrame:
    """Adds clean (the sanitised query) and valid (at least LEAST_QUERY characters)."""
    out = df.withColumn("clean", T.sanitize(F.coalesce(col(query), F.lit(""))))
    return out.withColumn("valid", F.length("clean") >= LEAST_QUERY)


def sparse_score(terms, keywords: list[str]) -> Column:
    """Share of topic terms that are keywords; repeated terms count each time, keywords as given."""
    known = F.array(*map(F.lit, sorted(set(keywords)))) if keywords else F.array().cast("array<string>")

    def share(t: Column) -> Column:
        hits = F.size(F.filter(t, lambda x: F.array_contains(known, x)))
        return F.when(F.size(t) > 0, hits / F.size(t)).otherwise(0.0)

    return let(T.topic_terms(terms), share)


def semantic_score(vector, centroid) -> Column:
    """Cosine to the centroid within [0, 1]; 0 without a centroid or for a zero vector."""
    return F.coalesce(clamp(cosine(vector, centroid), 0.0, 1.0), F.lit(0.0))


def fused_score(semantic, sparse, cfg: GateConfig | None = None) -> Column:
    cfg = cfg or GateConfig()
    return cfg.semantic_weight * col(semantic) + cfg.sparse_weight * col(sparse)


def gate(df: DataFrame, keywords: list[str], vector: str | None = None, centroid=None, cfg: GateConfig | None = None, query: str = "text") -> DataFrame:
    """Adds clean, valid, semantic, sparse, fused and relevant. Scores aren't rounded before the
    comparison. Null and short queries are neither valid nor relevant."""
    cfg = cfg or GateConfig()
    out = sanitized(df, query).withColumn("sparse", sparse_score(T.query_terms("clean"), keywords))
    near = semantic_score(vector, centroid) if vector and centroid is not None else F.lit(0.0)
    out = out.withColumn("semantic", near).withColumn("fused", fused_score("semantic", "sparse", cfg))
    return out.withColumn("relevant", F.col("valid") & (F.col("fused") >= cfg.threshold))
