"""Incremental ingestion: change detection by content hash, chunk rows, storing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import col
from tessera.operators.chunking import chunks
from tessera.operators.quality import keep_chunks, keep_texts, quality_score
from tessera.plans.config import ChunkConfig


def content_hash(content) -> Column:
    return F.sha2(col(content), 256)


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are new or whose hash differs; files without a hash go."""
    known = manifest.select("path", "content_hash")
    return files.where(F.col("content_hash").isNotNull()).join(known, ["path", "content_hash"], "left_anti")


def with_state(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and state of every file: `new`, `modified` or `unchanged`."""
    old = manifest.select("path", F.col("content_hash").alias("__old"))
    state = F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col("content_hash"), "unchanged").otherwise("modified")
    return files.join(old, "path", "left").select("path", state.alias("state"))


def next_manifest(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest after ``done`` was ingested; empty files count as ingested."""
    new = done.select("path", "content_hash")
    return manifest.join(new.select("path"), "path", "left_anti").unionByName(new)


def chunk_rows(files: DataFrame, keywords: list[str] | None = None, cfg: ChunkConfig | None = None) -> DataFrame:
    """Chunks to store, from path and text: each scored by itself, short and poor ones left out."""
    cfg = cfg or ChunkConfig()
    made = chunks(keep_texts(files), cfg)
    scored = made.withColumn("quality_score", quality_score("page_content", keywords))
    return keep_chunks(scored, "page_content", "quality_score")


def replace_source(stored: DataFrame, new: DataFrame, source: str = "path") -> DataFrame:
    """Stored chunks without those of changed sources, and the new ones: no stale chunk remains."""
    return stored.join(new.select(source).distinct(), source, "left_anti").unionByName(new, allowMissingColumns=True)


def first_by_hash(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """content_hash, the smallest id with it, and how many rows have it."""
    return df.groupBy(content_hash(F.coalesce(F.col(text), F.lit(""))).alias("content_hash")).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"))
