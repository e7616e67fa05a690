"""Document quality scores and the filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.scalars import clamp, col, let

LEAST_CHARS, LEAST_SCORE = 50, 0.3


def quality_score(text, keywords: list[str] | None = None, n_tables=0, domain=0.0) -> Column:
    """A score from 0.1 to 1 of variety, sentence length, keywords, structure, tables and domain.

    Null texts, texts under LEAST_CHARS and texts without words get 0.1. Without keywords their part
    is 0.5. Keywords are compared as given with lower-case words. ``domain`` is a cosine, 0 if
    unknown; it isn't clamped at 0.
    """
    raw = col(text)

    def scored(clean: Column) -> Column:
        return let(T.words(clean), lambda w: let(F.array_distinct(w), lambda kinds: total(clean, w, kinds)))

    def flow(clean: Column) -> Column:
        def of(parts: Column) -> Column:
            mean = F.aggregate(parts, F.lit(0), lambda s, x: s + F.size(T.spaced_words(x))) / F.nullif(F.size(parts), F.lit(0))
            return F.when(F.size(parts) > 0, clamp(1 - F.abs(mean - 15) / 20, 0.0, 1.0)).otherwise(0.2)

        return let(T.sentences(clean), of)

    def total(clean: Column, w: Column, kinds: Column) -> Column:
        if keywords:
            hits = F.size(F.array_intersect(kinds, F.array(*map(F.lit, sorted(set(keywords))))))
            keyword = F.least(F.lit(1.0), hits / 10.0)
        else:
            keyword = F.lit(0.5)
        structure = 0.3 + 0.4 * T.has_paragraphs(raw).cast("int") + 0.3 * T.has_heading(raw).cast("int")
        tables = F.least(F.lit(1.0), 0.2 * (F.lit(n_tables) if isinstance(n_tables, int) else col(n_tables)))
        near = F.coalesce(F.lit(domain) if isinstance(domain, float) else col(domain), F.lit(0.0))
        parts = 0.25 * (F.size(kinds) / F.size(w)) + 0.15 * flow(clean) + 0.2 * keyword + 0.1 * structure + 0.1 * tables + 0.2 * near
        return F.when(F.size(w) == 0, 0.1).otherwise(let(parts, lambda x: clamp(x, 0.1, 1.0)))

    short = raw.isNull() | (F.length(raw) < LEAST_CHARS)
    return F.when(short, F.lit(0.1)).otherwise(let(T.collapse(raw), scored))


def keep_chunks(df: DataFrame, text: str = "text", score: str = "quality_score") -> DataFrame:
    """Rows long and good enough; a missing score counts as 0."""
    return df.where((F.length(text) >= LEAST_CHARS) & (F.coalesce(score, F.lit(0.0)) >= LEAST_SCORE))


def keep_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text isn't blank."""
    return df.where(F.trim(text) != "")
