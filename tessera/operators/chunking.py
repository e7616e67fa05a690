"""Recursive splitting of texts into overlapping chunks, sizes in characters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.config import ChunkConfig
from tessera.session import ship

#: Coarse to fine; the last one cuts between characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def _cut(text: str, separator: str) -> list[str]:
    """Parts of a text, each separator at the start of the part it opens."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _join(parts: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring parts put together up to the size; a chunk repeats the end of the one before."""
    out, first, length = [], 0, 0
    for i, part in enumerate(parts):
        if length + len(part) > size and first < i:
            out.append("".join(parts[first:i]).strip())
            while length > overlap or (length and length + len(part) > size):
                length -= len(parts[first])
                first += 1
        length += len(part)
    out.append("".join(parts[first:]).strip())
    return [c for c in out if c]


def split_text(text: str, size: int = 345, overlap: int = 56, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that serves."""
    at = next(i for i, s in enumerate(separators) if s in text)
    finer, out, run = separators[at + 1 :], [], []
    for part in _cut(text, separators[at]):
        if len(part) < size or not finer and len(part) <= size:
            run.append(part)
            continue
        out += _join(run, size, overlap) if run else []
        run = []
        out += split_text(part, size, overlap, finer) if finer else [part]
    return out + (_join(run, size, overlap) if run else [])


def chunks(df: DataFrame, cfg: ChunkConfig | None = None, text: str = "text") -> DataFrame:
    """The rows of ``df`` once for each chunk, with chunk_no from 0 and page_content in place of the
    text. Null and blank texts give no chunk. Arrow batches of bounded size go to Python."""
    cfg = cfg or ChunkConfig()
    ship(df.sparkSession)

    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, cfg.size, cfg.overlap) if t else [])

    made = F.posexplode(F.pandas_udf(split, "array<string>")(F.col(text))).alias("chunk_no", "page_content")
    return df.select(*(c for c in df.columns if c != text), made)
