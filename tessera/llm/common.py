"""Conventions that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word contract, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(text: str | Column = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def id_remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % mod


def is_remainder(doc_id: str | Column, mod: int, value: int) -> Column:
    """Whether the remainder is ``value``; false for a null id."""
    return F.coalesce(id_remainder(doc_id, mod) == value, F.lit(False))


def unused(df: DataFrame, name: str) -> str:
    """The name, longer by as many signs as it takes to be no column of ``df``, whatever the case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sub_batches(texts, most_chars: int = 4_000_000, most_rows: int = 4096):
    """Slices of a list of texts, bounded by characters and rows."""
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and (chars + len(text) > most_chars or i - start >= most_rows):
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


_DROPS: dict[str, Callable[[], None]] = {}
_owner = ""


def holds(owner: str, drop: Callable[[], None]) -> None:
    """``drop`` frees what an operator keeps in a worker process from task to task."""
    _DROPS[owner] = drop


def claim(owner: str) -> None:
    """Free what other operators keep: Spark hands a worker process on from stage to stage."""
    global _owner
    if owner == _owner:
        return
    _owner = owner
    for name, drop in _DROPS.items():
        if name != owner:
            drop()
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
