"""Embedding and generating models over tables: loaded once a worker, called in batches, retried with backoff.

A model is given as a function that makes it, so that it is made on the worker. A text whose call fails for
good becomes a row with its error; the others go on.
"""

from __future__ import annotations

import hashlib
import math
import time
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import store
from tessera.session import ship


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        """A vector for each text."""


class Generator(Protocol):
    def generate(self, prompts: Sequence[str]) -> Sequence[str]:
        """An answer to each prompt."""


class Tagger(Protocol):
    def tag(self, terms: Sequence[str]) -> Sequence[Sequence[tuple[str, str]]]:
        """(token, kind) of each term's tokens; kinds as NOUN, PROPN, VERB, PUNCT, SPACE."""


@dataclass(frozen=True)
class Calls:
    """Texts of a call, tries, and the wait before a try: ``wait`` doubled each time, ``most`` at most (seconds)."""

    batch: int = 32
    attempts: int = 3
    wait: float = 2.0
    most: float = 10.0

    def pause(self, tries: int) -> float:
        return min(self.most, self.wait * 2 ** (tries - 1))


@dataclass(frozen=True)
class HashedNgrams:
    """An embedder without training: signed hash buckets of words and of the letters within them, unit length.

    Any script counts, as letters are hashed as they are. A text without words has the zero vector.
    """

    dim: int = 256
    least: int = 3
    most: int = 5

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        number: dict[str, int] = {}  # the words of all texts, which share many, are hashed once
        text, word, times = [], [], []
        for i, t in enumerate(texts):
            counted = Counter(t.lower().split())
            text += [i] * len(counted)
            word += [number.setdefault(w, len(number)) for w in counted]
            times += counted.values()
        text, word, times = (np.array(x, "i8") for x in (text, word, times))
        order = np.argsort(word, kind="stable")
        text, word, times = text[order], word[order], times[order]
        out = np.zeros((len(texts), self.dim))
        for begin, words in _stretches(list(number)):
            of, h = _grams(words, self.least, self.most)
            starts = np.searchsorted(of, np.arange(len(words) + 1))
            here = slice(*np.searchsorted(word, (begin, begin + len(words))))
            first, many = starts[word[here] - begin], np.diff(starts)[word[here] - begin]
            at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())
            signed = np.where(h[at] & 0x80000000, 1.0, -1.0) * np.repeat(times[here], many)
            out += np.bincount(np.repeat(text[here], many) * self.dim + h[at] % self.dim, signed, out.size).reshape(out.shape)
        size = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]  # whole numbers: sums are exact in any order
        return np.divide(out, size, out=out, where=size > 0).tolist()


#: Characters of words that are hashed together.
HASHED = 50_000
_CRC = np.arange(256, dtype="i8")
for _ in range(8):
    _CRC = (_CRC >> 1) ^ np.where(_CRC & 1, 0xEDB88320, 0)


def _stretches(words: list[str]) -> Iterator[tuple[int, list[str]]]:
    begin = chars = 0
    for i, w in enumerate(words):
        if i > begin and chars + len(w) > HASHED:
            yield begin, words[begin:i]
            begin, chars = i, 0
        chars += len(w)
    if words:
        yield begin, words[begin:]


def _grams(words: list[str], least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, CRC-32 in UTF-8) of each word's distinct grams, and of the framed word itself, by word."""
    framed = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
    plain, code = code, np.where((code >= 0xD800) & (code < 0xE000), ord("?"), code)
    size = np.array([len(f) for f in framed])
    of, left = np.repeat(np.arange(len(words)), size), np.repeat(np.cumsum(size), size) - np.arange(len(code))
    wide = (code >= 0x80).astype("i8") + (code >= 0x800) + (code >= 0x10000)  # bytes after the first
    lead = np.array([0, 0xC0, 0xE0, 0xF0])[wide] | (code >> (6 * wide))
    state, found = np.full(len(code), 0xFFFFFFFF), []
    keys = np.zeros((-(-most // 3), len(code)), "i8")  # three characters each
    for n in range(1, most + 1):
        go = np.flatnonzero(left >= n)
        at = go + n - 1
        state[go] = _CRC[(state[go] ^ lead[at]) & 0xFF] ^ (state[go] >> 8)
        for k in range(1, 4):
            more = wide[at] >= k
            if not more.any():
                break
            g, c = go[more], at[more]
            byte = 0x80 | ((code[c] >> (6 * (wide[c] - k))) & 0x3F)
            state[g] = _CRC[(state[g] ^ byte) & 0xFF] ^ (state[g] >> 8)
        keys[(n - 1) // 3, go] = (keys[(n - 1) // 3, go] << 21) | (plain[at] + 1)
        if n >= least and len(go):
            tag = (of[go] << 32) | state[go]
            order = np.argsort(tag)
            tag, order = tag[order], go[order]
            new = np.ones(len(order), bool)
            twin = np.flatnonzero(tag[1:] == tag[:-1])  # the same gram, if its characters are
            new[twin + 1] = (keys[:, order[twin + 1]] != keys[:, order[twin]]).any(0)
            found.append((of[order[new]], state[order[new]] ^ 0xFFFFFFFF))
    whole = np.flatnonzero((size < least) | (size > most))
    found.append((whole, np.array([zlib.crc32(framed[i].encode("utf-8", "replace")) for i in whole], "i8")))
    word, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(word, kind="stable")
    return word[order], h[order]


_LOADED: dict[str, tuple[str, object]] = {}


def _held(kind: str, name: str, make: Callable):
    held = _LOADED.get(kind)
    if held is None or held[0] != name:
        _LOADED[kind] = held = (name, make())
    return held[1]


def _loader(kind: str, make: Callable) -> Callable:
    """Gives the worker's model, made at the first call; another one's goes.

    A function that makes a model is a new object in every task, so it is known by what it was sent as.
    """
    name = hashlib.sha256(cloudpickle.dumps(make)).hexdigest()
    return lambda: _held(kind, name, make)


def called(call: Callable[[list[str]], Sequence], check: Callable[[object], str | None], texts: list[str], calls: Calls, sleep=time.sleep) -> list[tuple[object, str | None]]:
    """(result, error) of each text. A batch that keeps failing is called text by text, so that one
    bad text costs no other; a result that ``check`` objects to is an error of its own."""
    out: list[tuple[object, str | None]] = []
    for begin in range(0, len(texts), calls.batch):
        part = texts[begin : begin + calls.batch]
        made, why = _tried(call, part, calls, sleep)
        if made is None and len(part) > 1:
            for text in part:
                one, why = _tried(call, [text], calls, sleep)
                out.append((one[0] if one else None, why))
        else:
            out += [(x, None) for x in made] if made is not None else [(None, why)] * len(part)
    return [(None, bad) if why is None and (bad := check(x)) else (x, why) for x, why in out]


def _tried(call: Callable, part: list[str], calls: Calls, sleep) -> tuple[list | None, str | None]:
    why = "no attempt"
    for tries in range(1, calls.attempts + 1):
        try:
            made = list(call(part))
            if len(made) == len(part):
                return made, None
            why = f"{len(made)} results for {len(part)} texts"
        except Exception as e:  # whatever a model raises is that text's error
            why = f"{type(e).__name__}: {e}"
        if tries < calls.attempts:
            sleep(calls.pause(tries))
    return None, why


def _vector_fault(x, dim: int | None) -> str | None:
    try:
        x = [float(v) for v in x]
    except (TypeError, ValueError):
        return "no vector"
    if dim is not None and len(x) != dim:
        return f"{len(x)} components instead of {dim}"
    return None if x and all(map(math.isfinite, x)) else "components that are no numbers"


def _answer_fault(x) -> str | None:
    return None if isinstance(x, str) else "no text"


def _applied(df: DataFrame, text: str, kind: str, give: Callable[[list[str]], list[tuple]], out: str, names: tuple[str, str]) -> DataFrame:
    ship(df.sparkSession)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            known = texts.notna()
            results = iter(give(texts[known].tolist()))
            rows = [next(results) if k else (None, None) for k in known]
            yield pd.DataFrame({"v": pd.Series([r[0] for r in rows], dtype=object), "e": pd.Series([r[1] for r in rows], dtype=object)})

    # made once a row: a filter on either part of it must not call the model again
    made = F.pandas_udf(run, f"v {out}, e string").asNondeterministic()
    rows = df.withColumn("__m", made(F.col(text)))
    return rows.select(*df.columns, F.col("__m.v").alias(names[0]), F.col("__m.e").alias(names[1]))


def embed(df: DataFrame, make: Callable[[], Embedder], text: str = "text", dim: int | None = None, calls: Calls = Calls()) -> DataFrame:
    """``df`` with embedding and embedding_error; both are null for a null text, one of them otherwise."""
    model = _loader("embed", make)

    def give(texts: list[str]) -> list[tuple]:
        found = called(model().embed, lambda x: _vector_fault(x, dim), texts, calls)
        return [([float(v) for v in x] if why is None else None, why) for x, why in found]

    return _applied(df, text, "embed", give, "array<double>", ("embedding", "embedding_error"))


def generate(df: DataFrame, make: Callable[[], Generator], prompt: str = "prompt", calls: Calls = Calls()) -> DataFrame:
    """``df`` with answer and answer_error; both are null for a null prompt."""
    model = _loader("generate", make)
    give = lambda prompts: called(model().generate, _answer_fault, prompts, calls)
    return _applied(df, prompt, "generate", give, "string", ("answer", "answer_error"))


def vectors(make: Callable[[], Embedder], dim: int | None = None, calls: Calls = Calls()) -> Callable:
    """A function of a text column that gives its vector, for operators that take one; null where a text fails."""

    model = _loader("embed", make)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            known = texts.notna()
            found = iter(called(model().embed, lambda x: _vector_fault(x, dim), texts[known].tolist(), calls))
            yield pd.Series([next(found)[0] if k else None for k in known], dtype=object)

    return lambda text: F.pandas_udf(run, "array<double>")(F.col(text) if isinstance(text, str) else text)


#: Kinds of tokens that say nothing, and those that make a keyword.
EMPTY, NAMING = ("PUNCT", "SPACE"), ("NOUN", "PROPN")


def of_kinds(terms: DataFrame, make: Callable[[], Tagger], stop_words: Sequence[str] = (), kinds: Sequence[str] = NAMING, term: str = "term", calls: Calls = Calls()) -> DataFrame:
    """The terms that have a token of these kinds which is no stop word; a term that can't be tagged goes."""
    stops, model = {w.lower() for w in stop_words}, _loader("tag", make)

    def kept(tags) -> str:
        return "yes" if any(kind in kinds and kind not in EMPTY and token.lower() not in stops for token, kind in tags) else "no"

    def give(texts: list[str]) -> list[tuple]:
        found = called(model().tag, lambda x: None if isinstance(x, (list, tuple)) else "no tags", texts, calls)
        return [(kept(x) if why is None else None, why) for x, why in found]

    return _applied(terms, term, "tag", give, "string", ("__kept", "__why")).where("__kept = 'yes'").drop("__kept", "__why")


def store_embedded(df: DataFrame, make: Callable[[], Embedder], path: str, failures: str, text: str = "text", dim: int | None = None, calls: Calls = Calls()) -> tuple[int, int]:
    """Embed and append to the collection ``path``; rows that failed, and null texts, to ``failures`` instead. Rows of each.

    The embedded rows are written once, so that no text is embedded twice.
    """
    from tessera.session import discard, settle

    done = settle(embed(df, make, text, dim, calls))
    good, bad = done.where("embedding is not null"), done.where("embedding is null")
    stored = store.store(good.drop("embedding_error"), path)
    lost = bad.count()
    if lost:
        bad.drop("embedding").write.mode("append").parquet(failures)
    discard(done)
    return stored, lost
