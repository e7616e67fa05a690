"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A text's terms are trigrams of character classes (letters, capitals, digits, spaces, single signs)
and a few measures of its structure. A singular value decomposition of a bounded labelled sample
gives the latent space; the sample's labelled vectors travel to every task, each document's cosines
with all of them are computed in blocks, and the nearest ones vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import documents, id_remainder, is_remainder, sub_batches, whole_text
from tessera.session import ship

#: Labelled rows that are learned from, terms, latent dimensions, neighbours that vote.
LABELLED, TERMS, DIMENSIONS, NEIGHBOURS = 4096, 1024, 32, 15
#: Character classes: 0 other, 1 lower, 2 upper, 3 digit, 4 white space, 5 line end, then signs.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = 6 + len(SIGNS)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0
    chars = points.view("<U1")
    out = np.zeros(len(points), np.int32)
    out[np.char.isalpha(chars)] = 1
    out[np.char.isupper(chars)] = 2
    out[np.char.isdigit(chars)] = 3
    out[np.char.isspace(chars)] = 4
    out[10] = 5
    for i, c in enumerate(SIGNS):
        out[ord(c)] = 6 + i
    return out


def trigrams(text: str) -> np.ndarray:
    c = _classes()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    return (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]


def structure(text: str) -> list[float]:
    """Shares between 0 and 1 that describe repetition, signs and length; zeros for no words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 7
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:], strict=False))) / (n - 1) if n > 1 else 1.0
    signs = sum(map(text.count, SIGNS)) / len(text)
    return [
        len(set(words)) / n,
        1 - pairs,
        sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, 4 * signs),
        min(1.0, len(text) / n / 20),
        min(1.0, np.log10(n + 1) / 5),
    ]


class Classifier:
    """Latent space and labelled vectors, from the sample's term counts, structures and labels."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], shapes: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if not len(labels):
            return
        df = np.zeros(CLASSES**3, np.int64)
        for ids, _ in counts:
            df[ids] += 1
        terms = np.argsort(-df, kind="stable")[:TERMS]
        terms = np.sort(terms[df[terms] > 0])
        self.place = np.full(CLASSES**3, len(terms), np.int32)
        self.place[terms] = np.arange(len(terms))
        self.idf = np.log((1 + len(labels)) / (1 + df[terms])) + 1
        tf = np.zeros((len(labels), len(terms)))
        for row, (ids, n) in zip(tf, counts, strict=True):
            at = self.place[ids]
            row[at[at < len(terms)]] = n[at < len(terms)]
        x = self._weigh(tf, shapes)
        _, vectors = np.linalg.eigh(x.T @ x)
        self.basis = vectors[:, ::-1][:, : min(DIMENSIONS, x.shape[1])].astype(np.float32)
        self.known = self._latent(x)

    def _weigh(self, tf: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        x = np.log1p(tf) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return np.hstack((x, shapes)).astype(np.float32)

    def _latent(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(texts), self.prior)
        n = len(self.idf)
        out, k = [], min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), 256):
            part = texts[a : a + 256]
            tf = np.stack([np.bincount(self.place[trigrams(t)], minlength=n + 1)[:n] for t in part])
            cosines = self._latent(self._weigh(tf, np.array(list(map(structure, part))))) @ self.known.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(float)
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
            out.append(np.where(total > 0, vote, self.prior))
        return np.clip(np.concatenate(out), 0, 1) if out else np.zeros(0)


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for text in rows["text"]:
            ids, n = np.unique(trigrams(text), return_counts=True)
            out.append((ids.astype(np.int32).tobytes(), n.astype(np.int32).tobytes(), structure(text)))
        yield pd.concat([rows[["doc_id", "label"]].reset_index(drop=True), pd.DataFrame(out, columns=["ids", "n", "shape"])], axis=1)


def fit(df: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Classifier:
    """Learn from about ``bound`` rows of ``labels`` (doc_id, label), drawn by a hash of the id."""
    ship(df.sparkSession)
    given = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int"))
    share = int(min(1.0, bound / max(1, given.count())) * (1 << 30))
    drawn = given.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < share)
    # about ``bound`` rows
    rows = df.select("doc_id", whole_text().alias("text")).join(F.broadcast(drawn), "doc_id")
    got = rows.mapInPandas(_terms, "doc_id long, label int, ids binary, n binary, shape array<double>").toPandas()
    got = got.sort_values(["doc_id", "label", "ids", "n"]).reset_index(drop=True)
    counts = [(np.frombuffer(i, np.int32), np.frombuffer(n, np.int32)) for i, n in zip(got["ids"], got["n"], strict=True)]
    return Classifier(counts, np.array(got["shape"].tolist()).reshape(len(got), 7), got["label"].to_numpy(float))


def scorer(classifier: Classifier):
    """A vectorised function of a text column that returns the score."""

    def score(texts: pd.Series) -> pd.Series:
        texts = [t or "" for t in texts]
        parts = [classifier.scores(texts[a:b]) for a, b in sub_batches(texts)]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return F.pandas_udf(score, "double")


def score_quality(df: DataFrame, classifier: Classifier) -> DataFrame:
    """``df`` with columns score and predicted, in place of any of these names.

    Null and empty texts are scored by their structure like others; what resembles no labelled text
    gets the labels' mean, 0.5 without any. Repeated rows get equal scores, other columns pass
    through, empty tables give no rows.
    """
    ship(df.sparkSession)
    out = df.withColumn("score", scorer(classifier)(F.col("text")))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    learn = labels.where(F.coalesce(id_remainder("doc_id", 3) != 1, F.lit(False)))
    scored = score_quality(docs, fit(docs, learn))
    return scored.select("doc_id", is_remainder("doc_id", 3, 1).alias("held_out"), "score", "predicted")
