"""Feature vectors of documents: terms of one and two words, weighed by TF-IDF and rotated by principal components."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel, PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import col
from tessera.functions.text import words
from tessera.session import discard, settle, ship


def kept_words(text) -> Column:
    """Words of two characters or more, in lower case and order; terms are these and the pairs of neighbours."""
    return F.filter(words(F.coalesce(col(text), F.lit(""))), lambda w: F.length(w) > 1)


#: Distinct terms that a task counts before it passes them on.
HELD = 200_000


def _tally(of: Callable[[list[str]], list[str]]):
    """term, n and docs: how often, and in how many documents, the terms that ``of`` finds occur in a stretch of documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, docs = Counter(), Counter()
        for batch in batches:
            for tokens in batch["w"]:
                found = of(tokens.tolist())
                n.update(found)
                docs.update(set(found))
                if len(n) > HELD:
                    yield pd.DataFrame({"term": list(n), "n": list(n.values()), "docs": [docs[t] for t in n]})
                    n.clear()
                    docs.clear()
        if n:
            yield pd.DataFrame({"term": list(n), "n": list(n.values()), "docs": [docs[t] for t in n]})

    return run


def _pairs_of(some: set[str] | None):
    return lambda w: [f"{a} {b}" for a, b in zip(w, w[1:]) if some is None or (a in some and b in some)]


def _vocabulary(listed: DataFrame, most: int, least_documents: int) -> list:
    """(term, n, docs) of the ``most`` terms that occur most often among those of ``least_documents``; ties by term.

    A pair occurs no oftener than either of its words. So once ``most`` words are known, only pairs of words
    as frequent as the last of them are counted.
    """

    def counted(of) -> DataFrame:
        return listed.mapInPandas(_tally(of), "term string, n long, docs long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))

    def best(df: DataFrame) -> list:
        return df.where(F.col("docs") >= least_documents).orderBy(F.desc("n"), "term").limit(most).collect()

    single = settle(counted(lambda w: w))
    top, some = best(single), None
    if len(top) == most:
        some = {r[0] for r in single.where(F.col("n") >= top[-1]["n"]).select("term").limit(HELD + 1).collect()}
        some = some if len(some) <= HELD else None
    discard(single)
    return sorted(top + best(counted(_pairs_of(some))), key=lambda r: (-r["n"], r["term"]))[:most]


def _weigher(vocabulary: list[str], idf: list[float]):
    """A vectorised function of a column of words: TF-IDF of the vocabulary's terms, of unit length."""
    single = {t: i for i, t in enumerate(vocabulary) if " " not in t}
    pair = {tuple(t.split(" ")): i for i, t in enumerate(vocabulary) if " " in t}
    weight = np.array(idf)

    def give(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            rows = []
            for tokens in lists:
                tokens = tokens.tolist()
                at = [single[t] for t in tokens if t in single] + [pair[p] for p in zip(tokens, tokens[1:]) if p in pair]
                x = np.bincount(np.array(at, "i8"), minlength=len(weight)) * weight
                size = np.sqrt(x @ x)
                rows.append(x / size if size > 0 else x)
            yield pd.Series(rows, dtype=object)

    return F.pandas_udf(give, "array<double>")


@dataclass
class Features:
    """A fitted pipeline: the vocabulary, the inverse document frequencies, the mean row and the components."""

    counts: CountVectorizerModel
    idf: list[float]
    mean: list[float]
    components: PCAModel | None

    @classmethod
    def fit(cls, df: DataFrame, text: str = "text", most: int = 100, least_documents: int = 2, components: int | None = 100) -> Features | None:
        """The ``most`` terms that occur most often among those of ``least_documents``; null if there are none.

        Counts, frequencies and moments are taken over all rows; the model holds ``most`` of each.
        """
        ship(df.sparkSession)
        best = _vocabulary(df.select(kept_words(text).alias("w")), most, least_documents)
        if not best:
            return None
        n, size = df.count(), len(best)
        counts = CountVectorizerModel.from_vocabulary([r["term"] for r in best], inputCol="__terms", outputCol="__counts")
        out = cls(counts, [math.log((1 + n) / (1 + r["docs"])) + 1 for r in best], [0.0] * size, None)
        if components:
            # the passes over the rows read their weights, not the texts
            weighed = settle(out._weighed(df.select(F.col(text).alias("text")), "text").select("tfidf"))
            out.mean = [float(x) for x in weighed.select(Summarizer.mean(array_to_vector("tfidf"))).first()[0]]
            centred = weighed.select(array_to_vector(out._centred("tfidf")).alias("__v"))
            out.components = PCA(k=min(components, size), inputCol="__v", outputCol="__p").fit(centred)
            discard(weighed)
        return out

    def _weighed(self, df: DataFrame, text: str) -> DataFrame:
        ship(df.sparkSession)
        return df.withColumn("tfidf", _weigher(self.counts.vocabulary, self.idf)(kept_words(text)))

    def _centred(self, x: str) -> Column:
        return F.zip_with(F.col(x), F.lit(self.mean), lambda a, m: a - m)

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with tfidf, of unit length (zeros for a text without a known term), and features: its
        projection on the components, or tfidf itself without any."""
        rows = self._weighed(df, text)
        if self.components is None:
            return rows.withColumn("features", F.col("tfidf"))
        made = self.components.transform(rows.withColumn("__v", array_to_vector(self._centred("tfidf"))))
        return made.withColumn("features", vector_to_array("__p")).drop("__v", "__p")

    def save(self, spark, path: str) -> None:
        self.counts.save(f"{path}/counts")
        if self.components is not None:
            self.components.save(f"{path}/components")
        row = json.dumps({"idf": self.idf, "mean": self.mean, "components": self.components is not None})
        spark.createDataFrame([(row,)], "value string").coalesce(1).write.text(f"{path}/weights")

    @classmethod
    def load(cls, spark, path: str) -> Features:
        row = json.loads(spark.read.text(f"{path}/weights").first()[0])
        components = PCAModel.load(f"{path}/components") if row["components"] else None
        return cls(CountVectorizerModel.load(f"{path}/counts"), row["idf"], row["mean"], components)
