"""An inverted-file index for top-k search by cosine: a table in folders by list, of which a search reads a few.

Spherical k-means on a bounded sample places the centres; every vector is stored with its nearest
centre's list. A query looks through the lists whose centres are nearest to it. The lists are partition
folders, so the others' files are never opened. How many lists it takes for a recall depends on the
vectors (few where they lie in clusters, most where they lie anywhere), so that is measured by exact
searches when the index is built.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.vector import vector
from tessera.session import ship

#: Vectors of the sample for each list; most lists, and so the size of what is sent to workers.
SAMPLE, MOST_LISTS = 64, 16_384
#: The recall that is aimed at, of so many neighbours of so many vectors.
RECALL, NEIGHBOURS, MEASURED = 0.97, 6, 400


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _usable(v: Column) -> Column:
    """Vectors that have a direction: not null, no null or non-finite component, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


class VectorIndex:
    """The index in ``path``: centres.json and the table ``vectors`` (id, embedding, list and further columns)."""

    def __init__(self, spark, path: str, id_col: str = "vec_id", embedding: str = "embedding"):
        self.spark, self.path, self.id_col, self.embedding = spark, path.rstrip("/"), id_col, embedding
        rows = spark.read.text(f"{self.path}/centres.json").collect()  # MOST_LISTS of them at most
        found = [json.loads(r[0]) for r in rows if r[0]]
        self.centres = _unit(np.array(found, dtype=float)) if found else np.zeros((0, 1))
        self.probes = self._stored_probes()

    # building

    @classmethod
    def build(cls, df: DataFrame, path: str, lists: int | None = None, id_col: str = "vec_id", embedding: str = "embedding", seed: int = 1) -> VectorIndex:
        """Fit the centres and add every vector. Without a number, there are as many lists as the root of
        the vectors, MOST_LISTS at most; the sample has SAMPLE vectors for each."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark, v = df.sparkSession, vector(embedding)
        known = df.where(_usable(v))
        n = known.count()
        lists = max(1, min(lists or math.isqrt(n), MOST_LISTS, n or 1))
        # the rows of smallest hash: the same sample however the table is dealt out
        sample = known.select(array_to_vector(v).alias("features"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("h")).orderBy("h").limit(SAMPLE * lists)
        if n:
            model = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=12, initMode="random").fit(sample)
            centres = [c.tolist() for c in model.clusterCenters()]
        else:
            centres = []
        lines = spark.createDataFrame([(json.dumps([float(x) for x in c]),) for c in centres] or [("",)], "value string")
        lines.coalesce(1).write.mode("errorifexists").text(f"{path}/centres.json")
        index = cls(spark, path, id_col, embedding)
        index._append(known)
        index.calibrate()
        return index

    def _stored_probes(self) -> int:
        """The number measured last; all lists before there is one."""
        from py4j.protocol import Py4JError
        from pyspark.errors import AnalysisException

        try:
            rows = self.spark.read.text(f"{self.path}/probes").collect()  # a row for each calibration
        except (AnalysisException, Py4JError):
            return max(1, len(self.centres))
        return json.loads(max(rows, key=lambda r: json.loads(r[0])["at"])[0])["probes"]

    def calibrate(self, recall: float = RECALL, k: int = NEIGHBOURS, measured: int = MEASURED) -> int:
        """Find and store the fewest lists for ``recall``: of the k nearest neighbours of ``measured`` vectors, those of
        smallest hash, exact search tells in which lists they are."""
        import time

        from tessera.operators.retrieval import top_k_batch

        if not len(self.centres):
            return 1
        rows = self.table().select(self.id_col, self.embedding, "list")
        asked = rows.orderBy(F.xxhash64(F.col(self.id_col))).limit(measured).select(F.col(self.id_col).alias("query_id"), F.col(self.embedding).alias("query"))
        found = top_k_batch(rows, asked, k, self.id_col, self.embedding).join(rows.select(self.id_col, "list"), self.id_col).select("query_id", "list")
        ranks = []  # of the neighbours' lists, among a query's: measured * k numbers
        for row in found.join(asked, "query_id").groupBy("query_id").agg(F.first("query").alias("q"), F.collect_list("list").alias("lists")).collect():
            order = np.argsort(-(_unit(np.array([row["q"]], float)) @ self.centres.T)[0], kind="stable")
            place = np.empty(len(order), "i8")
            place[order] = np.arange(1, len(order) + 1)
            ranks += place[row["lists"]].tolist()
        ranks.sort()
        self.probes = int(ranks[math.ceil(recall * len(ranks)) - 1]) if ranks else 1
        line = json.dumps({"probes": self.probes, "recall": recall, "k": k, "at": time.time()})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/probes")
        return self.probes

    def _append(self, df: DataFrame) -> None:
        if len(self.centres):
            rows = self._listed(df.withColumn(self.embedding, vector(self.embedding)))
            rows.repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.path}/vectors")

    def _listed(self, df: DataFrame) -> DataFrame:
        ship(self.spark)
        sent = self.spark.sparkContext.broadcast(self.centres)  # MOST_LISTS rows at most

        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for vectors in batches:
                yield pd.Series((_unit(np.stack(vectors.to_list()).astype(float)) @ sent.value.T).argmax(1).astype("i4")) if len(vectors) else pd.Series([], dtype="int32")

        return df.withColumn("list", F.pandas_udf(nearest, "int")(F.col(self.embedding)))

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def add(self, df: DataFrame) -> int:
        """Add the vectors whose ids the index doesn't have; how many. The centres stay as they are, so
        build anew once a table has grown many times over."""
        from tessera.session import discard, settle

        new = df.where(_usable(vector(self.embedding))).dropDuplicates([self.id_col])
        new = settle(new.join(self.table().select(self.id_col), self.id_col, "left_anti")) if len(self.centres) else settle(new.limit(0))
        n = new.count()
        if n:
            self._append(new)
        discard(new)
        return n

    # searching

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, query and lists: each query with the lists of its nearest centres, ``probes`` of them."""
        ship(self.spark)
        sent = self.spark.sparkContext.broadcast(self.centres)
        probes = max(1, min(probes, len(self.centres) or 1))

        def lists(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for asked in batches:
                near = _unit(np.stack(asked.to_list()).astype(float)) @ sent.value.T
                yield pd.Series(list(np.argsort(-near, axis=1, kind="stable")[:, :probes].astype("i4")))

        asked = queries.select("query_id", vector("query").alias("query")).where(_usable(F.col("query")))
        return asked.withColumn("lists", F.pandas_udf(lists, "array<int>")(F.col("query")))

    def search(self, queries: DataFrame, k: int = NEIGHBOURS, probes: int | None = None) -> DataFrame:
        """query_id, rank, id and similarity: the k nearest of each query (query_id, query) in its lists,
        as many as ``calibrate`` found if no number is given.

        Null, zero and non-finite queries find nothing. Ties go to the smaller id. As many probes as
        lists give the exact result. A query stays one row with its lists: queries travel to the scan block by
        block, where each list's vectors meet its queries.
        """
        from tessera.operators.retrieval import nearest
        from tessera.session import settle

        none = self.spark.createDataFrame([], f"query_id long, rank int, {self.id_col} long, similarity double")
        if not len(self.centres):
            return none
        asked = settle(self.probed(queries, probes or self.probes))
        wanted = [r[0] for r in asked.select(F.explode("lists")).distinct().collect()]  # at most one row a list
        if not wanted:
            return none
        found = self.table()
        if len(wanted) < len(self.centres):
            found = found.where(F.col("list").isin(wanted))  # the other folders are not listed, let alone read
        best = nearest(found.select("list", self.id_col, vector(self.embedding).alias("v")), asked, k, self.id_col)
        return best.select("query_id", "rank", self.id_col, "similarity")

    def near(self, query: Sequence[float], k: int = NEIGHBOURS, probes: int | None = None) -> DataFrame:
        """``search`` for one vector."""
        one = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id long, query array<double>")
        return self.search(one, k, probes).drop("query_id")
