"""Top-k retrieval: exact dense, thresholded, diverse (MMR), BM25 and hybrid, for one query or many."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import col, let
from tessera.functions.text import words
from tessera.functions.vector import cosine, vector
from tessera.plans.config import RetrievalConfig
from tessera.session import settle, ship

#: Bytes of queries that are broadcast to one scan of the vectors; rows, and queries, of one product; candidates
#: that are cut to the best together.
QUERY_BYTES, STRETCH, TILE, FOUND = 8 << 20, 8192, 128, 1 << 18


def top_k(df: DataFrame, query: Sequence[float], k: int = 6, id_col: str = "vec_id", embedding: str = "embedding", threshold: float | None = None) -> DataFrame:
    """The k nearest rows by cosine, ties by id; a threshold cuts before the k are taken.
    Every task keeps k rows, so little moves. Null and zero vectors never match."""
    scored = df.withColumn("similarity", cosine(embedding, query)).where(F.col("similarity").isNotNull())
    if threshold is not None:
        scored = scored.where(F.col("similarity") >= threshold)
    return scored.orderBy(F.desc("similarity"), F.col(id_col)).limit(k)


def top_k_batch(df: DataFrame, queries: DataFrame, k: int = 6, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, id, similarity and rank: the k nearest rows of each of a set of queries (query_id, query array).

    The queries travel to the scan, as many at a time as QUERY_BYTES hold, by a hash of their id; a worker
    multiplies them with stretches of vectors and keeps k of each query in all, so little is held and
    little reaches the shuffle. Every pair's product is summed in the same order, so equal vectors tie and go by id. Null, zero
    and non-finite vectors, on either side, and those of another length never match.
    """
    ship(df.sparkSession)
    asked = queries.select("query_id", vector("query").alias("query")).where("query is not null")
    return nearest(df.select(id_col, vector(embedding).alias("v")), asked, k, id_col)


def nearest(rows: DataFrame, asked: DataFrame, k: int, id_col: str) -> DataFrame:
    """query_id, id, similarity and rank, from rows (id, v) and asked (query_id, query). With a column lists of
    asked, a query meets only the rows whose list is among its own."""
    sc, listed = rows.sparkSession.sparkContext, "lists" in asked.columns
    size = 8 * F.coalesce(F.size("query"), F.lit(0)) + (4 * F.size("lists") if listed else 0)
    blocks = max(1, -(-(asked.agg(F.sum(size)).first()[0] or 0) // QUERY_BYTES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, `{id_col}` {rows.schema[id_col].dataType.simpleString()}, similarity double"
    found = [rows.mapInArrow(_nearest(sc.broadcast(asked.where(block == i).toArrow()), k, id_col, listed), schema) for i in range(blocks)]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.col(id_col)))
    return reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)


def _matrix(lists: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vectors, lengths) for each number of components, of the lists that have a direction."""
    lists = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        part = pc.list_flatten(lists.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        length = np.sqrt(np.einsum("ij,ij->i", part, part))
        good = np.isfinite(part).all(1) & np.isfinite(length) & (length > 0)
        out.append((at[good], part[good], length[good]))
    return out


def _by_list(lists: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """The queries of each list."""
    lists = lists.combine_chunks()
    of, which = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False), pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    order = np.argsort(which, kind="stable")
    known, first = np.unique(which[order], return_index=True)
    return dict(zip(known.tolist(), np.split(of[order], first[1:]), strict=True)) if len(known) else {}


class _Best:
    """The k best rows of each query so far."""

    def __init__(self, queries: int, k: int, kind: pa.DataType):
        self.k, self.floor = k, np.full(queries, -np.inf)  # what a row has to reach
        self.query, self.like, self.ids = np.zeros(0, "i8"), np.zeros(0), pa.array([], kind)

    def add(self, query: np.ndarray, like: np.ndarray, ids: pa.Array) -> None:
        query, like = np.concatenate([self.query, query]), np.concatenate([self.like, like])
        ids = pa.concat_arrays([self.ids, ids])
        place = np.empty(len(ids), "i8")
        place[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, -like, query))
        at = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, at = order[at < self.k], at[at < self.k]
        self.query, self.like, self.ids = query[order], like[order], ids.take(pa.array(order))
        self.floor[self.query[at == self.k - 1]] = self.like[at == self.k - 1]


def _nearest(sent, k: int, id_col: str, listed: bool = False):
    """Of the rows (id, v) of a task, the k nearest of each of the broadcast queries."""

    def meet(table: pa.Table, asked: dict, by_list: dict, best: _Best) -> None:
        ids, lists, found, many = table[id_col].combine_chunks(), None, [], 0
        if listed:
            lists = table["list"].to_numpy()
        for at, v, length in _matrix(table["v"]):
            if v.shape[1] not in asked:
                continue
            names, q, size, place = asked[v.shape[1]]
            for one in np.unique(lists[at]).tolist() if listed else [None]:
                mine = np.flatnonzero(lists[at] == one) if listed else np.arange(len(at))
                who = place[by_list.get(one, np.zeros(0, "i8"))] if listed else np.arange(len(names))
                who = who[who >= 0]
                for a in range(0, len(who) if len(mine) else 0, TILE):
                    w = who[a : a + TILE]
                    like = np.einsum("ik,jk->ij", q[w], v[mine], optimize=False) / (size[w, None] * length[mine])
                    least = best.floor[names[w], None]
                    if len(mine) > k:
                        least = np.maximum(least, np.partition(like, len(mine) - k, axis=1)[:, len(mine) - k, None])
                    i, j = np.nonzero(like >= least)
                    found.append((names[w[i]], like[i, j], at[mine[j]]))
                    many += len(i)
                    if many > FOUND:
                        add(found, ids, best)
                        found, many = [], 0
        add(found, ids, best)

    def add(found: list, ids: pa.Array, best: _Best) -> None:
        if found:
            query, like, j = (np.concatenate(x) for x in zip(*found, strict=True))
            best.add(query, like, ids.take(pa.array(j)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked, best, held, rows = sent.value["query_id"].combine_chunks(), {}, None, [], 0
        for at, q, size in _matrix(sent.value["query"]):
            place = np.full(len(names), -1)
            place[at] = np.arange(len(at))
            asked[q.shape[1]] = (at, q, size, place)
        by_list = _by_list(sent.value["lists"]) if listed else {}
        for batch in batches:
            best = best or _Best(len(names), k, batch.schema.field(id_col).type)
            held.append(batch)
            rows += batch.num_rows
            if rows >= STRETCH:
                meet(pa.Table.from_batches(held), asked, by_list, best)
                held, rows = [], 0
        if rows:
            meet(pa.Table.from_batches(held), asked, by_list, best)
        if best:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(best.query)), best.ids, pa.array(best.like)], ["query_id", id_col, "similarity"])

    return run


def mmr_order(candidates, k: int, lambda_mult: float) -> Column:
    """From array<struct<id, similarity, vector>>, best first, k ids in the order of maximal marginal
    relevance; equal scores go to the better-ranked candidate."""

    def pick(items: Column) -> Column:
        n = F.size(items)

        def step(chosen: Column, _: Column) -> Column:
            def gain(i: Column) -> Column:
                me = F.element_at(items, i)
                apart = F.aggregate(chosen, F.lit(None).cast("double"), lambda m, j: F.greatest(m, F.coalesce(cosine(me["vector"], F.element_at(items, j)["vector"]), F.lit(0.0))))
                value = F.when(apart.isNull(), me["similarity"]).otherwise(lambda_mult * me["similarity"] - (1 - lambda_mult) * apart)
                return F.struct(value.alias("g"), (-i).alias("r"))

            open_ = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.array_contains(chosen, i))
            return F.concat(chosen, F.array(-F.array_max(F.transform(open_, gain))["r"]))

        rounds = F.sequence(F.lit(1), F.least(n, F.lit(k)))
        chosen = F.aggregate(rounds, F.array().cast("array<int>"), step)
        return F.transform(chosen, lambda i: F.element_at(items, i)["id"])

    empty = F.transform(col(candidates), lambda c: c["id"])
    return F.when(F.size(col(candidates)) > 0, let(col(candidates), pick)).otherwise(empty)


def mmr(df: DataFrame, query: Sequence[float], cfg: RetrievalConfig | None = None, id_col: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """rank and id of k diverse rows out of the k * fetch_factor nearest."""
    cfg = cfg or RetrievalConfig()
    near = top_k(df, query, cfg.k * cfg.fetch_factor, id_col, embedding)
    item = F.struct((-F.col("similarity")).alias("s"), F.col(id_col).alias("id"), "similarity", vector(embedding).alias("vector"))
    listed = near.agg(F.array_sort(F.collect_list(item)).alias("c"))
    return listed.select(F.posexplode(mmr_order("c", cfg.k, cfg.lambda_mult)).alias("rank", id_col)).withColumn("rank", F.col("rank") + 1)


def context(df: DataFrame, by: list[str] | None = None, rank: str = "rank", text: str = "text") -> DataFrame:
    """Non-blank texts joined by a blank line in rank order, for each group ``by``."""
    parts = F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(rank, text))))
    return df.groupBy(*(by or [])).agg(F.array_join(F.transform(parts, lambda p: p[text]), "\n\n").alias("context"))


def _is(term: str):
    return lambda x: x == term


def bm25(docs: DataFrame, query: str | Sequence[str], cfg: RetrievalConfig | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and bm25 of documents with at least one query term.

    Only counts of the query's own terms leave the scan, once: no token is shuffled, and texts are read
    a single time for the totals and the scores.
    """
    cfg = cfg or RetrievalConfig()
    terms = sorted(set([query] if isinstance(query, str) else query))
    one = docs.select(id_col, words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    tf = [F.size(F.filter("w", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = settle(one.select(id_col, F.size("w").alias("len"), *tf))
    totals = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("len").alias("avglen"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))
    )
    joined = counted.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(totals))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        df_, f = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.log(1 + (F.col("n") - df_ + 0.5) / (df_ + 0.5))
        score = score + idf * f * (cfg.k1 + 1) / (f + cfg.k1 * (1 - cfg.b + cfg.b * F.col("len") / F.col("avglen")))
    return joined.select(id_col, score.alias("bm25"))


def scaled(x: str, within: Window | None = None) -> Column:
    """Min-max within the rows; equal values are 1."""
    over = within or Window.partitionBy()
    low, high = F.min(x).over(over), F.max(x).over(over)
    return F.when(high > low, (F.col(x) - low) / (high - low)).otherwise(1.0)


def hybrid(dense: DataFrame, sparse: DataFrame, alpha: float, k: int, id_col: str = "doc_id") -> DataFrame:
    """Fuses two bounded candidate lists, (id, similarity) and (id, bm25); what a list lacks is 0."""
    d = dense.select(id_col, scaled("similarity").alias("d"))
    s = sparse.select(id_col, scaled("bm25").alias("s"))
    both = d.join(s, id_col, "full").select(id_col, (alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))).alias("score"))
    return both.orderBy(F.desc("score"), id_col).limit(k)


def retrieve(df: DataFrame, query: Sequence[float], cfg: RetrievalConfig | None = None, sparse: DataFrame | None = None, id_col: str = "vec_id") -> DataFrame:
    """rank and id by the configured search type."""
    cfg = cfg or RetrievalConfig()
    if cfg.search_type == "mmr":
        return mmr(df, query, cfg, id_col)
    if cfg.search_type == "hybrid" and sparse is not None:
        near = top_k(df, query, cfg.k * cfg.fetch_factor, id_col)
        some = sparse.orderBy(F.desc("bm25"), id_col).limit(cfg.k * cfg.fetch_factor)
        found = hybrid(near, some, cfg.lambda_mult, cfg.k, id_col).withColumnRenamed("score", "similarity")
    else:
        found = top_k(df, query, cfg.k, id_col, threshold=cfg.score_threshold if cfg.search_type == "similarity_score_threshold" else None)
    rank = F.row_number().over(Window.orderBy(F.desc("similarity"), id_col))  # k rows
    return found.select(rank.alias("rank"), id_col)
