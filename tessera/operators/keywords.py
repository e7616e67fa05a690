"""Domain keywords: candidates, aggregation over documents, filters, top lists, weights, clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fixed import REJECTED_TERMS
from tessera.functions.scalars import col, let
from tessera.functions.text import ngrams, words
from tessera.functions.vector import LETTERS, dot, letter_vector, norm
from tessera.session import settle, ship

#: Bytes of texts whose words are numbered together.
BLOCK_BYTES = 16 << 20


def term_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", stop_words: list[str] | None = None, least: int = 2) -> DataFrame:
    """id, term, tf and total (the document's words) for each distinct word of ``least`` letters of a document.

    A document is one row, so its words are counted inside the row: sorted, one place for each run of equal
    ones. Nothing is shuffled, and as no filter looks at the words they are worked out once.
    """
    w = words(F.coalesce(F.col(text), F.lit("")))
    kept = F.filter(w, lambda x: (F.length(x) >= least) & (~x.isin(*stop_words) if stop_words else F.lit(True)))
    rows = docs.select(id_col, F.array_sort(kept).alias("w"))
    first = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i == 1) | (F.element_at("w", F.greatest(i - 1, F.lit(1))) != F.element_at("w", i)))
    first = F.when(F.size("w") > 0, first).otherwise(F.array().cast("array<int>"))
    rows = rows.select(id_col, "w", F.concat(first, F.array(F.size("w") + 1)).alias("at"))
    each = rows.select(id_col, "w", "at", F.posexplode(F.slice("at", 1, F.size("at") - 1)).alias("p", "i"))
    times = F.element_at("at", F.col("p") + 2) - F.col("i")
    return each.select(id_col, F.element_at("w", F.col("i")).alias("term"), times.alias("tf"), F.size("w").alias("total"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """id, term and score, the share of the document's words, for each distinct term of a document."""
    counted = term_counts(docs, id_col, text, stop_words)
    return counted.select(id_col, "term", (F.col("tf") / F.col("total")).alias("score"))


def aggregate(found: DataFrame) -> DataFrame:
    """term, max_score and doc_freq over documents, of the distinct lower-case terms of each."""
    return found.groupBy("term").agg(F.max("score").alias("max_score"), F.count(F.lit(1)).alias("doc_freq"))


def _phrase_words(text: str, stop_words: list[str] | None) -> Column:
    """The words that runs are formed of: two letters or more, no stop words."""
    return F.filter(words(F.coalesce(F.col(text), F.lit(""))), lambda x: (F.length(x) > 1) & (~x.isin(*stop_words) if stop_words else F.lit(True)))


def phrases(docs: DataFrame, id_col: str = "doc_id", text: str = "text", stop_words: list[str] | None = None, most: int = 3, carry: list[str] | None = None) -> DataFrame:
    """id, columns ``carry`` and term: the distinct runs of one to ``most`` words of a document. Stop words
    go before runs are formed. A document is one row throughout, so nothing is shuffled."""
    return docs.select(id_col, *(carry or []), F.explode(F.array_distinct(ngrams(_phrase_words(text, stop_words), 1, most))).alias("term"))


def _letters(tokens: list[str]) -> np.ndarray:
    """How often each of LETTERS occurs in each token; tokens hold no space."""
    raw = np.frombuffer(" ".join(tokens).encode("utf-8", "replace"), "u1")
    token, place = np.cumsum(raw == 32), raw.astype("i8") - ord("a")
    known = (place >= 0) & (place < len(LETTERS))
    return np.bincount(token[known] * len(LETTERS) + place[known], minlength=len(tokens) * len(LETTERS)).reshape(-1, len(LETTERS)).astype(float)


def _nearest_runs(tokens: list[str], each: np.ndarray, whole: np.ndarray, n: int, most: int) -> tuple[list[str], list[float | None]]:
    """The n distinct runs of one to ``most`` tokens that are most like ``whole``; ``each`` are the tokens' letters.

    A run's letters are the sum of its words', and all are whole numbers: the cosine is that of ``letter_vector``.
    """
    size, run, score, start, long = math.sqrt(whole @ whole), each, [], [], []
    for k in range(1, min(most, len(tokens)) + 1):
        run = run if k == 1 else run[:-1] + each[k - 1 :]
        by = np.sqrt(np.einsum("ij,ij->i", run, run)) * size
        score.append(np.divide(run @ whole, by, out=np.full(len(run), -1.0), where=by > 0))  # -1: no letters, no score
        start.append(np.arange(len(run)))
        long.append(np.full(len(run), k))
    if not score:
        return [], []
    score, start, long = map(np.concatenate, (score, start, long))
    order = np.argsort(-score, kind="stable")
    ends = [*(np.flatnonzero(np.diff(score[order])) + 1).tolist(), len(order)]
    terms, scores, a = [], [], 0
    for b in ends:  # equal runs have equal scores
        at = order[a:b]
        same = sorted({" ".join(tokens[i : i + k]) for i, k in zip(start[at].tolist(), long[at].tolist(), strict=True)})
        terms += same
        scores += [None if score[at[0]] < 0 else float(score[at[0]])] * len(same)
        a = b
        if len(terms) >= n:
            break
    return terms[:n], scores[:n]


def _by_letters(n: int, most: int):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for tokens, whole in batches:
            lists = [t.tolist() for t in tokens]
            found = [_nearest_runs(t, _letters(t), _letters([w.replace(" ", "")])[0], n, most) for t, w in zip(lists, whole, strict=True)]
            yield pd.DataFrame({"term": [f[0] for f in found], "score": [f[1] for f in found]})

    return F.pandas_udf(run, "term array<string>, score array<double>")


def _best_of_batches(n: int, id_col: str):
    """A document's rows follow one another, so what a batch keeps of it is all but n rows a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.sort_values(["score", "term"], ascending=[False, True], na_position="last").groupby(id_col, sort=False, dropna=False).head(n)

    return run


def key_phrases(docs: DataFrame, embed=letter_vector, n: int = 5, id_col: str = "doc_id", text: str = "text", stop_words: list[str] | None = None, most: int = 3) -> DataFrame:
    """id, rank, term and score: the n phrases of each document that are most like it, by the cosine of
    their vectors under ``embed``, a function of a text column; ties by term.

    A document's phrases are scored and cut to n before anything is shuffled: within its row for
    ``letter_vector``, whose vectors of phrases are sums of their words', and batch by batch for another.
    """
    ship(docs.sparkSession)
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    if embed is letter_vector:
        best = docs.select(id_col, _by_letters(n, most)(_phrase_words(text, stop_words), lower).alias("b"))
        found = best.select(id_col, F.inline(F.arrays_zip("b.term", "b.score")))
    else:
        whole = docs.withColumn("__v", embed(lower))
        scored = phrases(whole.withColumn("__n", norm("__v")), id_col, text, stop_words, most, ["__v", "__n"])
        like = let(embed(F.col("term")), lambda v: F.try_divide(dot(v, "__v"), norm(v) * F.col("__n")))
        scored = scored.select(id_col, "term", like.alias("score"))
        found = scored.mapInPandas(_best_of_batches(n, id_col), scored.schema)
    return top_per_document(found, n, id_col)


def _likeness(vectors: list) -> np.ndarray:
    """The cosines of all pairs; 0 for what has no direction, and between vectors of unlike length."""
    out = np.zeros((len(vectors), len(vectors)))
    sizes = np.array([0 if v is None else len(v) for v in vectors])
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        rows = np.stack([vectors[i] for i in at]).astype(float)
        long = np.sqrt(np.einsum("ij,ij->i", rows, rows))
        by = long[:, None] * long
        out[np.ix_(at, at)] = np.divide(rows @ rows.T, by, out=np.zeros_like(by), where=by > 0)
    return np.nan_to_num(out, nan=0.0)


def _chosen(score: np.ndarray, like: np.ndarray, n: int, weight: float) -> list[int]:
    """n places by maximal marginal relevance; of equal gains the first, rows without a score last."""
    out, apart = [], None
    for _ in range(min(n, len(score))):
        gain = score if apart is None else weight * score - (1 - weight) * apart
        gain = np.where(np.isnan(gain), -1e300, gain)
        gain[out] = -np.inf
        i = int(gain.argmax())
        out.append(i)
        apart = like[i] if apart is None else np.maximum(apart, like[i])
    return out


def _diverse(n: int, weight: float):
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for terms, scores, vectors in batches:
            yield pd.Series([[t[i] for i in _chosen(np.asarray(s, float), _likeness(list(v)), n, weight)] for t, s, v in zip(terms, scores, vectors, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<string>")


def diverse(terms: DataFrame, embed=letter_vector, n: int = 5, diversity: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """id, rank and term: of each document's scored phrases (a bounded list) n by maximal marginal
    relevance, where ``diversity`` weighs likeness to those chosen before."""
    ship(terms.sparkSession)
    item = F.struct((-F.col("score")).alias("s"), F.col("term").alias("id"), F.col("score").alias("similarity"), F.col("v").alias("vector"))
    listed = terms.withColumn("v", embed(F.col("term"))).groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("c"))
    picked = listed.select(id_col, _diverse(n, 1 - diversity)(F.col("c.id"), F.col("c.similarity"), F.col("c.vector")).alias("picked"))
    return picked.select(id_col, F.posexplode("picked").alias("p", "term")).select(id_col, (F.col("p") + 1).alias("rank"), "term")


def rejection(term, doc_freq, least_documents: int, least_length: int = 3) -> Column:
    """Why a keyword goes: the first failing filter by name, null if it stays."""
    out = F.lit(None).cast("string")
    for i, pattern in reversed(list(enumerate(REJECTED_TERMS))):
        out = F.when(col(term).rlike(pattern), F.lit(f"pattern_{i}")).otherwise(out)
    out = F.when(F.length(col(term)) < least_length, F.lit("length")).otherwise(out)
    return F.when(col(doc_freq) < least_documents, F.lit("doc_freq")).otherwise(out)


def filtered(terms: DataFrame, least_documents: int, least_length: int = 3) -> DataFrame:
    return terms.where(rejection("term", "doc_freq", least_documents, least_length).isNull())


def top_terms(terms: DataFrame, n: int, score: str = "max_score") -> DataFrame:
    """The n best terms; ties by term."""
    return terms.orderBy(F.desc(score), "term").limit(n)


def top_per_document(found: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """Each document's n best terms with their rank; every task keeps n rows a document."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "term"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n)


def _numbered(ids: pa.Array, texts: pa.Array, leave: list[str], names: list[str], block: int) -> Iterator[pa.RecordBatch]:
    """A block's documents as numbers of words with their counts, and its words with their numbers and documents."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}_]+", " ")
    tokens = pc.split_pattern(plain, " ")
    coded = tokens.flatten().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    kept = ~pc.is_in(terms, pa.array(["", *leave], terms.type)).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(ids)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    pair, times = np.unique((doc * len(terms) + code)[kept[code]], return_counts=True)
    doc, code = np.divmod(pair, max(len(terms), 1))
    ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(ids))))), pa.int32())
    codes, counts = (pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (code, times))
    freq = np.bincount(code, minlength=len(terms))
    known = np.flatnonzero(freq)

    def rows(size: int, **columns: pa.Array) -> pa.RecordBatch:
        none = {"id": ids.type, "codes": codes.type, "times": codes.type, "code": pa.int32(), "term": terms.type, "n": pa.int64()}
        made = {"block": pa.array(np.full(size, block)), **{k: pa.nulls(size, t) for k, t in none.items()}, **columns}
        return pa.RecordBatch.from_arrays([made[k] for k in names], names)

    yield rows(len(ids), id=ids, codes=codes, times=counts)
    yield rows(len(known), code=pa.array(known, pa.int32()), term=terms.take(pa.array(known)), n=pa.array(freq[known], pa.int64()))


def _in_blocks(leave: list[str], names: list[str], most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= most:
                yield from _numbered(*(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1)), leave, names, block)
                block, held, size = block + 1, [], 0
        if held:
            yield from _numbered(*(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1)), leave, names, block)

    return run


def _weighed(docs: pa.Table, terms: pa.Table) -> pa.Table:
    """The words of a block's documents, whose weights have unit length in each."""
    number, idf = terms["code"].to_numpy(), terms["idf"].to_numpy()
    place = np.zeros(number.max(initial=-1) + 1, np.int64)
    place[number] = np.arange(len(number))
    at = place[pc.list_flatten(docs["codes"]).to_numpy()]
    doc = np.repeat(np.arange(len(docs)), pc.list_value_length(docs["codes"]).to_numpy())
    x = pc.list_flatten(docs["times"]).to_numpy() * idf[at]
    length = np.sqrt(np.bincount(doc, x * x, minlength=len(docs)))
    return pa.table({"id": docs["id"].take(pa.array(doc)), "term": terms["term"].take(pa.array(at)), "weight": x / length[doc]})


def tfidf(docs: DataFrame, id_col: str = "doc_id", text: str = "text", stop_words: list[str] | None = None) -> DataFrame:
    """id, term and weight: counts times ln((1 + n) / (1 + df)) + 1, of unit length in a document.

    Each row is a document. Blocks of documents number their words, so that what meets by the term is
    one row a block and word, and what goes back to the documents is their block's words. The texts
    are read once, and neither a document's words nor its rows are shuffled by themselves.
    """
    ship(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    names = ["block", "id", "codes", "times", "code", "term", "n"]
    made = f"block long, id {key}, codes array<int>, times array<int>, code int, term string, n long"
    rows = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    blocks = settle(rows.mapInArrow(_in_blocks(stop_words or [], names, BLOCK_BYTES), made))
    counted = blocks.where("term is null").select("block", "id", "codes", "times")
    n = counted.count()
    df = F.sum("n").over(Window.partitionBy("term"))
    idf = blocks.where("term is not null").select("block", "code", "term", (F.log((1.0 + n) / (1 + df)) + 1).alias("idf"))
    weighed = counted.groupBy("block").cogroup(idf.groupBy("block")).applyInArrow(_weighed, f"id {key}, term string, weight double")
    return weighed.select(F.col("id").alias(id_col), "term", "weight")


def clusters(terms: DataFrame, k: int = 4, seed: int = 42, features: int = 256) -> DataFrame:
    """term and cluster by k-means over the terms' TF-IDF vectors of words; fewer terms give fewer clusters.

    Words are hashed into ``features`` places; each term counts as a document, so words that many terms
    share weigh less. Terms without a word are left out.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    # a table of its own: every pass of the fits would work the terms out of the documents again
    split = settle(terms.select("term", words("term").alias("w")).where(F.size("w") > 0))
    n = split.limit(k).count()
    if n < 2:
        return split.select("term", F.lit(0).alias("cluster"))
    counted = HashingTF(numFeatures=features, inputCol="w", outputCol="tf").transform(split)
    weighed = IDF(inputCol="tf", outputCol="tfidf").fit(counted).transform(counted)
    vectors = Normalizer(inputCol="tfidf", outputCol="features").transform(weighed)
    model = KMeans(k=min(k, n), seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
    return model.transform(vectors).select("term", "cluster")


def merged(*lists: list[str]) -> list[str]:
    """The sorted distinct union of keyword lists."""
    return sorted(set().union(*lists))


def merged_tables(*tables: DataFrame) -> DataFrame:
    """The same for tables of one column `term`; blank terms go."""
    out = tables[0].select("term")
    for t in tables[1:]:
        out = out.unionByName(t.select("term"))
    return out.select(F.trim("term").alias("term")).where("term <> ''").distinct()


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """term and change (`added` or `removed`) between two keyword tables."""
    a, b = old.select("term").distinct(), new.select("term").distinct()
    added = b.join(a, "term", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(a.join(b, "term", "left_anti").withColumn("change", F.lit("removed")))
