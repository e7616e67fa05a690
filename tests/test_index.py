"""The inverted-file index against exact search, and feature vectors against NumPy."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import SF_DIR
from pyspark.sql import functions as F

from tessera.operators import features, retrieval
from tessera.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF_DIR.rsplit('/', 1)[0]}/sf0.01/embeddings.parquet").select("vec_id", "embedding")


@pytest.fixture(scope="module")
def index(spark, embeddings, tmp_path_factory):
    return VectorIndex.build(embeddings, str(tmp_path_factory.mktemp("index") / "i"))


def _queries(df, mod=20):
    return df.where(F.col("vec_id") % mod == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def test_index_holds_every_vector_once(index, embeddings):
    assert index.table().select("vec_id").exceptAll(embeddings.select("vec_id")).count() == 0 and index.table().count() == embeddings.count()
    assert len(index.centres) == math.isqrt(embeddings.count())


def test_recall_against_exact_search(index, embeddings):
    exact = {(r["query_id"], r["vec_id"]) for r in retrieval.top_k_batch(embeddings, _queries(embeddings), 6).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in index.search(_queries(embeddings)).collect()}
    assert len(exact & got) / len(exact) >= 0.95 and index.probes < len(index.centres)
    assert VectorIndex(index.spark, index.path).probes == index.probes
    every = {(r["query_id"], r["vec_id"]) for r in index.search(_queries(embeddings), 6, probes=10**6).collect()}
    assert every == exact


def test_queries_travel_in_blocks_and_no_row_is_a_pair(index, embeddings, monkeypatch):
    whole = sorted(map(tuple, index.search(_queries(embeddings)).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 4096)
    for name, n in (("STRETCH", 50), ("TILE", 3), ("FOUND", 20)):  # the best so far go from stretch to stretch
        monkeypatch.setattr(retrieval, name, n)
    found = index.search(_queries(embeddings))
    assert sorted(map(tuple, found.collect())) == whole
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "MapInArrow" in plan
    task = retrieval._nearest(type("Sent", (), {"value": _queries(embeddings).toArrow()})(), 6, "vec_id")
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).toArrow()
    assert sum(b.num_rows for b in task(iter(rows.to_batches(10)))) == 6 * _queries(embeddings).count()  # k a query, whatever a task reads


def _size(path):
    return sum(os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_one_query_reads_its_lists_alone(index, embeddings):
    query = embeddings.where("vec_id = 0").first()["embedding"]
    found = index.near(query, 6, probes=3)
    plan = found._jdf.queryExecution().toString()
    lists = {int(x) for x in re.search(r"PartitionFilters: \[[^\]]*?list#\d+ IN \(([\d,]+)\)", plan)[1].split(",")}
    read = sum(_size(f"{index.path}/vectors/list={i}") for i in lists)
    assert len(lists) == 3 and read < 0.5 * _size(f"{index.path}/vectors")
    top = found.orderBy("rank").first()
    assert top["vec_id"] == 0 and abs(top["similarity"] - 1) < 1e-9


def test_clustered_vectors_take_few_lists(spark, tmp_path):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.1 * draw.normal(size=16)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = VectorIndex.build(df, str(tmp_path / "i"), lists=40)
    assert one.probes <= 8
    exact = {(r["query_id"], r["vec_id"]) for r in retrieval.top_k_batch(df, _queries(df), 6).collect()}
    got = {(r["query_id"], r["vec_id"]) for r in one.search(_queries(df)).collect()}
    assert len(exact & got) / len(exact) >= 0.95


def test_adding_and_odd_vectors(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(300)]
    odd = [(1000, None), (1001, [0.0] * 8), (1002, [math.nan] + [1.0] * 7), (1003, [None] + [1.0] * 7), (1004, [math.inf] + [1.0] * 7)]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame(rows[:200] + odd, schema)
    one = VectorIndex.build(df, str(tmp_path / "i"), lists=5)
    assert one.table().count() == 200
    assert one.add(spark.createDataFrame(rows[150:] + odd + [rows[299]], schema)) == 100 and one.add(spark.createDataFrame(rows, schema)) == 0
    again = VectorIndex(spark, one.path)
    every = spark.createDataFrame(rows, schema)
    asked = _queries(every, 7).unionByName(spark.createDataFrame([(-1, [0.0] * 8), (-2, None), (-3, [math.nan] * 8)], "query_id long, query array<double>"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in again.search(asked, 4, probes=5).collect())
    assert got == sorted((r["query_id"], r["rank"], r["vec_id"]) for r in retrieval.top_k_batch(every, _queries(every, 7), 4).collect())
    with pytest.raises(Exception, match="(?i)exists"):
        VectorIndex.build(df, one.path, lists=5)


def test_index_of_nothing(spark, tmp_path):
    none = VectorIndex.build(spark.createDataFrame([], "vec_id long, embedding array<double>"), str(tmp_path / "i"))
    assert none.search(spark.createDataFrame([(1, [1.0])], "query_id long, query array<double>")).count() == 0


def _plain(texts, most, least, k):
    """TF-IDF rows of unit length and their principal components, by NumPy."""
    split = [[w for w in re.findall(r"\w+", t.lower()) if len(w) > 1] for t in texts]
    grams = [w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] for w in split]
    tf, df = Counter(g for d in grams for g in d), Counter(g for d in grams for g in set(d))
    kept = sorted((g for g in tf if df[g] >= least), key=lambda g: -tf[g])[:most]
    rows = np.array([[d.count(g) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g in kept] for d in grams], float)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)
    centred = rows - rows.mean(0)
    _, _, parts = np.linalg.svd(centred, full_matrices=False)
    return kept, rows, centred @ parts[:k].T


def test_features_against_numpy(spark, tmp_path):
    draw = random.Random(4)
    vocabulary = [f"term{i}" for i in range(30)]
    texts = [" ".join(draw.choices(vocabulary, weights=range(30, 0, -1), k=draw.randrange(3, 40))) for _ in range(60)] + ["", "nothing known"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = features.Features.fit(df, most=12, least_documents=2, components=5)
    kept, rows, projected = _plain(texts, 12, 2, 5)
    # terms of equal frequency may change places at the end of the list
    assert len(set(model.counts.vocabulary) ^ set(kept)) <= 2
    got = {r["doc_id"]: r for r in model.transform(df).collect()}
    if set(model.counts.vocabulary) == set(kept):
        order = [model.counts.vocabulary.index(g) for g in kept]
        np.testing.assert_allclose(np.array([got[i]["tfidf"] for i in range(len(texts))])[:, order], rows, atol=1e-9)
        ours = np.array([got[i]["features"] for i in range(len(texts))])
        np.testing.assert_allclose(np.abs(ours), np.abs(projected), atol=1e-6)
    model.save(spark, str(tmp_path / "m"))
    again = {r["doc_id"]: r["features"] for r in features.Features.load(spark, str(tmp_path / "m")).transform(df).collect()}
    assert all(np.allclose(again[i], got[i]["features"]) for i in again)


def test_pairs_of_frequent_words_alone_are_counted(spark, monkeypatch):
    draw = random.Random(5)
    texts = [" ".join(draw.choices([f"term{i}" for i in range(40)], weights=[2.0**-i for i in range(40)], k=30)) for _ in range(80)] + ["only once " * 60]
    listed = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(features.kept_words("text").alias("w"))
    split = [t.split() for t in texts]
    grams = [w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)] for w in split]
    n, docs = Counter(g for d in grams for g in d), Counter(g for d in grams for g in set(d))
    for most in (3, 12, 10_000):
        want = sorted(((g, n[g], docs[g]) for g in n if docs[g] >= 2), key=lambda r: (-r[1], r[0]))[:most]
        assert [tuple(r) for r in features._vocabulary(listed, most, 2)] == want
    seen = []
    monkeypatch.setattr(features, "_pairs_of", lambda some: seen.append(some) or (lambda w: []))
    features._vocabulary(listed, 3, 2)
    assert seen == [{"term0", "term1", "term2"}]


def test_features_of_little(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string")
    assert features.Features.fit(df) is None and features.Features.fit(df.limit(0)) is None
    assert features.Features.fit(spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")) is None
    plain = features.Features.fit(spark.createDataFrame([(1, "one two"), (2, "one two")], "doc_id long, text string"), components=None)
    assert sorted(plain.counts.vocabulary) == ["one", "one two", "two"]
    assert [len(r["features"]) for r in plain.transform(df).collect()] == [3, 3, 3]


def test_batch_search_of_ties_odd_vectors_and_names(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 3)
    draw = np.random.default_rng(6)
    some = draw.normal(size=(5, 4))
    rows = [(f"v{i:02d}", some[i % 5].tolist()) for i in range(40)]  # eight copies of each vector
    odd = [("null", None), ("zero", [0.0] * 4), ("nan", [math.nan, 1.0, 1.0, 1.0]), ("part", [None, 1.0, 1.0, 1.0]), ("far", [math.inf] * 4), ("long", [1.0] * 5), ("none", [])]
    df = spark.createDataFrame(rows + odd, "name string, e array<double>")
    asked = df.select(F.col("name").alias("query_id"), F.col("e").cast("array<float>").alias("query"))
    got = {}
    for r in retrieval.top_k_batch(df, asked, 3, "name", "e").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["name"], r["similarity"])
    assert set(got) == {n for n, _ in rows} | {"long"}
    for i, (name, _) in enumerate(rows):
        assert [got[name][k][0] for k in (1, 2, 3)] == [f"v{j:02d}" for j in range(i % 5, 40, 5)][:3]
        assert abs(got[name][1][1] - 1) < 1e-6
    assert {n: round(s, 9) for n, s in got["long"].values()} == {"long": 1.0}
    assert retrieval.top_k_batch(df, asked.limit(0), 3, "name", "e").count() == 0
    assert retrieval.top_k_batch(df.limit(0), asked, 3, "name", "e").count() == 0
