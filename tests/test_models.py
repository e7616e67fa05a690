"""Models over tables: batches, retries, failures as rows, and one model for each worker."""

import math
import os
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle

from tessera.operators import models
from tessera.operators.models import Calls, HashedNgrams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests
QUICK = Calls(batch=4, attempts=3, wait=0.0)


class Flaky:
    """Fails the first two calls that hold a text, and every call that holds a bad one."""

    def __init__(self, folder=None):
        self.seen, self.calls = {}, []
        if folder:
            open(os.path.join(folder, f"made-{os.getpid()}-{id(self)}"), "w").close()

    def embed(self, texts):
        self.calls.append(list(texts))
        key = tuple(texts)
        self.seen[key] = self.seen.get(key, 0) + 1
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        if self.seen[key] < 3 and "flaky" in texts[0]:
            raise TimeoutError("later")
        return [[float(len(t)), 1.0] if "short" not in t else [1.0] for t in texts]


def test_retries_and_failures():
    model, waits = Flaky(), []
    texts = ["flaky", "b", "c", "d", "e", "bad", "g", "short", "i"]
    got = models.called(model.embed, lambda x: models._vector_fault(x, 2), texts, Calls(4, 3, 2.0, 10.0), waits.append)
    assert [x for x, _ in got] == [[5.0, 1.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0], [1.0, 1.0], None, [1.0, 1.0], None, [1.0, 1.0]]
    assert [why for _, why in got if why] == ["ValueError: bad text", "1 components instead of 2"]
    # two waits for the first batch, two for the batch with the bad text and two for the bad text alone
    assert waits == [2.0, 4.0] * 3 and [Calls().pause(i) for i in (1, 2, 3, 9)] == [2.0, 4.0, 8.0, 10.0]


@pytest.mark.parametrize("x, fault", [([1.0], None), ([math.nan], "numbers"), ([], "0 components"), (None, "no vector"), (["x"], "no vector"), ([1, 2], "2 components")])
def test_vectors_are_checked(x, fault):
    got = models._vector_fault(x, 1)
    assert got is None if fault is None else fault in got


def test_wrong_number_of_results():
    got = models.called(lambda texts: [[1.0]], lambda x: None, ["a", "b"], QUICK, lambda s: None)
    assert got == [([1.0], None), ([1.0], None)]  # one at a time, each has its own


def test_embedding_a_table(spark, tmp_path):
    texts = [f"word {i}" if i % 10 else "bad one" for i in range(200)] + [None, "", "flaky"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    folder = str(tmp_path)
    embedded = models.embed(rows, lambda: Flaky(folder), calls=QUICK)
    done = embedded.collect()
    assert len(embedded.collect()) == len(done)  # in other tasks of the same workers
    assert len(done) == len(texts)
    for r in done:
        bad = r["text"] is not None and "bad" in r["text"]
        assert (r["embedding"] is None) == (r["text"] is None or bad) and (r["embedding_error"] is not None) == bad
    made = [n for n in os.listdir(folder) if n.startswith("made-")]
    assert len(made) == len({n.split("-")[1] for n in made})  # a worker makes one model


def test_store_embedded_keeps_failures(spark, tmp_path):
    rows = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None)], "id long, text string")
    good, lost = str(tmp_path / "good"), str(tmp_path / "lost")
    assert models.store_embedded(rows, Flaky, good, lost, calls=QUICK) == (1, 2)
    assert [r["id"] for r in spark.read.parquet(good).collect()] == [1]
    assert {(r["id"], r["embedding_error"]) for r in spark.read.parquet(lost).collect()} == {(2, "ValueError: bad text"), (3, None)}
    assert models.store_embedded(rows.limit(0), Flaky, good, lost) == (0, 0)


class Echo:
    def generate(self, prompts):
        if any("refuse" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]


def test_generating_answers(spark):
    rows = spark.createDataFrame([(1, "say"), (2, "refuse"), (3, None), (4, "")], "id long, prompt string")
    got = {r["id"]: (r["answer"], r["answer_error"]) for r in models.generate(rows, Echo, calls=QUICK).collect()}
    assert got == {1: ("SAY", None), 2: (None, "RuntimeError: no"), 3: (None, None), 4: ("", None)}


def test_hashed_ngrams_know_all_scripts():
    like = lambda a, b: float(np.dot(*(np.array(v) for v in HashedNgrams().embed([a, b]))))
    assert like("control systems", "control system") > 0.6 > like("control systems", "banana bread")
    assert like("система управления", "системы управления") > 0.5 > like("система управления", "банановый хлеб")
    assert HashedNgrams(8).embed(["", "  "]) == [[0.0] * 8] * 2 and abs(like("日本語 の 文", "日本語 の 文") - 1) < 1e-9


class Words:
    """Tags by a list: capitalised words are names, known verbs verbs, signs punctuation."""

    def tag(self, terms):
        if any("broken" in t for t in terms):
            raise RuntimeError("no model")
        kind = lambda w: "PUNCT" if not w.isalnum() else "VERB" if w in ("run", "moves") else "PROPN" if w[0].isupper() else "NOUN"
        return [[(w, kind(w)) for w in t.split()] for t in terms]


def test_terms_by_their_kind(spark):
    terms = spark.createDataFrame([(t,) for t in ("pump", "run", "run pump", "the", "- !", "Bosch", "broken", "", None)], "term string")
    got = models.of_kinds(terms, Words, stop_words=["The"], calls=QUICK)
    assert sorted(r["term"] for r in got.collect()) == ["Bosch", "pump", "run pump"] and got.columns == ["term"]
    assert sorted(r["term"] for r in models.of_kinds(terms, Words, kinds=["VERB"], calls=QUICK).collect()) == ["run", "run pump"]


def test_hashed_grams_against_plain_python(monkeypatch):
    monkeypatch.setattr(models, "HASHED", 20)
    texts = ["", " ", "a a a", "aaaaaaa aaaaaa ab", "Ünïcode 漢字漢字漢字 😀😀😀😀 \ud800x \udfff?", "x" * 300 + " y", "<a> <<>> >", "pump valve pump"]
    for model in (HashedNgrams(), HashedNgrams(7, 1, 2), HashedNgrams(32, 2, 8)):
        got = model.embed(texts)
        assert model.embed([]) == []
        for text, vector in zip(texts, got, strict=True):
            out = [0.0] * model.dim
            for f in (f"<{w}>" for w in text.lower().split()):
                for gram in {f} | {f[i : i + n] for n in range(model.least, model.most + 1) for i in range(len(f) - n + 1)}:
                    h = zlib.crc32(gram.encode("utf-8", "replace"))
                    out[h % model.dim] += 1.0 if h & 0x80000000 else -1.0
            size = math.sqrt(sum(x * x for x in out))
            assert vector == ([x / size for x in out] if size else out)


def test_key_phrases_by_a_model(spark):
    from tessera.operators import keywords

    docs = spark.createDataFrame([(1, "насос насос клапан"), (2, "valve valve pump"), (3, None)], "doc_id long, text string")
    got = keywords.key_phrases(docs, models.vectors(HashedNgrams), n=1).collect()
    best = {r["doc_id"]: r["term"] for r in got if r["score"] is not None}
    assert "насос" in best[1] and "valve" in best[2]
    picked = keywords.diverse(keywords.key_phrases(docs.limit(2), models.vectors(HashedNgrams), n=5), models.vectors(HashedNgrams), n=2)
    assert {(r["doc_id"], r["rank"]) for r in picked.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
