"""The corpus operators on awkward rows, against SQL and against brute force."""

import hashlib
import os
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle import SF_DIR, same, sql_rows  # noqa: E402

P = pytest.importorskip("public_tokenizers")

from tessera.llm import embedding_dedup, exact_dedup, language_id, lm_scoring, minhash_dedup, mixing, packing, quality, substring_dedup, token_counts  # noqa: E402
from tessera.llm.queries import QUERIES, SQL  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} of{i}" for i in range(20_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again until night falls on the hills", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog again and again until night falls on the hills", "en", "a", 1),
    (3, "The  quick brown\tfox jumps over the lazy dog again and again until night falls on the hills", "en", None, 1),
    (4, None, None, "b", None), (5, "", "en", "b", 0), (6, " \n\t ", "de", "b", 3), (7, "x", "de", "c", 1), (8, LONG, "de", "c", 1),
    (9, "start one " + PASSAGE + " finish one", "fr", "c", 1), (10, "start two " + PASSAGE + " end two", "fr", "c", 1),
    (11, "été 😀 naïve <|endoftext|> 12,345!! don't", "fr", None, 1), (12, "... 123 ---", None, "a", 1), (None, "no id here", "en", "a", 1),
    (13, "same row", "en", "a", 1), (13, "same row", "en", "a", 1),
]

@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)

@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)

@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same(QUERIES[name](spark, SF_DIR).toPandas(), sql_rows(SQL[name]))

def test_exact_dedup(docs, none):
    rows = exact_dedup.content_sort(docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and sum(r["kept"] for r in rows if r["doc_id"] == 13) == 1
    assert (by[2]["keep_id"], by[2]["group_size"], by[2]["kept"]) == (1, 2, False)
    assert by[4]["keep_id"] == 4 and by[5]["keep_id"] == 4 and by[6]["group_size"] == 1
    assert by[4]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup.content_sort(none).count() == 0
    clash = docs.withColumn("keep_id", F.lit("x")).withColumn("kept", F.lit("y"))
    assert exact_dedup.keep_first(clash).columns == clash.columns

def test_exact_dedup_of_a_hot_text(spark):
    rows = [(i, "one very  common text" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = exact_dedup._keyed(df.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text")), "__id", "__text")
    assert len(exact_dedup._splitters(keyed, 8)[1]) == 1  # its copies lie in several ranges
    by = {r["doc_id"]: r for r in exact_dedup.content_sort(df).collect()}
    assert all((by[i]["keep_id"], by[i]["group_size"], by[i]["kept"]) == ((1, 2000, i == 1) if i % 3 else (i, 1, True)) for i in range(3000))

def test_forest_candidates_do_not_depend_on_batches():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    keys = sorted(tuple(rng.integers(0, 3, minhash_dedup.DEPTH).tolist()) for _ in range(40_000))
    rows = pd.DataFrame({"tree": 0, "key": [np.array(k, ">u4").tobytes() for k in keys], "id": np.arange(len(keys)), "n": 10})

    def found(size):
        parts = [rows.iloc[a : a + size].reset_index(drop=True) for a in range(0, len(rows), size)]
        out = pd.concat(list(minhash_dedup._neighbours(iter(parts))))
        return set(out[out["kind"] == 0][["a", "b"]].itertuples(index=False, name=None))

    whole = set(minhash_dedup._pairs(rows).itertuples(index=False, name=None))
    assert found(50) == found(1000) == found(40_000) == whole and len(whole) > 10_000

def test_minhash_recall_in_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = []
    for c, size in enumerate((200, 600, 40, 7)):
        base = [f"c{c}w{i}" for i in range(150)]
        for j in range(size):
            words = list(base)
            for at in rng.choice(150, int(rng.integers(0, 4)), replace=False):
                words[at] = f"own{j}x{at}"
            rows.append((1000 * c + j, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: c for i, (_, c) in jaccard_links(rows, 4).items()}
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99

def jaccard_links(rows, k):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}

def test_minhash_against_all_pairs(spark, docs, none):
    base = [f"t{i}" for i in range(200)]
    more = [(100 + i, " ".join(base[: 3 * i] + [f"new{i}"] + base[3 * i + 1 :])) for i in range(30)]
    rows = [(r[0], r[1]) for r in ROWS if r[0] is not None and r[0] != 13] + more
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == jaccard_links(rows, 4)
    odd = minhash_dedup.near_duplicates(docs).collect()
    assert len(odd) == len(ROWS) and all(r["kept"] for r in odd if r["doc_id"] is None)
    assert minhash_dedup.near_duplicates(none).count() == 0

@pytest.mark.parametrize(("copies", "cut"), [(300, 34), (300, 40), (3000, 34)])
def test_minhash_star_of_edited_copies(spark, copies, cut):
    import numpy as np

    # each copy has its own words at the places it edits; two of them have J < 0.8 with each other
    rng = np.random.default_rng(copies + cut)
    base = [f"w{i}" for i in range(400)]
    rows = [(10_000, " ".join(base))]
    for c in rng.permutation(copies).tolist():
        words, at = list(base), sorted(rng.choice(97, cut // 4, replace=False) * 4)
        for i in at:
            words[i] = f"own{c}x{i}"
        rows.append((20_000 + 7 * c, " ".join(words)))
    sets = minhash_dedup.shingle_sets([t for _, t in rows], 4)
    alike = [len(np.intersect1d(sets[0], s, True)) / len(np.union1d(sets[0], s)) for s in sets[1:]]
    assert min(alike) >= 0.8
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {10_000} and len(got) == copies + 1

def test_minhash_rounds_look_at_what_moved(spark, monkeypatch):
    import numpy as np

    # a star that rounds gather over its hub, and a crowd without an original, whose pairs stay apart
    rng = np.random.default_rng(8)
    rows = []
    for group, (size, cut) in enumerate([(300, 40), (300, 48)]):
        base = [f"g{group}w{i}" for i in range(400)]
        for c in rng.permutation(size).tolist():
            words = list(base)
            for i in sorted(rng.choice(97, cut // 4, replace=False) * 4):
                words[i] = f"own{c}x{i}"
            rows.append((10_000 * group + 7 * c + 1, " ".join(words)))
        if group == 0:
            rows.append((0, " ".join(base)))
    looked, apart = [], minhash_dedup._apart

    def counted(pairs, label):
        looked.append(pairs.count())
        return apart(pairs, label)

    monkeypatch.setattr(minhash_dedup, "_apart", counted)
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in jaccard_links(rows, 4).items()}
    assert len(looked) > 2 and sum(looked[2:]) < looked[1] < looked[0]

def test_substring_dedup_on_odd_rows(docs, none):
    by = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert by[10]["kept_text"] == "start two end two" and by[10]["n_removed"] == 60
    assert by[9]["n_removed"] == 0 and by[4]["n_words"] == 0 and by[2]["kept_text"] == ""
    assert substring_dedup.remove_repeats(none).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("batch", "shard", "blob", "n_words", "kept_text")})
    assert substring_dedup.remove_repeats(clash).count() == len(ROWS)

def naive_repeats(rows):
    first, out = {}, {}
    for i, text in rows:
        w = text.split()
        for j in range(len(w) - 12):
            g = tuple(w[j : j + 13])
            first[g] = min(i, first.get(g, i))
    for i, text in rows:
        w, gone = text.split(), set()
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        out[i] = " ".join(x for j, x in enumerate(w) if j not in gone)
    return out

def repeating_rows():
    """A phrase in many documents between words of their own, lines that repeat, copies, and part of a passage."""
    import random

    draw = random.Random(4)
    phrase = [f"p{i}" for i in range(18)]
    rows = []
    for i in range(300):
        own = [draw.choice("abcdefgh") + str(draw.randrange(40)) for _ in range(30)]
        at = draw.randrange(30)
        cut = draw.randrange(3)
        rows.append((1000 - i, " ".join(own[:at] + phrase[cut:] + own[at:])))
    rows += [(2000 + i, " ".join(["x y z"] * (4 + i))) for i in range(12)] + [(3000 + i, "w " * (10 + i)) for i in range(8)]
    return rows + [(4000, rows[5][1]), (10, rows[5][1])]

def test_substring_dedup_of_hot_phrases_and_repeated_lines(spark, monkeypatch):
    rows = repeating_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = naive_repeats(rows)
    assert {r["doc_id"]: r["kept_text"] for r in substring_dedup.remove_repeats(df).collect()} == want
    # the same with small batches and windows of the phrase going one by one; workers fork, so the parts run here
    monkeypatch.setattr(substring_dedup, "HOT", 20)
    monkeypatch.setattr(substring_dedup, "CHARS", 5000)
    assert run_here(rows) == want
    # nothing goes unless the automaton finds it
    monkeypatch.setattr(substring_dedup, "compile_automaton", lambda spelled: type("Finds", (), {"iter": lambda self, s: []})())
    assert run_here(rows) == {i: " ".join(t.split()) for i, t in rows}

def run_here(rows, shards=3):
    """All steps of substring_dedup in this process."""
    import types

    import pandas as pd

    sd = substring_dedup
    context = sd.TaskContext
    sd.TaskContext = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0))
    try:
        sent = pd.concat(sd._send_anchors(shards)(iter([pd.DataFrame(rows, columns=["doc_id", "text"])])))
    finally:
        sd.TaskContext = context
    texts = sent[sent["kind"] == sd.TEXTS]

    def by_shard(table, search):
        return pd.concat([x for s in range(shards) for x in search(iter([table[table["shard"] == s]]))], ignore_index=True)

    replies = by_shard(sent[sent["kind"] == sd.ANCHORS], sd._find_recurring)
    group = sd._send_passages(shards)
    passages = pd.concat([group(texts[texts["batch"] == b], replies[replies["batch"] == b]) for b in texts["batch"]])
    found = by_shard(passages, sd._search)
    out = pd.concat([sd._strip(texts[texts["batch"] == b], found[found["batch"] == b]) for b in texts["batch"]])
    return dict(zip(out["doc_id"].tolist(), out["kept_text"], strict=True))

def test_token_counts_against_the_library(spark, docs, none):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    texts = [r[1] or "" for r in ROWS] + [r[0] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    counter = token_counts.WordCounter(path)
    texts += [form % chr(c) for c in (0xA7CB, 0xA7DC, 0x378, 0x32808, 0x3D808, 0x3F988) for form in ("a%sb", "%s", "x %s y", "\x1c%s")]
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path).collect()}[4] == 0
    assert token_counts.count_tokens(none, path).count() == 0

def test_packing_round_trip(spark, docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    for text in [r[1] or "" for r in ROWS] + ["a \n b", "x" * 9000, " " * 6000 + "y"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder(text) == b"".join(i.to_bytes(4, "little") for i in ids)
    rows = packing.pack_documents(docs, path).collect()
    pieces = sorted((r for r in rows if r["doc_id"] == 8), key=lambda r: r["piece"])
    raw = b"".join(i.to_bytes(4, "little") for i in [*library.encode(LONG, add_special_tokens=False).ids, 0])
    assert sum(r["length"] for r in pieces) == len(raw) // 4 and all(r["length"] == 2048 for r in pieces[1:])
    assert all(r["ids_crc32"] == zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in pieces)
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 2048 and packing.pack_documents(none, path).count() == 0

def test_local_search_empties_bins():
    import numpy as np

    rng = np.random.default_rng(1)
    cases = [([6, 5, 5, 4, 4, 3, 3] * 20, 10)] + [(rng.integers(a, b, 600).tolist(), 2048) for a, b in ((500, 901), (600, 1025), (200, 801), (300, 1101))]
    for sizes, capacity in cases:
        found, before = packing.pack(sizes, capacity), packing.best_fit(sizes, capacity)
        assert sorted(i for b in found for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in found)
        assert packing.lower_bound(sizes, capacity) <= len(found) < len(before)
    assert len(packing.pack(*cases[0])) == 60 and packing.pack([], 10) == [] and packing.lower_bound([], 10) == 0
    assert packing.lower_bound([1025] * 5 + [1023] * 5, 2048) == 5 and packing.lower_bound([1500, 1500, 600, 600, 600], 2048) == 3

def test_packing_of_repeated_and_null_ids(docs):
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).collect()
    assert sum(r["doc_id"] == 13 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)

def test_language_id_held_out(spark, docs, none):
    known = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    got = QUERIES["op6_language_id"](spark, SF_DIR).toPandas()
    out = got[got["held_out"] & (got["lang_pred"] != "und")]
    assert (out["lang_pred"] == known.loc[out["doc_id"]].to_numpy()).mean() > 0.9
    model = language_id.fit(docs)
    by = {r["doc_id"]: r["p"] for r in language_id.identify(docs, model).select("doc_id", F.col("__lang.lang_pred").alias("p")).collect()}
    assert all(by[i] == "und" for i in (4, 5, 6, 12)) and language_id.keep_identified(docs).columns == docs.columns
    assert language_id.keep_identified(none).count() == 0

def test_language_parses_against_longest_matches():
    import random

    draw = random.Random(1)
    model = {k: language_id.squeeze("".join(draw.choice(letters) for _ in range(2000))) for k, letters in (("aa", "abcde "), ("bb", "cdefg "))}

    def naive(text, sample):
        t = ""
        for c in text:
            t += c.lower() if c.isalpha() else "" if t.endswith(" ") else " "
        n = i = 0
        while i < len(t):
            j = i + 1
            while j <= len(t) and t[i:j] in sample:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
        return n

    parser = language_id.Parser(model)
    texts = ["".join(draw.choice("abcdefgxA 1") for _ in range(n)) for n in (1, 5, 255, 256, 257, 512, 4000)] + ["", "123", "ab" * 700]
    phrases, _, _ = parser.counts(texts)
    assert phrases.astype(int).tolist() == [[naive(t, model[k]) for t in texts] for k in parser.langs]
    # ties go to the first language; no model, no language
    assert language_id.Parser({"bb": "abc", "aa": "abc"}).predict(["cab"])[0] == ["aa"]
    assert language_id.Parser({}).predict(["abc"]) == (["und"], [0.0])

def test_language_stage_without_labels(spark, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language_id.keep_identified(bare).count() == len(ROWS)
    known = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    some = known.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    got = language_id.keep_identified(some).select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    want = known.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"].loc[got.index]
    assert got.notna().all() and (got == want).mean() > 0.95

def test_language_id_with_a_rare_short_language(spark):
    d = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "text").where("lang is not null and text is not null")
    rare = spark.createDataFrame([(10**9, "zz", "abcdefghij"), (10**9 + 1, "yy", "x")], "doc_id long, lang string, text string")
    model = language_id.fit(d.unionByName(rare))
    assert len(model["zz"]) == 10 and min(len(t) for k, t in model.items() if len(k) == 2 and k not in ("yy", "zz")) > 5000
    got = language_id.identify(d, model).where("__lang.lang_pred <> 'und'").select("lang", "__lang.lang_pred").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9

def test_language_id_of_texts_that_open_without_letters(spark):
    table = "12 | 34 | -- | " * 60
    said = {"aa": "the quick brown fox jumps over the lazy dog and ", "bb": "der schnelle braune fuchs springt immer wieder "}
    rows = [(1, "aa", said["aa"] * 400)] + [(i, "bb", table + said["bb"] * 400) for i in (2, 3)] + [(4, "cc", table + "x")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.fit(df)
    assert len(model["aa"]) > 18_000 and len(model["bb"]) > 19_900 and model["cc"] == "x"
    got = {r["doc_id"]: r["p"] for r in language_id.identify(df, model).select("doc_id", F.col("__lang.lang_pred").alias("p")).collect()}
    assert (got[1], got[2], got[3]) == ("aa", "bb", "bb")

def naive_lattice(lattice, vocabulary):
    """Probability of a string over all segmentations, by recursion."""
    import math
    from functools import lru_cache

    @lru_cache(maxsize=None)
    def total(s):
        if not s:
            return 1.0
        ways = sum(vocabulary.p[vocabulary.ids[s[:n]]] * total(s[n:]) for n in range(1, len(s) + 1) if s[:n] in vocabulary.ids)
        return ways + (math.exp(lattice.spelled(s[0])) * total(s[1:]) if s[0] not in vocabulary.ids else 0)

    return total

def test_lattice_against_all_segmentations():
    import numpy as np

    vocabulary = lm_scoring.pieces(P.path("piece_bpe_32k.model"))
    lattice = lm_scoring.Lattice(vocabulary)
    total = naive_lattice(lattice, vocabulary)
    words = ["the", "naïve", "x", "😀a", "quick-brown", "ééé", "a" * 30]
    assert np.allclose(lattice.words([w.encode() for w in words]), [np.log(total(lm_scoring.MARK + w)) for w in words])

def test_lm_base_scores(docs, none):
    import math
    from collections import Counter

    path = P.path("piece_bpe_32k.model")
    rows = {r["doc_id"]: r for r in lm_scoring.score_documents(docs, path, F.col("doc_id") == 2).collect()}
    taught = [r[1] for r in ROWS if r[0] not in (2, None)]
    counts = Counter(w for t in taught for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, text in [(r[0], r[1]) for r in ROWS if r[0] is not None]:
        words = [*(text or "").encode().lower().split(), None]
        assert rows[i]["n_tokens"] == len(words) and rows[i]["train_tokens"] == n and rows[i]["n_known"] == sum(w in counts for w in words)
        assert rows[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    assert lm_scoring.score_documents(none, path, F.lit(False)).count() == 0
    # the score itself: of every word, and of the end, (c + V L) / (N + V)
    vocabulary = lm_scoring.pieces(path)
    lattice = lm_scoring.Lattice(vocabulary)
    total = naive_lattice(lattice, vocabulary)
    for i, text in [(r[0], r[1]) for r in ROWS if r[0] not in (None, 8)]:
        words = [*(text or "").encode().lower().split(), None]
        part = [math.exp(lattice.end) if w is None else total(lm_scoring.MARK + w.decode()) for w in words]
        assert rows[i]["score"] == pytest.approx(sum(math.log10((counts[w] + v * x) / (n + v)) for w, x in zip(words, part, strict=True)))
    every = lm_scoring.score_documents(docs, path, F.lit(True)).collect()  # nothing is learned; repeated rows and null ids stay
    assert sorted(str(r["doc_id"]) for r in every) == sorted(str(r[0]) for r in ROWS) and {r["train_tokens"] for r in every} == {0}

def test_embedding_links_against_all_pairs(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 64))
    vecs = np.concatenate([b + 0.3 * rng.normal(size=(30, 64)) for b in base] + [base[:1], base[:1], rng.normal(size=(600, 64))])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vecs)]
    odd = [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] * 64, 1), (9003, vecs[0].tolist(), None), (None, vecs[0].tolist(), 0), (9004, [], 1)]
    df = spark.createDataFrame(rows + odd + rows[:1], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embedding_dedup, "LIST", 100)  # about 13 lists a label
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    got = embedding_dedup.near_vectors(df).collect()
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    near = (unit @ unit.T >= embedding_dedup.THRESHOLD) & (np.arange(len(vecs))[:, None] % 2 == np.arange(len(vecs)) % 2)
    times = np.ones(len(vecs), int)
    times[0] = 2  # the repeated row
    links = near @ times - 1
    least = np.arange(len(vecs))
    while (new := np.array([least[n].min() for n in near])).tolist() != least.tolist():
        least = new
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd) + 1 and links.sum() > 3000
    assert sum(by[i]["n_links"] for i in range(len(vecs))) >= 0.999 * links.sum()
    assert [by[i]["component_id"] for i in range(len(vecs))] == least.tolist()
    assert all(by[i]["kept"] == (least[i] == i) for i in range(len(vecs)))
    assert all((by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True) for i in (9000, 9001, 9002, 9003, 9004))
    assert by[None]["n_links"] == 0 and by[None]["kept"] and embedding_dedup.near_vectors(df.limit(0)).count() == 0

def test_mixing_meets_targets(spark):
    rows = QUERIES["op4_source_mixing"](spark, SF_DIR).toPandas()
    sizes = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source").toPandas().set_index("doc_id")["source"]
    rows["source"] = sizes.loc[rows["doc_id"]].fillna("~null").to_numpy()
    assert (rows["taken"] <= 3 * rows["size"]).all() and rows["target"].le(3 * rows["source_size"] + 1e-6).all()
    each = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((each["taken"] - each["target"]).abs() <= 2 * each["most"]).all()
    assert each["target"].sum() == pytest.approx(rows["size"].sum())
    again = QUERIES["op4_source_mixing"](spark, SF_DIR).toPandas()
    assert again.set_index("doc_id")["taken"].to_dict() == rows.set_index("doc_id")["taken"].to_dict()

def filled(sizes, weights, times):
    """Targets by filling step by step: full sources leave, the rest is shared anew."""
    target, open_ = {}, dict(sizes)
    left = sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if level * weights[s] > times * sizes[s]]
        if not full:
            return target | {s: level * weights[s] for s in open_}
        for s in full:
            target[s] = times * open_.pop(s)
            left -= target[s]
    return target

@pytest.mark.parametrize("sizes", [{"a": 5, "b": 1000, "c": 7}, {"a": 100, "b": 100, "c": 100, "d": 100, "e": 1}, {"a": 0, "b": 10}, {"a": 1, "b": 1, "c": 1, "d": 5000}, {"a": 9}])
def test_mixing_targets_against_filling(spark, sizes):
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(filled(sizes, weights, mixing.REPEATS))

def test_hypergeometric_draws(spark):
    import math

    total, marked, drawn = 30, 11, 9
    u = (F.col("id") + 0.5) / 20_000
    rows = spark.range(20_000).select(mixing.hypergeometric(*(F.lit(x).cast("long") for x in (total, marked, drawn)), u).alias("k")).groupBy("k").count().collect()
    for r in rows:
        p = math.comb(marked, r["k"]) * math.comb(total - marked, drawn - r["k"]) / math.comb(total, drawn)
        assert abs(r["count"] / 20_000 - p) < 1e-4
    assert sum(r["count"] * r["k"] for r in rows) / 20_000 == pytest.approx(drawn * marked / total, abs=1e-3)

def test_split_quotas_are_exact(spark):
    quotas = [100, 0, 37, 1, 1000]
    leaves = mixing.split_quotas(spark.range(1).select(F.array(*(F.lit(q).cast("long") for q in quotas)).alias("quotas")), 16).collect()
    assert len(leaves) == 16 and [sum(r["quotas"][i] for r in leaves) for i in range(5)] == quotas
    each = [sum(r["quotas"]) for r in leaves]
    assert max(each) - min(each) <= 4 and min(min(r["quotas"]) for r in leaves) >= 0

def _spark_hash(*values) -> int:
    """xxhash64 of int and long values, as Spark chains it."""
    import struct

    import xxhash

    seed = 42
    for v, kind in values:
        seed = xxhash.xxh64_intdigest(struct.pack(kind, v), seed)
    return seed - (1 << 64) if seed >> 63 else seed

def test_taken_and_shards_against_plain_streams(spark):
    """Each source's stream laid out in plain Python; shards hold disjoint blocks, all of them, of the quotas drawn."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source", "text").collect()
    sizes = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    by = {}
    for d in docs:
        by.setdefault(d["source"], []).append(d["doc_id"])
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [s for s in by if s is None]
    total = {s: sum(sizes[i] for i in by[s]) for s in names}
    target = filled(total, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}, mixing.REPEATS)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = max(1, -(-sum(total.values()) // mixing.BLOCKS))
    taken, blocks = {}, {}
    for s in names:
        draw = {i: _spark_hash((mixing.SEED, "<i"), (i, "<q")) for i in by[s]}
        at = 0
        for i in sorted(by[s], key=lambda i: (draw[i] % buckets, draw[i], i)):
            uses = [e for e in range(mixing.REPEATS) if e * total[s] + at + sizes[i] / 2 < target[s]]
            taken[i] = len(uses) * sizes[i]
            blocks[i] = [(names.index(s) + 1, min((e * total[s] + at) // block, -(-target[s] // block) - 1)) for e in uses]
            at += sizes[i]
    rows = QUERIES["op4_source_mixing"](spark, SF_DIR).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == taken
    placed = mixing.place(spark.read.parquet(f"{SF_DIR}/documents.parquet"), ["doc_id"]).where("shard is not null").collect()
    got, owner = {}, {}
    for r in placed:
        got.setdefault(r["doc_id"], []).append((r["source_no"], r["block"]))
        assert owner.setdefault((r["source_no"], r["block"]), r["shard"]) == r["shard"]  # a block is in one shard
    assert {i: sorted(b) for i, b in got.items()} == {i: sorted(b) for i, b in blocks.items() if b}
    assert {r["doc_id"]: r["shards"] for r in rows} == {i: sorted(owner[b] for b in bs) for i, bs in blocks.items()}
    quotas = [int(-(-target[s] // block)) for s in names]
    leaves = mixing.split_quotas(spark.range(1).select(F.array(*(F.lit(q).cast("long") for q in quotas)).alias("quotas")), mixing.SHARDS).collect()
    for r in leaves:
        for k, q in enumerate(r["quotas"]):
            assert len([1 for (no, _), shard in owner.items() if no == k + 1 and shard == r["node"]]) <= q

def test_quotas_of_many_sources(spark):
    quotas = [(i * 7919) % 23 for i in range(1000)]
    leaves = mixing.split_quotas(spark.range(1).select(F.array(*(F.lit(q).cast("long") for q in quotas)).alias("quotas")), 8).collect()
    assert len(leaves) == 8 and [sum(r["quotas"][i] for r in leaves) for i in range(1000)] == quotas
    each = [sum(r["quotas"]) for r in leaves]
    assert max(each) - min(each) <= 3 and min(min(r["quotas"]) for r in leaves) >= 0
    # the share of a run of sources in a shard varies as a hypergeometric draw's does
    part = [sum(r["quotas"][:500]) for r in leaves]
    mean = sum(quotas[:500]) / 8
    deviation = (mean * (1 - sum(quotas[:500]) / sum(quotas)) * 7 / 8) ** 0.5
    assert all(abs(p - mean) < 5 * deviation for p in part) and len(set(part)) > 1

def test_mixing_of_odd_rows(spark, docs, none):
    assert mixing.mix(docs, 4).columns == docs.columns and mixing.mix(none, 4).count() == 0
    clash = docs.withColumns({c: F.lit(1) for c in ("size", "target", "shard", "bucket", "number")})
    assert mixing.mix(clash, 4).columns == clash.columns
    placed = mixing.place(docs, ["doc_id", "source"], 4).toPandas()
    words = {None: 0} | {r[0]: len((r[1] or "").split()) for r in ROWS}
    assert len(placed.drop_duplicates(["source_no", "bucket", "row"])) == len(ROWS)  # repeated rows are rows of their own
    assert all(r.size_ == words[r.doc_id] for r in placed.rename(columns={"size": "size_"}).itertuples() if r.doc_id == r.doc_id)
    last = placed.loc[placed["source"].isna(), "source_no"].unique()
    assert last.tolist() == [placed["source_no"].max()]  # null sources are one source, the last

CLASHES = "__gone __lang __x0 a b u v node component id n sig set_key key tree kind size block word pool bin offset piece length score predicted lang_pred cell list code".split()

@pytest.mark.parametrize("name", ["op3", "op6", "op8", "op10", "keep_one", "keep_identified"])
def test_clashing_columns_change_nothing(spark, docs, name):
    import public_tokenizers

    crowded = docs
    for c in CLASHES:
        crowded = crowded.withColumn(c, F.lit("x"))
    give = {
        "op3": lambda d: lm_scoring.score_documents(d, public_tokenizers.path("piece_bpe_32k.model"), F.col("doc_id") % 7 == 2),
        "op6": lambda d: language_id.identify(d, {"en": "the of and to", "de": "der die das und"}, "found").select("doc_id", "found.lang_pred", "found.score"),
        "op8": lambda d: packing.pack_documents(d, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "piece", "length", "ids_crc32"),
        "op10": lambda d: token_counts.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")),
        "keep_one": lambda d: minhash_dedup.keep_one(d).select("doc_id", "text"),
        "keep_identified": lambda d: language_id.keep_identified(d).select("doc_id", "text", "lang"),
    }[name]
    assert sorted(map(str, give(crowded).collect())) == sorted(map(str, give(docs).collect()))
    if name.startswith("keep"):
        assert set(CLASHES) < set({"keep_one": minhash_dedup.keep_one, "keep_identified": language_id.keep_identified}[name](crowded).columns)

def test_quality_held_out(spark):
    sf = SF_DIR.replace("sf0.001", "sf0.01")
    rows = QUERIES["op1_quality"](spark, sf).toPandas()
    known = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").toPandas().set_index("doc_id")["quality"]
    assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.5)).all()
    out = rows[rows["held_out"] & rows["doc_id"].isin(known.index)]
    truth = known.loc[out["doc_id"]].to_numpy()
    assert 0.5 < max(truth.mean(), 1 - truth.mean()) < (out["predicted"].to_numpy() == truth).mean()

def test_quality_votes_against_plain_cosines():
    import numpy as np

    texts = [f"Text number {i} says {'!' * (i % 7)} something {'12 ' * (i % 5)} and {'the same ' * (i % 4)}" for i in range(60)]
    counts = [np.unique(quality.trigrams(t), return_counts=True) for t in texts]
    labels = np.array([i % 3 == 0 for i in range(60)], float)
    model = quality.Classifier(counts, np.array([quality.structure(t) for t in texts]), labels)
    new = ["Text", "", "a b c !!!", "12 12 12 the same the same", "é😀", *texts[:3]]
    n = len(model.idf)
    for text, score in zip(new, model.scores(new), strict=True):
        tf = np.bincount(model.place[quality.trigrams(text)], minlength=n + 1)[:n]
        z = model._weigh(tf[None].astype(float), np.array([quality.structure(text)])) @ model.basis
        cosine = np.array([float(z[0] @ k) / max(np.linalg.norm(z), 1e-12) / np.linalg.norm(k) for k in model.known])
        near = np.argsort(-cosine, kind="stable")[: quality.NEIGHBOURS]
        weight = np.maximum(cosine[near], 0)
        assert score == pytest.approx((weight * labels[near]).sum() / weight.sum() if weight.sum() else labels.mean(), abs=2e-2)

def test_quality_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (4, 0), (8, 1), (13, 0), (None, 1), (99, 0), (7, None)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    rows = quality.score_quality(docs.withColumn("label", F.lit("x")), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 13}) == 1  # repeated rows score alike
    assert quality.score_quality(none, model).count() == 0
    bare = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score_quality(docs, bare).collect()} == {0.5}
    assert {r["score"] for r in quality.score_quality(docs, quality.fit(none, labels)).collect()} == {0.5}

def test_pipeline_stages(spark):
    """Each stage against its operator on the stage's own input, and the last against a round trip."""
    import corpus_pipeline as pipe

    from tessera.session import settle

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    operators = {
        "language_id": lambda d: {r["doc_id"] for r in language_id.identify(d, language_id.fit(d.where(language_id.id_remainder("doc_id", 5) != 0))).where("__lang.lang_pred <> 'und'").collect()},
        "exact_dedup": lambda d: {r["doc_id"] for r in exact_dedup.content_sort(d).where("kept").collect()},
        "near_dedup": lambda d: {i for i, (_, c) in jaccard_links([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()], 5).items() if i == c},
        "source_mixing": lambda d: {r["doc_id"] for r in mixing.place(d, ["doc_id"]).where("shard is not null").collect()},
    }
    step = docs
    for name, stage in pipe.STAGES[:-1]:
        out = settle(stage(spark, step, SF_DIR))
        assert out.columns == docs.columns
        assert {r[0] for r in out.select("doc_id").collect()} == operators[name](step)
        step = out
    packed = pipe.STAGES[-1][1](spark, step, SF_DIR).toPandas()
    assert packed["doc_id"].nunique() == step.select("doc_id").distinct().count() and packed.groupby("sequence_id")["length"].sum().max() <= 2048

def test_pipeline_of_odd_and_empty_tables(spark, docs, none):
    import corpus_pipeline as pipe

    for step, least in ((docs, 5), (none, 0)):
        for _, stage in pipe.STAGES:
            step = pipe.settle(stage(spark, step, SF_DIR))
        assert step.count() >= least
