import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars, text, vector
from tessera.operators import centroid, chat, chunking, flow, gate, ingest, keywords, links, quality, retrieval, store
from tessera.plans import config
from tessera.sources import files, sinks
from tessera.streaming import streams


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n, kept", [(0, 0), (1, 0), (2, 1), (10, 9), (11, 10), (12, 10)])
def test_history_window(spark, n, kept):
    rows = [(1, i, "user", f"m{i}") for i in range(n)]
    assert chat.window(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == kept


def test_cache_key_window_leaves_out_two(spark):
    rows = spark.createDataFrame([(1, i, "user", f"m{i}") for i in range(12)], "conv_id long, turn long, role string, text string")
    assert len(chat.api_history(rows, skip=2).first()["messages"]) == 9


def test_quality_cases(spark):
    words = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    score = lambda t, **k: one(spark, quality.quality_score(F.lit(t), **k))
    assert score("short") == 0.1 and score("." * 60) == 0.1
    base, para = score(words), score(words + "\n\nend")
    assert base == pytest.approx(0.25 + 0.15 + 0.1 + 0.03)
    assert para > base - 0.05
    assert one(spark, quality.quality_score(F.lit(None).cast("string"))) == 0.1


def test_sanitize_and_sparse(spark):
    assert one(spark, text.sanitize(F.lit("<b>été</b>\x07 @#ok"))) == "été ok"
    terms = text.query_terms(F.lit("what is .. plc?"))
    assert one(spark, gate.sparse_score(terms, ["plc"])) == 0.5
    assert one(spark, gate.sparse_score(text.query_terms(F.lit("scada")), ["SCADA"])) == 0.0


def test_fused_is_not_rounded(spark):
    assert one(spark, gate.fused_score(F.lit(0.5), F.lit(1 / 3)) >= 0.45) == (0.7 * 0.5 + 0.3 * (1 / 3) >= 0.45)


def test_ngrams_and_lists(spark):
    assert one(spark, text.ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1, 2)) == ["a", "b", "c", "a b", "b c"]
    assert one(spark, text.split_list(F.lit(" a, ,b "))) == ["a", "b"]
    assert one(spark, text.sentences(F.lit(" One two. Three!  "))) == ["One two", "Three"]


def test_numbers(spark):
    assert one(spark, scalars.parsed_int(F.lit("x"), 500, 0, 10)) == 500
    assert one(spark, scalars.parsed_int(F.lit("50"), 5, 0, 10)) == 10
    assert one(spark, scalars.least_documents(F.lit(149), None, 0.01)) == 2


def test_zero_vectors(spark):
    assert one(spark, vector.cosine([0.0, 0.0], [1.0, 0.0])) is None
    assert one(spark, gate.semantic_score(F.array(F.lit(0.0)), [1.0])) == 0.0
    assert len(one(spark, vector.hashed_vector(F.array(F.lit("a"), F.lit("b")), 8))) == 8


def test_renewal(spark):
    ask = lambda new, n, old, mean: one(spark, centroid.needs_renewal(F.lit(new), F.lit(n), vector.vector(old), vector.vector(mean)))
    assert ask(0, 0, [1.0, 0.0], [1.0, 0.0]) and ask(5, 10, [1.0, 0.0], [1.0, 0.0])
    assert not ask(1, 10, [0.0, 0.0], [1.0, 0.0]) and ask(1, 10, [0.0, 1.0], [1.0, 0.0])


def mmr_by_hand(q, rows, k, fetch, weight):
    unit = lambda v: v / np.linalg.norm(v)
    sim = {i: float(unit(v) @ unit(q)) for i, v in rows.items()}
    open_, chosen = sorted(rows, key=lambda i: (-sim[i], i))[:fetch], []
    while open_ and len(chosen) < k:
        gain = lambda i: weight * sim[i] - (1 - weight) * max(float(unit(rows[i]) @ unit(rows[j])) for j in chosen) if chosen else sim[i]
        best = max(open_, key=gain)
        chosen.append(best)
        open_.remove(best)
    return chosen


def test_batch_search_goes_through_all_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 1024)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in retrieval.top_k_batch(df, asked, 3).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    best = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :3]
    assert got == {(i, k + 1): int(best[i, k]) for i in range(60) for k in range(3)}


@pytest.mark.parametrize("weight", [0.0, 0.6, 1.0])
def test_mmr_against_numpy(spark, weight):
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=8) for i in range(40)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>")
    q = rng.normal(size=8)
    got = retrieval.mmr(df, q.tolist(), config.RetrievalConfig(k=5, fetch_factor=3, lambda_mult=weight)).orderBy("rank")
    assert [r["vec_id"] for r in got.collect()] == mmr_by_hand(q, rows, 5, 15, weight)


def test_splitter():
    assert [len(c) for c in chunking.split_text("a" * 800)] == [345, 345, 222]
    assert chunking.split_text("") == [] and chunking.split_text("  \n ") == []
    t = "\n\n".join(" ".join(f"w{i}{j}" for j in range(40)) for i in range(20))
    pieces = chunking.split_text(t)
    assert max(map(len, pieces)) <= 345 and set(t.split()) == set(" ".join(pieces).split())


@pytest.mark.parametrize("term", ["123", "cid 7", "12mm", "x9", "_a", "a(b)", "jan report"])
def test_rejected_terms(spark, term):
    assert one(spark, keywords.rejection(F.lit(term), F.lit(9), 2)) is not None
    assert one(spark, keywords.rejection(F.lit("pump"), F.lit(9), 2)) is None


def test_merging(spark):
    assert one(spark, chat.merge_concat(F.lit("a"), F.lit(" "))) == "a"
    assert one(spark, chat.merge_concat(F.lit("a"), F.lit("A"))) == "a"
    assert "API Response" in one(spark, chat.merge_concat(F.lit("a"), F.lit("b")))
    assert one(spark, chat.merge_api_first(F.lit("a"), F.lit(""))) == "a"


def test_bfs_cycle_and_depth(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (7, 8), (0, None)], "src long, dst long")
    roots = spark.createDataFrame([(0,)], "node long")
    got = {r["node"]: r["depth"] for r in links.bfs(edges, roots, 5).collect()}
    assert got == {0: 0, 1: 1, 2: 2}
    assert links.bfs(edges, roots, 0).count() == 1


def test_folder_to_chunks_and_manifest(spark, tmp_path):
    body = " ".join(f"Plain words number {chr(97 + i % 26)}{chr(97 + i // 26)} make one more sentence {chr(97 + i % 26)}q here." for i in range(40))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.TXT").write_text(body)
    (tmp_path / "in" / "b.md").write_text("")
    (tmp_path / "in" / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / "in" / "skip.bin").write_text("no")
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "in" / "d.docx", "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "in" / "broken.docx").write_text("not a zip")
    found = files.texts(files.scan(spark, str(tmp_path / "in"))).cache()
    by = {r["path"].rsplit("/", 1)[1]: r["text"] for r in found.collect()}
    assert by["c.csv"].startswith("TABLE:\n| x | y |") and by["d.docx"].startswith("# Top\n\n| h |")
    assert set(by) == {"a.TXT", "c.csv", "d.docx", "broken.docx"} and by["broken.docx"] is None
    rows = ingest.chunk_rows(found)
    assert rows.count() > 2 and rows.where("length(page_content) > 345").count() == 0
    where = str(tmp_path / "manifest")
    none = sinks.read_version(spark, where, "path string, content_hash string")
    assert ingest.changed(found, none).count() == 4
    sinks.write_version(ingest.next_manifest(none, found), where)
    known = sinks.read_version(spark, where, "path string, content_hash string")
    assert ingest.changed(found, known).count() == 0 and sinks.versions(spark, where) == [1]
    sinks.write_version(sinks.without(known, "path", "x"), where)
    assert sinks.versions(spark, where) == [1, 2]


def test_stream_counts_like_a_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streams.each_batch(stream, lambda df, i: sinks.append(streams.rates(df), str(tmp_path / "out")), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(streams.rates(events)).count() == 0


def test_text_properties(spark):
    df = spark.createDataFrame([("a ", [" b", ""], 1), (None, None, 2)], "s string, l array<string>, n int")
    assert sorted(r[0] for r in files.text_properties(df).collect()) == ["a", "b"]


def test_config():
    assert config.from_mapping({"gate": {"threshold": 0.5}}).gate.threshold == 0.5
    with pytest.raises(ValueError):
        config.from_mapping({"nope": 1})
    assert config.deep_merge({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}}
    assert config.changed_sections({"a": 1}, {"a": 2, "b": 1}) == ["a", "b"]


def test_scratch_tables_go_with_their_block(spark):
    from pathlib import Path

    from tessera.session import discard, scratch, settle

    with scratch(spark):
        inner = settle(spark.range(3))
        kept = settle(spark.range(4), outlive=True)
        path = Path(inner._tessera_path.removeprefix("file://"))
        assert inner.count() == 3 and path.exists()
    assert not path.exists() and kept.count() == 4
    discard(kept)
    assert not Path(kept._tessera_path.removeprefix("file://")).exists()


def test_entry_without_an_optional_library():
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 50 and out[1] == "False" and int(out[2]) >= 47


def test_csv_text_with_quotes_and_bad_lines(spark):
    raw = b'a,b\n"x, y",2\n1,2,3\n"say ""hi""",\n'
    got = one(spark, files.csv_text(F.lit(raw)))
    assert got == 'TABLE:\n| a | b |\n| --- | --- |\n| x, y | 2 |\n| say "hi" |  |'


@pytest.mark.parametrize("raw, text", [(b"caf\xc3\xa9", "café"), (b"caf\xe9", "café"), (b"\xff\xfea\x00", "a"), (b"\xef\xbb\xbfa", "a"), (b"", "")])
def test_detected_text(spark, raw, text):
    assert one(spark, files.detected_text(F.lit(raw))) == text


def test_yaml_settings(tmp_path):
    path = str(tmp_path / "settings.yaml")
    assert config.save({"gate": {"threshold": 0.6}}, path) == ["gate"] and config.save({"gate": {"threshold": 0.6}}, path) == []
    assert config.load(path).gate.threshold == 0.6 and config.load(path).retrieval.k == 6
    with pytest.raises(ValueError):
        config.save({"nothing": 1}, path)
    assert config.load(path).gate.threshold == 0.6


def test_chats_and_centroids_are_stored(spark, tmp_path):
    import datetime as dt

    path = str(tmp_path / "chats")
    for i in (1, 2, 3):
        store.save_chat(spark, path, (f"c{i}", "q", "r", dt.datetime(2024, 1, i)))
    with pytest.raises(ValueError):
        store.save_chat(spark, path, ("c1", "q", "r", dt.datetime(2024, 1, 9)))
    store.delete_chat(spark, path, "c2")
    assert [r["id"] for r in store.chats(spark, path).collect()] == ["c3", "c1"]
    vectors = spark.createDataFrame([([1.0, 2.0],)], "centroid array<double>").withColumn("n", F.lit(5))
    where = str(tmp_path / "centroids")
    assert store.load_centroid(spark, where).count() == 0
    store.save_centroid(vectors, where, "all", F.lit("2024-01-01").cast("timestamp"))
    assert store.load_centroid(spark, where).select("centroid", "n").first() == ([1.0, 2.0], 5)


def test_store_wants_a_vector_for_each_object(spark, tmp_path):
    path = str(tmp_path / "objects")
    rows = spark.createDataFrame([("a", [1.0]), ("b", None)], "text string, embedding array<double>")
    with pytest.raises(ValueError):
        store.store(rows, path)
    assert store.store(rows.where("embedding is not null"), path) == 1 and spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        store.create_collection(spark, "no-name", "x int")


def test_cache_is_fresh_newest_and_cleared(spark, tmp_path):
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = [("k", "old", "2024-01-01 12:00:00"), ("k", "new", "2024-01-01 13:00:00"), ("e", "gone", "2023-01-01 00:00:00"), (None, "x", "2024-01-01 12:00:00")]
    cache = spark.createDataFrame(rows, "key string, value string, at string").withColumn("fetched_at", F.col("at").cast("timestamp")).drop("at")
    asked = spark.createDataFrame([("k",), ("e",), (None,)], "key string")
    got = {r["key"]: (r["hit"], r["value"]) for r in store.lookup(asked, cache, "key", "value", F.lit("made"), now, 24).collect()}
    assert got == {"k": (True, "new"), "e": (False, "made"), None: (False, "made")}
    path = str(tmp_path / "cache")
    store.clear(spark, path, "key string, value string")
    from tessera.sources.sinks import read_version

    assert read_version(spark, path, "key string, value string").count() == 0


def test_answers_take_every_way(spark):
    messages = [(1, 0, "user", "??"), (2, 0, "user", "nothing of interest"), (3, 0, "user", "the control system data"), (4, 0, "user", "control data"), (5, 0, "user", "system data")]
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    df = df.withColumns({"local": F.lit("some control answer"), "api": F.when(F.col("conv_id") == 4, "off the point").otherwise("")})
    cfg = config.EngineConfig(gate=config.GateConfig(threshold=0.2))
    first = {r["conv_id"]: r for r in flow.answers(df, ["control", "data", "system"], cfg=cfg).collect()}
    assert {i: r["status"] for i, r in first.items()} == {1: "rejected", 2: "irrelevant", 3: "answered", 4: "invalid", 5: "answered"}
    assert first[2]["prompt"] is None and "control system data" in first[3]["prompt"] and first[3]["response"] == "some control answer" and first[4]["response"] is None
    cache = spark.createDataFrame([(first[5]["cache_key"], "kept control")], "cache_key string, response string").withColumn("fetched_at", F.current_timestamp())
    again = {r["conv_id"]: r for r in flow.answers(df, ["control", "data", "system"], cache, cfg=cfg).collect()}
    assert (again[5]["status"], again[5]["response"]) == ("cached", "kept control") and again[3]["status"] == "answered"


def test_diverse_phrases_against_plain_marginal_relevance(spark):
    rows = [(1, t, s) for t, s in (("aab", 0.9), ("aabb", 0.89), ("xyz", 0.5), ("ab", 0.88), ("q", 0.1))]
    terms = spark.createDataFrame(rows, "doc_id long, term string, score double")
    vec = {t: np.array([t.count(c) for c in "abcdefghijklmnopqrstuvwxyz"], float) for _, t, _ in rows}
    like = lambda a, b: vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b])
    left, want = {t: s for _, t, s in rows}, []
    while left and len(want) < 3:
        best = max(left, key=lambda t: 0.5 * left[t] - 0.5 * max((like(t, u) for u in want), default=0))
        want.append(best)
        left.pop(best)
    got = keywords.diverse(terms, n=3, diversity=0.5).orderBy("rank").collect()
    assert [r["term"] for r in got] == want


def test_toggled_and_parsed(spark):
    assert one(spark, store.toggled(F.array(F.lit("a"), F.lit("b")), F.lit("a"))) == ["b"] and one(spark, store.toggled(F.array(F.lit("a")), F.lit("c"))) == ["a", "c"]
    assert one(spark, store.parsed_line(F.lit("a : b : 1"))) is None and tuple(one(spark, store.parsed_line(F.lit("a : 1.5")))) == ("a", 1.5)
