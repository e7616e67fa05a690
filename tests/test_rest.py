"""Smaller rows of the inventory, each with its outcome: records, payloads, dates, lists, logs, splitting, states."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars
from tessera.functions.text import markdown_table
from tessera.operators import centroid, chat, chunking, keywords, store
from tessera.sources import files, sinks



def now():
    return F.lit(dt.datetime(2024, 5, 1)).cast("timestamp")



def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scanning_below_a_folder(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "deep" / "er" / "b.TXT").write_text("b")
    names = lambda **k: sorted(r["path"].rsplit("/", 1)[1] for r in files.scan(spark, str(tmp_path), **k).collect())
    assert names() == ["a.txt"] and names(recursive=True) == ["a.txt", "b.TXT"] and names(types=["md"], recursive=True) == []


def test_csv_with_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text('n,x,name\n1,2.5,"a, b"\n2,,c\n3,4.5,d,extra\n')
    rows = files.csv_table(spark, str(tmp_path / "t.csv"))
    assert rows.dtypes == [("n", "int"), ("x", "double"), ("name", "string")]
    assert [tuple(r) for r in rows.collect()] == [(1, 2.5, "a, b"), (2, None, "c")]


def test_keyword_lists_written_and_read(spark, tmp_path):
    terms = spark.createDataFrame([("valve",), ("pump",), ("valve",)], "term string")
    path = str(tmp_path / "k")
    sinks.keyword_file(terms, path)
    part = [n for n in os.listdir(path) if n.startswith("part-")]
    assert len(part) == 1 and open(f"{path}/{part[0]}").read() == "pump, valve\n"
    assert sorted(r["term"] for r in files.keyword_list(spark, path).collect()) == ["pump", "valve"]
    sinks.keyword_file(terms.limit(0), path)
    assert files.keyword_list(spark, path).count() == 0


def test_log_of_experiments(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.log_row(spark, path, "first", json.dumps({"a": 1}), "out, with a comma")
    sinks.log_row(spark, path, "second", "{}", 'say "x"')
    rows = spark.read.csv(path, header=True, escape='"').orderBy("experiment_name").collect()
    assert [(r["experiment_name"], r["parameters"]) for r in rows] == [("first", '{"a": 1}'), ("second", "{}")]
    assert rows[0]["outputs"] == "out, with a comma" and all(r["timestamp"] for r in rows)


@pytest.mark.parametrize(
    "text, iso",
    [("2024-01-02 03:04:05", "2024-01-02T03:04:05Z"), ("2024-01-02T03:04:05+02:00", "2024-01-02T01:04:05Z"), ("2024-01-02", "2024-01-02T00:00:00Z"), ("no date", "2024-05-01T00:00:00Z"), (None, "2024-05-01T00:00:00Z")],
)
def test_dates_as_text(spark, text, iso):
    assert one(spark, scalars.iso_from_text(F.lit(text).cast("string"), now())) == iso


def test_centroid_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert centroid.centroid_or_zero(none, 3).collect()[0]["centroid"] == [0.0] * 3
    some = spark.createDataFrame([(1, [1.0, 3.0]), (2, [3.0, 5.0])], "vec_id long, embedding array<double>")
    assert centroid.centroid_or_zero(some, 2).collect()[0]["centroid"] == [2.0, 4.0]


def test_response_records(spark):
    r = one(spark, chat.response(F.lit("text"), F.lit("api"), F.lit(None).cast("string"), "m", now(), True))
    assert tuple(r) == ("text", "api", "", "m", dt.datetime(2024, 5, 1), True)
    cases = [('{"response": {"response": "deep"}}', "deep"), ('{"response": "flat"}', "flat"), ("plain", "plain"), ('{"other": 1}', '{"other": 1}'), ("", "")]
    for given, text in cases:
        assert one(spark, chat.response_text(F.lit(given))) == text


def test_payload_for_a_provider(spark):
    none = F.array().cast("array<struct<role:string,content:string>>")
    said = F.array(F.struct(F.lit("user").alias("role"), F.lit("before").alias("content")))
    get = lambda *a, **k: [(m["role"], m["content"]) for m in one(spark, chat.payload(*a, **k))]
    assert get(F.lit("sys"), said, F.lit("q"), F.lit("ctx")) == [("system", "sys\n\nContext:\nctx"), ("user", "before"), ("user", "q")]
    assert get(F.lit("sys"), none, F.lit("q"), F.lit("")) == [("system", "sys"), ("user", "q")]
    assert get(F.lit("sys"), none, F.lit("q"), F.lit(""), gated=False) == [("system", "You are a helpful assistant."), ("user", "q")]
    assert get(F.lit("sys"), none, F.lit("q"), F.lit("ctx"), gated=False)[0] == ("system", "sys\n\nContext:\nctx")


@pytest.mark.parametrize("text, ok", [("a SCADA screen", True), ("opc  ua", True), ("recovery rate", True), ("plain", False), ("", False), (None, False), ("scadas", False)])
def test_technical_answers(spark, text, ok):
    assert one(spark, chat.is_technical(F.lit(text).cast("string"))) is ok


def test_merging_local_only(spark):
    assert one(spark, chat.merge_local_only(F.lit("l"), F.lit("a"))) == "l"


SPLITS = [
    ("one two three four", 10, 4, ["one two", "two three", "four"]),
    ("one two three four", 9, 4, ["one two", "three", "four"]),
    ("aaa\n\nbbb\n\nccc", 8, 0, ["aaa\n\nbbb", "ccc"]),
    ("abcdefghij", 4, 1, ["abcd", "defg", "ghij"]),
    ("short", 10, 2, ["short"]),
    ("a\nb\nc\nd", 3, 0, ["a\nb", "c", "d"]),
]


@pytest.mark.parametrize("text, size, overlap, want", SPLITS)
def test_splitter_on_fixed_texts(text, size, overlap, want):
    assert chunking.split_text(text, size, overlap) == want


@pytest.mark.parametrize("size, overlap", [(345, 56), (40, 10), (7, 3)])
def test_splitter_keeps_every_word(size, overlap):
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(40)) + f"\nline{i}" for i in range(12)) + " " + "".join(f"{i:03x}" for i in range(170))
    made = chunking.split_text(text, size, overlap)
    assert all(0 < len(c) <= size for c in made)
    at = 0
    for c in made:  # each chunk lies in the text, none begins before the one ahead of it, nothing is skipped but blanks
        found = text.find(c, max(0, at - size))
        assert found >= 0 and not text[at:found].strip()
        at = max(at, found + len(c))
    assert not text[at:].strip()


def test_states_that_cannot_be_read_go_aside(spark, tmp_path):
    path, schema = str(tmp_path / "state.json"), "path string, content_hash string"
    assert files.state_or_aside(spark, path, schema).count() == 0
    good = [{"path": "a", "content_hash": "1"}]
    open(path, "w").write(json.dumps(good))
    assert [tuple(r) for r in files.state_or_aside(spark, path, schema).collect()] == [("a", "1")]
    for body in ('{"path": ', "not json at all"):
        open(path, "w").write(body)
        assert files.state_or_aside(spark, path, schema).count() == 0
        assert not os.path.exists(path) and open(f"{path}.corrupt").read() == body


def test_collections_are_made_once(spark, tmp_path):
    name = f"c_{os.getpid()}"
    try:
        store.create_collection(spark, name, "id long, text string")
        spark.sql(f"INSERT INTO {name} VALUES (1, 'kept')")
        store.create_collection(spark, name, "other long")
        assert [tuple(r) for r in spark.table(name).collect()] == [(1, "kept")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for bad in ("", "a b", "a;drop", "é", None):
        with pytest.raises(ValueError):
            store.create_collection(spark, bad, "id long")


def test_metadata_of_files(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    rows = spark.createDataFrame([("f/a.pdf", at, dt.datetime(2023, 1, 1), "3", ["low"]), ("b.txt", None, None, "x", None)], "path string, modified timestamp, created timestamp, page string, content_flags array<string>")
    a, b = store.metadata(rows, now()).collect()
    assert (a["source"], a["created"], a["modified"], a["page"], a["content_flags"], a["error_messages"]) == ("a.pdf", "2023-01-01T00:00:00Z", "2024-01-02T03:04:05Z", 3, ["low"], [])
    assert (b["source"], b["modified"], b["page"], b["content_flags"], b["error_messages"]) == ("b.txt", "2024-05-01T00:00:00Z", 0, [], ["no time of modification"])
    bare = store.metadata(rows.select("path", "modified"), now()).first()
    assert bare["created"] == bare["modified"] == "2024-01-02T03:04:05Z" and bare["page"] == 0


def test_a_table_of_one_row(spark):
    assert one(spark, markdown_table(F.array(F.array(F.lit("a"), F.lit("b"))))) == "TABLE:\na|b"


def test_words_are_taken_once(spark):
    docs = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "! ?")], "doc_id long, text string")
    made = keywords.candidates(docs)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("array_sort") == 1  # a filter on the words would be worked out below them once more
    assert keywords.candidates(docs.withColumn("text", F.lit("bb aa bb"))).where("term = 'bb'").first()["score"] == pytest.approx(2 / 3)
    assert keywords.tfidf(docs).count() == 2


def test_tfidf_in_blocks_as_sql(spark, monkeypatch):
    import duckdb

    from tessera.plans.queries import SQL

    texts = ["İstanbul ΟΔΟΣ οδος", "a_b 12 ½ x² a_b", "", None, "... !", "été e\u0301te 日本語 日本語", "ΑΣ! ας ΑΣ", "common common one", "common", " common, Straße STRASSE ", "\tcommon\n\n12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = sorted(con.execute(SQL["tfidf_vectors"]).fetchall())
    monkeypatch.setattr(keywords, "BLOCK_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        made = keywords.tfidf(docs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["doc_id"], r["term"], round(r["weight"], 6)) for r in made.collect()) == want
    assert "hashpartitioning(doc_id" not in made._jdf.queryExecution().executedPlan().toString()  # rows of a document don't move
    left = keywords.tfidf(docs, stop_words=["common"])
    assert {r["term"]: round(r["weight"], 6) for r in left.where("doc_id in (7, 8)").collect()} == {"one": 1.0}
    assert keywords.tfidf(docs.where("doc_id in (2, 3, 4)")).count() == 0 and keywords.tfidf(docs.where("doc_id < 0")).count() == 0
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("block"), F.col("text").alias("term"))
    assert keywords.tfidf(named.where("block = 'd8'"), "block", "term").where("block = 'd8'").count() == 1


def test_key_phrases_are_cut_before_they_move(spark):
    from tessera.functions.vector import letter_vector

    texts = ["pump valve pump", "ab ba abab ab", "the the the", "насос 12 34", "a b", "", None, "Straße straße STRASSE", " ".join(f"w{i % 7}x" for i in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ours = keywords.key_phrases(docs, n=4, stop_words=["the"])
    assert "array_distinct" not in ours._jdf.queryExecution().executedPlan().toString()  # phrases are not rows
    other = keywords.key_phrases(docs, lambda t: letter_vector(t), n=4, stop_words=["the"])
    rows = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert rows(ours) == rows(other) and ours.where("doc_id = 3").count() == 4
    plan = other._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning") < plan.index("MapInPandas")  # cut below the exchange
    assert {tuple(r) for r in keywords.diverse(ours, n=1).select("doc_id", "rank", "term").collect()} == {(r["doc_id"], 1, r["term"]) for r in ours.where("rank = 1").collect()}


def test_cached_pages_of_one_address(spark, tmp_path):
    from oracle import same, sql_rows

    from tessera.plans.queries import QUERIES, SQL, TABLES

    pages = [(1, "u", "old"), (49, "u", "last but one"), (95, "u", None), (73, "u", "last"), (50, "u", None), (4, "v", None), (5, None, "no address"), (8, None, None), (30, "w", "stale")]
    for name in TABLES:
        df = spark.createDataFrame(pages, "page_id long, url string, html string") if name == "pages" else spark.range(1)
        df.coalesce(1).write.parquet(str(tmp_path / "d" / name))
        part = next((tmp_path / "d" / name).glob("*.parquet"))
        part.rename(tmp_path / f"{name}.parquet")
    same(QUERIES["cache_lookup"](spark, str(tmp_path)).toPandas(), sql_rows(SQL["cache_lookup"], str(tmp_path)))


def test_clusters_of_terms(spark):
    terms = ["pump valve", "pump pressure", "valve pressure", "bread oven", "oven heat", "bread heat"]
    df = spark.createDataFrame([(t,) for t in terms] + [("",), ("...",)], "term string")
    got = {r["term"]: r["cluster"] for r in keywords.clusters(df, k=2).collect()}
    assert sorted(got) == sorted(terms) and set(got.values()) == {0, 1}
    assert {r["cluster"] for r in keywords.clusters(df.limit(1), k=3).collect()} == {0}
    # k-means is done: every term is nearest to its own cluster's mean
    assert keywords.clusters(df.where("term = ''")).count() == 0


def test_percentages_and_least_documents(spark):
    assert [one(spark, scalars.as_fraction(F.lit(x))) for x in (0.4, 1.0, 45.0)] == [0.4, 1.0, 0.45]
    assert one(spark, scalars.least_documents(F.lit(101), fraction=0.05)) == 6 and one(spark, scalars.least_documents(F.lit(101), absolute=3, fraction=0.5)) == 3
    assert one(spark, scalars.age_seconds(F.lit("2024-04-30 23:59:00").cast("timestamp"), now())) == 60
    assert one(spark, scalars.iso_utc(now())) == "2024-05-01T00:00:00Z"


def test_batch_sizes(spark):
    def batch(rows, **k):
        return store.batch_size(spark.createDataFrame(rows, "filetype string, length long"), **k).collect()[0]["batch"]

    small, large = 1000, 11 << 20
    assert batch([(".txt", small)] * 4) == 16 and batch([(".txt", small)] * 4, memory_gb=1) == 6 and batch([(".txt", small)], memory_gb=3) == 8
    assert batch([(".txt", large)]) == 4 and batch([(".PDF", small)] * 3 + [(".txt", small)]) == 4 and batch([(".pdf", large)], memory_gb=1) == 2
    assert batch([(".pdf", small), (".txt", small)]) == 8 and batch([("txt", 2 << 20)], memory_gb=3) == 4
    assert batch([]) == 10


def test_earlier_names_of_settings():
    from tessera.plans import config

    cfg = config.from_mapping({"keywords": {"extraction_diversity": 0.5, "diversity": 0.1, "min_doc_freq": 3}, "centroid": {"centroid_diversity": 0.2}, "chat": {"provider": "DeepSeek"}})
    assert (cfg.keywords.diversity, cfg.keywords.least_documents, cfg.centroid.diversity, cfg.chat.provider) == (0.5, 3, 0.2, "deepseek")
    share = config.from_mapping({"keywords": {"min_doc_freq": 1, "min_doc_freq_mode": "fraction", "extraction_diversity": None, "diversity": 0.4}})
    assert (share.keywords.least_fraction, share.keywords.least_documents, share.keywords.diversity) == (1.0, None, 0.4)
    with pytest.raises(ValueError, match="min_doc_freq_mode"):
        config.from_mapping({"keywords": {"min_doc_freq_mode": "some"}})
    with pytest.raises(ValueError, match="unknown settings"):
        config.from_mapping({"chat": {"extraction_diversity": 1}})
    assert config.with_keys(cfg, {}).chat.provider == "none" and config.with_keys(cfg, {"DEEPSEEK_API_KEY": "x"}) == cfg
    assert config.with_keys(cfg, {"DEEPSEEK_API_KEY": ""}).chat.provider == "none" and config.with_keys(config.EngineConfig(), {}).chat.provider == "none"


def test_schema_of_collections(spark):
    from tessera.operators import catalog

    tables = {"a": spark.createDataFrame([], "id long, v array<double>"), "b": spark.createDataFrame([], "t timestamp")}
    assert sorted(tuple(r) for r in catalog.schema_listing(spark, tables).collect()) == [("a", "id", "bigint"), ("a", "v", "array<double>"), ("b", "t", "timestamp")]


def test_properties_are_coerced(spark):
    rows = spark.createDataFrame([("t", None, "7", 1), (None, "s", "x", 2)], "text string, source string, page string, n int")
    got = [tuple(r) for r in store.properties(rows, ["n"]).orderBy("n").collect()]
    assert got == [("t", "unknown", "unknown", 7, 1), ("", "s", "unknown", 0, 2)]
