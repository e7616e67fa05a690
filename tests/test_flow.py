"""Questions taken all the way: retrieval, models, checks, records and the cache."""

import datetime as dt
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.functions.vector import hashed_vector
from tessera.operators import flow, models, store
from tessera.operators.models import Calls
from tessera.operators.vector_index import VectorIndex
from tessera.plans.config import ChatConfig, EngineConfig, GateConfig, RetrievalConfig

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests
KEYWORDS = ["pump", "valve", "control"]
PASSAGES = {1: "A pump moves water.", 2: "A valve shuts the pipe.", 3: "  ", 4: "Bread is baked.", 5: "Control of a pump needs a valve."}


def now():
    return F.lit(dt.datetime(2024, 5, 1, 12)).cast("timestamp")



def _embed(text):
    return hashed_vector(F.split(F.lower(text), r"\W+"), 32)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame(list(PASSAGES.items()), "vec_id long, text string")
    return rows.withColumn("embedding", _embed(F.col("text"))).select("vec_id", "embedding"), rows


@pytest.fixture(scope="module")
def messages(spark):
    rows = [
        (1, 0, "user", "Tell me of the pump"), (1, 1, "assistant", "It moves."), (1, 2, "user", "And the valve control?"),
        (2, 0, "user", "??"), (3, 0, "user", "bread and butter"), (4, 0, "user", "pump <b>pump</b>"), (5, 0, "user", None), (6, 0, "user", "pump refuse"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


class Local:
    def generate(self, prompts):
        if any("refuse" in p for p in prompts):
            raise RuntimeError("no")
        return ["About control: " + p.rsplit("\n", 1)[1] for p in prompts]


def _local(rows):
    return models.generate(rows, Local, calls=Calls(4, 2, 0.0)).withColumnsRenamed({"answer": "local", "answer_error": "local_error"})


CFG = EngineConfig(gate=GateConfig(threshold=0.15), retrieval=RetrievalConfig(k=2))


def _by(done):
    return {r["conv_id"]: r for r in done.collect()}


def test_every_way_with_retrieval(corpus, messages):
    got = _by(flow.converse(messages, *corpus, KEYWORDS, now(), embed=_embed, local=_local, cfg=CFG))
    assert {k: r["status"] for k, r in got.items()} == {1: "answered", 2: "rejected", 3: "irrelevant", 4: "answered", 5: "rejected", 6: "invalid"}
    one = got[1]
    assert one["query"] == one["retrieval_query"] == "And the valve control?"
    assert one["context"] == f"{PASSAGES[2]}\n\n{PASSAGES[5]}" or one["context"] == f"{PASSAGES[5]}\n\n{PASSAGES[2]}"
    system = CFG.chat.system_message
    assert one["prompt"] == f"{system}\n\nUser:\nTell me of the pump\n\nAssistant:\nIt moves.\n\nContext:\n{one['context']}\n\nUser:\nAnd the valve control?"
    assert [(m["role"], m["content"]) for m in one["payload"]] == [("system", f"{system}\n\nContext:\n{one['context']}"), ("user", "Tell me of the pump"), ("assistant", "It moves."), ("user", "And the valve control?")]
    r = one["response"]
    assert (r["response"], r["source"], r["context"], r["error"]) == ("About control: And the valve control?", "local_llm", one["context"], False) and r["timestamp"] == dt.datetime(2024, 5, 1, 12)
    assert got[4]["query"] == "pump pump" and got[2]["prompt"] is None and got[3]["context"] is None
    assert [(got[k]["response"]["response"], got[k]["response"]["source"], got[k]["response"]["error"]) for k in (2, 3, 6)] == [
        (flow.SHORT, "validation", True), (flow.OUTSIDE, "domain_check", False), (flow.UNCLEAR, "validation_failed", False)]
    assert got[6]["response"]["context"] == ""


def test_history_in_retrieval_a_provider_and_an_index(spark, corpus, messages, tmp_path):
    vectors, texts = corpus
    index = VectorIndex.build(vectors, str(tmp_path / "i"), lists=2)
    cfg = EngineConfig(gate=GateConfig(threshold=0.15), retrieval=RetrievalConfig(k=2), chat=ChatConfig(retrieve_with_history=True, merge="concat"))
    provider = lambda rows: rows.withColumn("api", F.concat(F.lit("valve: "), "clean"))
    searched = lambda queries, k: index.search(queries, k, probes=2)
    got = _by(flow.converse(messages, vectors, texts, KEYWORDS, now(), embed=_embed, local=_local, api=provider, provider="deep", cfg=cfg, searched=searched))
    assert got[1]["retrieval_query"] == "Previous: Tell me of the pump\nCurrent: And the valve control?" and got[4]["retrieval_query"] == "pump pump"
    assert got[1]["response"]["response"] == "Local Response:\nAbout control: And the valve control?\n\nAPI Response:\nvalve: And the valve control?"
    assert got[1]["response"]["source"] == "deep" and got[6]["status"] == "answered"


def test_answers_are_remembered_and_found(spark, corpus, messages, tmp_path):
    cache = store.Cache(spark, str(tmp_path / "c"), hours=1)
    calls = {"embed": _embed, "cache": cache, "local": _local, "cfg": CFG}
    first = flow.converse(messages, *corpus, KEYWORDS, now(), **calls)
    before = _by(first)
    flow.remember(first, cache, now())
    assert cache.table.read().count() == 2  # what was answered, not what was turned away
    again = _by(flow.converse(messages, *corpus, KEYWORDS, now(), **calls))
    assert {k: r["status"] for k, r in again.items()} == {1: "cached", 2: "rejected", 3: "irrelevant", 4: "cached", 5: "rejected", 6: "invalid"}
    assert again[1]["response"]["response"] == before[1]["response"]["response"] and again[1]["response"]["source"] == "cache"
    assert again[1]["cache_key"] == before[1]["cache_key"]
    later = F.lit(dt.datetime(2024, 5, 1, 14)).cast("timestamp")
    assert _by(flow.converse(messages, *corpus, KEYWORDS, later, **calls))[1]["status"] == "answered"


def test_flow_without_gate_or_rows(spark, corpus, messages):
    cfg = EngineConfig(chat=ChatConfig(gate=False, validate=False), retrieval=RetrievalConfig(k=2))
    got = _by(flow.converse(messages, *corpus, KEYWORDS, now(), embed=_embed, cfg=cfg))
    assert got[3]["status"] == "answered" and got[2]["status"] == "rejected"
    assert flow.converse(messages.limit(0), *corpus, KEYWORDS, now(), embed=_embed).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<double>"), spark.createDataFrame([], "vec_id long, text string")
    assert _by(flow.converse(messages, *none, KEYWORDS, now(), embed=_embed, cfg=cfg))[3]["context"] == ""
