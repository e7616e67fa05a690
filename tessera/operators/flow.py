"""The whole way of a question: sanitise, gate, cache, prompt, merge, validate, respond."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import col
from tessera.operators import chat, gate, retrieval, store
from tessera.plans.config import EngineConfig
from tessera.session import settle


def answers(messages: DataFrame, keywords: list[str], cache: DataFrame | None = None, local="local", api="api", context=None, vector: str | None = None, centroid=None, cfg: EngineConfig | None = None) -> DataFrame:
    """A row for each conversation: status (`rejected`, `irrelevant`, `cached`, `invalid` or `answered`),
    the cleaned query, cache_key, prompt and response.

    ``messages`` has conv_id, turn, role and text, and on each row the answers ``local`` and ``api`` of the
    two models to the last message; only that row's count. A fresh cache (cache_key, response,
    fetched_at) goes before them. Invalid questions stop before retrieval, irrelevant ones before the models.
    """
    cfg = cfg or EngineConfig()
    last = messages.groupBy("conv_id").agg(F.max_by(F.struct(
        F.col("text").alias("asked"), col(local).alias("local"), col(api).alias("api"),
        (col(context) if context is not None else F.lit("")).alias("context"), *([F.col(vector).alias("vector")] if vector else []),
    ), "turn").alias("m")).select("conv_id", "m.*")
    gated = gate.gate(last, keywords, "vector" if vector else None, centroid, cfg.gate, "asked")
    passes = F.col("relevant") if cfg.chat.gate else F.col("valid")
    row = gated.join(chat.cache_keys(messages, cfg.chat.max_turns), "conv_id", "left").join(chat.prompt_history(messages, cfg.chat.max_turns), "conv_id", "left")
    row = row.withColumn("prompt", F.when(passes, chat.prompt(F.lit(cfg.chat.system_message), F.coalesce("history", F.lit("")), "context", "clean")))
    row = row.withColumn("made", chat.MERGERS[cfg.chat.merge]("local", "api"))
    if cache is not None:
        row = store.lookup(row, cache, "cache_key", "response", "made")
    else:
        row = row.withColumn("hit", F.lit(False)).withColumn("response", F.col("made"))
    failed = chat.first_failure("response", [("keywords", chat.has_keyword("response", keywords)), ("semantic", chat.is_meaningful("response"))], cfg.chat.validate)
    status = (
        F.when(~F.col("valid"), "rejected").when(~passes, "irrelevant").when(F.col("hit"), "cached").when(failed.isNotNull(), "invalid").otherwise("answered")
    )
    out = row.withColumn("status", status)
    given = F.when(F.col("status").isin("cached", "answered"), F.col("response"))
    return out.select("conv_id", "status", F.col("clean").alias("query"), "cache_key", "prompt", given.alias("response"))


#: What stands in for an answer.
SHORT = "Query too short or invalid after sanitization"
OUTSIDE = "Query appears outside industrial automation scope."
UNCLEAR = "Please clarify or ask a specific technical topic."


def first_passage(rows: DataFrame) -> DataFrame:
    """A stand-in for a local model: the answer is the first passage of the context."""
    return rows.withColumn("local", F.substring_index("context", "\n\n", 1))


def no_provider(rows: DataFrame) -> DataFrame:
    return rows.withColumn("api", F.lit(None).cast("string"))


def converse(
    messages: DataFrame, corpus: DataFrame, texts: DataFrame, keywords: list[str], now, vector: str | None = None, embed=None, centroid=None, cache: store.Cache | None = None,
    local=first_passage, api=no_provider, provider: str = "local_llm", cfg: EngineConfig | None = None, id_col: str = "vec_id", searched=None,
) -> DataFrame:
    """The whole way of many questions in one plan: cache, gate, retrieval, prompt, models, merging, checks, record.

    ``messages`` has conv_id, turn, role and text; a conversation's last message is its question. Its vector is
    a column ``vector`` of that row, or ``embed``, a function of the retrieval query's column. ``corpus`` has
    ``id_col`` and embedding, ``texts`` has ``id_col`` and text. ``local`` and ``api`` add the columns of these names, the models' answers, to
    rows with prompt and payload; only questions that get there reach them. ``searched`` replaces the exact
    search: a function of (queries, k) as an index has it.

    Gives conv_id, status (`rejected`, `irrelevant`, `cached`, `invalid` or `answered`), query, retrieval_query,
    context, prompt, payload, cache_key, and response, a record of text, source, context, model, time and error.
    ``remember`` stores what was answered.
    """
    cfg = cfg or EngineConfig()
    last = messages.groupBy("conv_id").agg(F.max_by(F.struct(F.col("text").alias("asked"), *([F.col(vector).alias("vector")] if vector else [])), "turn").alias("m")).select("conv_id", "m.*")
    last = last.join(chat.cache_keys(messages, cfg.chat.max_turns), "conv_id")
    if cache is not None:
        held = cache.get(last, now).select("cache_key", F.col("value").alias("cached"))
        last = last.join(held, "cache_key", "left")
    else:
        last = last.withColumn("cached", F.lit(None).cast("string"))
    asked = gate.sanitized(last, "asked")
    if cfg.chat.retrieve_with_history:
        before = chat.rewritten_query(messages).select("conv_id", F.regexp_extract("query", r"(?s)^(Previous: .*\nCurrent: )", 1).alias("before"))
        asked = asked.join(before, "conv_id", "left").withColumn("retrieval_query", F.concat(F.coalesce("before", F.lit("")), "clean")).drop("before")
    else:
        asked = asked.withColumn("retrieval_query", F.col("clean"))
    if not vector:
        asked = asked.withColumn("vector", embed(F.col("retrieval_query")))
    gated = settle(gate.gate(asked, keywords, "vector", centroid, cfg.gate, "asked"))
    passes = F.col("relevant") if cfg.chat.gate else F.col("valid")
    open_ = gated.where(passes & F.col("cached").isNull())

    queries = open_.select(F.col("conv_id").alias("query_id"), F.col("vector").alias("query"))
    found = searched(queries, cfg.retrieval.k) if searched else retrieval.top_k_batch(corpus.select(id_col, "embedding"), queries, cfg.retrieval.k, id_col)
    passages = found.select("query_id", "rank", id_col).join(texts.select(id_col, "text"), id_col)
    context = retrieval.context(passages, ["query_id"]).withColumnRenamed("query_id", "conv_id")
    rows = open_.join(context, "conv_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    rows = rows.join(chat.prompt_history(messages, cfg.chat.max_turns), "conv_id").join(chat.api_history(messages, cfg.chat.max_turns), "conv_id")
    rows = rows.withColumn("prompt", chat.prompt(F.lit(cfg.chat.system_message), "history", "context", "clean"))
    rows = rows.withColumn("payload", chat.payload(F.lit(cfg.chat.system_message), "messages", "clean", "context", cfg.chat.gate))
    rows = api(local(rows)).withColumn("made", chat.MERGERS[cfg.chat.merge]("local", "api"))
    failed = chat.first_failure("made", [("keywords", chat.has_keyword("made", keywords)), ("semantic", chat.is_meaningful("made"))], cfg.chat.validate)
    source = F.when(F.coalesce("api", F.lit("")) != "", provider).otherwise("local_llm")
    ok = failed.isNull()
    rows = rows.withColumn("status", F.when(ok, "answered").otherwise("invalid"))
    record = chat.response(F.when(ok, F.col("made")).otherwise(UNCLEAR), F.when(ok, source).otherwise("validation_failed"), F.when(ok, F.col("context")), source, now)
    rows = rows.withColumn("response", record)

    shut = gated.where(~(passes & F.col("cached").isNull()))
    status = F.when(F.col("cached").isNotNull(), "cached").when(~F.col("valid"), "rejected").otherwise("irrelevant")
    text = F.when(F.col("status") == "cached", F.col("cached")).when(F.col("status") == "rejected", SHORT).otherwise(OUTSIDE)
    origin = F.when(F.col("status") == "cached", "cache").when(F.col("status") == "rejected", "validation").otherwise("domain_check")
    shut = shut.withColumn("status", status).withColumn("response", chat.response(text, origin, F.lit(""), origin, now, F.col("status") == "rejected"))
    none = {"context": "string", "prompt": "string", "payload": dict(rows.dtypes)["payload"]}
    shut = shut.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    out = ["conv_id", "status", F.col("clean").alias("query"), "retrieval_query", "context", "prompt", "payload", "cache_key", "response"]
    return rows.select(*out).unionByName(shut.select(*out))


def remember(done: DataFrame, cache: store.Cache, now) -> int:
    """Stores the answers of ``converse`` that passed all checks; the cache's version."""
    return cache.put(done.where("status = 'answered'").select("cache_key", F.col("response.response").alias("value")), now)
