"""Conversations: history windows, prompts, cache keys, answer merging, validation and responses.

Messages are rows of conv_id, turn, role and text; the latest turn is the one being answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fixed import TECHNICAL_TERMS
from tessera.functions.scalars import col
from tessera.functions.text import capitalize

ROLES = ("user", "assistant")


def window(messages: DataFrame, max_turns: int = 5, skip: int = 1) -> DataFrame:
    """The 2 * max_turns messages before the latest ``skip`` of each conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("back", back).where(F.col("back").between(skip + 1, 2 * max_turns + 1)).drop("back")


def _in_order(item: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn"), item.alias("x")))), lambda s: s["x"])


def conversations(messages: DataFrame) -> DataFrame:
    return messages.select("conv_id").distinct()


def prompt_history(messages: DataFrame, max_turns: int = 5) -> DataFrame:
    """conv_id and history: `Role:` and text of each message with one, set apart by a blank line."""
    kept = window(messages, max_turns).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    line = F.concat(capitalize(F.coalesce("role", F.lit("unknown"))), F.lit(":\n"), F.trim("text"))
    made = kept.groupBy("conv_id").agg(F.array_join(_in_order(line), "\n\n").alias("history"))
    return conversations(messages).join(made, "conv_id", "left").withColumn("history", F.coalesce("history", F.lit("")))


def valid_messages(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isin(*ROLES) & (F.col("text") != ""))


def api_history(messages: DataFrame, max_turns: int = 5, skip: int = 1) -> DataFrame:
    """conv_id and messages, array<struct<role, content>> of the window's valid messages."""
    kept = valid_messages(window(messages, max_turns, skip))
    made = kept.groupBy("conv_id").agg(_in_order(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return conversations(messages).join(made, "conv_id", "left").withColumn("messages", F.coalesce("messages", none))


def latest(messages: DataFrame) -> DataFrame:
    """conv_id and query, the text of the last message."""
    return messages.groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))


def cache_keys(messages: DataFrame, max_turns: int = 5) -> DataFrame:
    """conv_id and cache_key: md5 of the query and its history; the history leaves out the last two
    messages, as the window is taken twice."""
    old = api_history(messages, max_turns, skip=2)
    key = F.concat_ws("_", F.col("query"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|"))
    return latest(messages).join(old, "conv_id").select("conv_id", F.md5(key).alias("cache_key"))


def last_user_message(messages: DataFrame) -> DataFrame:
    return messages.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def rewritten_query(messages: DataFrame) -> DataFrame:
    """conv_id and query, after the last earlier user message where there is one."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    before = messages.withColumn("back", back).where("back > 1 and role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("previous"))
    joined = latest(messages).join(before, "conv_id", "left")
    both = F.concat(F.lit("Previous: "), F.col("previous"), F.lit("\nCurrent: "), F.col("query"))
    return joined.select("conv_id", F.coalesce(both, F.col("query")).alias("query"))


def prompt(system, history, context, query) -> Column:
    """System text, history, context if any, and the query, set apart by blank lines."""
    given = F.when(F.coalesce(col(context), F.lit("")) != "", F.concat(F.lit("Context:\n"), col(context), F.lit("\n\n"))).otherwise("")
    return F.concat(col(system), F.lit("\n\n"), col(history), F.lit("\n\n"), given, F.lit("User:\n"), col(query))


def payload(system, messages, query, context=None, gated: bool = True, generic: str = "You are a helpful assistant.") -> Column:
    """Messages for a provider: system, history, query. The generic system text stands in where the
    gate is off and there is no context."""
    have = F.coalesce(col(context), F.lit("")) if context is not None else F.lit("")
    text = F.when(F.lit(not gated) & (have == ""), F.lit(generic)).otherwise(F.when(have != "", F.concat(col(system), F.lit("\n\nContext:\n"), have)).otherwise(col(system)))
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.concat(one("system", text), col(messages), one("user", col(query)))


def merge_api_first(local, api) -> Column:
    return F.coalesce(F.nullif(col(api), F.lit("")), col(local))


def merge_concat(local, api) -> Column:
    here = F.trim(F.coalesce(col(local), F.lit("")))
    there = F.trim(F.coalesce(col(api), F.lit("")))
    both = F.concat(F.lit("Local Response:\n"), here, F.lit("\n\nAPI Response:\n"), there)
    return F.when((there == "") | (F.lower(there) == F.lower(here)), here).otherwise(both)


def merge_local_only(local, api) -> Column:
    return col(local)


MERGERS = {"api_first": merge_api_first, "concat": merge_concat, "local_only": merge_local_only}


def has_keyword(text, keywords: list[str]) -> Column:
    """Whether any keyword, in lower case, is part of the text in lower case."""
    known = F.array(*(F.lit(k.lower()) for k in keywords)) if keywords else F.array().cast("array<string>")
    return F.exists(known, lambda k: F.contains(F.lower(F.coalesce(col(text), F.lit(""))), k))


def is_meaningful(text) -> Column:
    """The semantic validator; it accepts everything."""
    return F.lit(True)


def is_technical(text) -> Column:
    out = F.lit(False)
    for pattern in TECHNICAL_TERMS:
        out = out | F.coalesce(col(text).rlike(pattern), F.lit(False))
    return out


def first_failure(text, validators: list[tuple[str, Column]], enabled: bool = True) -> Column:
    """Name of the first validator that fails; null if none does, or if validation is off."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(validators):
        out = F.when(~ok, F.lit(name)).otherwise(out)
    return out if enabled else F.lit(None).cast("string")


def response(text, source, context, model, now, error=False) -> Column:
    return F.struct(
        col(text).alias("response"), col(source).alias("source"), F.coalesce(col(context), F.lit("")).alias("context"),
        (F.lit(model) if isinstance(model, str) else model).alias("model"), now.alias("timestamp"), (F.lit(error) if isinstance(error, bool) else error).alias("error"),
    )


def response_text(value) -> Column:
    """The answer inside a JSON record, one level down if nested, or the text itself."""
    nested = F.get_json_object(col(value), "$.response.response")
    plain = F.get_json_object(col(value), "$.response")
    return F.coalesce(nested, plain, col(value))
