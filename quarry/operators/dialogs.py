"""Conversations: messages, fenced tool blocks, their validity, and scores per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The allowed values and keys of tool blocks.
TOOLS = ("python.run", "units.convert", "papers.search", "papers.fetch")
RETURN_FORMATS = ("json", "text")
CALL_KEYS, RESULT_KEYS = ("id", "tool", "args", "return_format"), ("id", "ok", "data", "error", "meta")

CALL = "struct<id:string,tool:string,args:string,return_format:string>"
RESULT = "struct<id:string,ok:boolean,data:struct<doi:string,stdout:string,value:double>,error:struct<message:string,code:string>,meta:struct<ms:long>>"


def blocks(text: Column, tag: str) -> Column:
    """The JSON objects between ~~~tag and ~~~."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?si)~~~{tag}\s*(\{{.*?\}})\s*~~~"), 1)


def wrapped(tag: str, payload: Column) -> Column:
    return F.concat(F.lit(f"~~~{tag}\n"), payload, F.lit("\n~~~"))


def _keys_within(block: Column, allowed: tuple[str, ...]) -> Column:
    keys = F.json_object_keys(block)
    return keys.isNotNull() & (F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) == 0)


def valid_call(block: Column) -> Column:
    """Known keys only, an id, a known tool and return format."""
    c = F.from_json(block, CALL)
    return F.try_parse_json(block).isNotNull() & _keys_within(block, CALL_KEYS) & c["id"].isNotNull() & F.coalesce(c["tool"].isin(*TOOLS), F.lit(False)) & F.coalesce(c["return_format"].isin(*RETURN_FORMATS), F.lit(False))


def valid_result(block: Column) -> Column:
    """Known keys only, an id and a state, a latency of 0 or more, and an error if and only if it is not ok."""
    r = F.from_json(block, RESULT)
    consistent = r["ok"] == r["error"]["message"].isNull()
    return F.try_parse_json(block).isNotNull() & _keys_within(block, RESULT_KEYS) & r["id"].isNotNull() & F.coalesce(r["meta"]["ms"] >= 0, F.lit(False)) & F.coalesce(consistent, F.lit(False))


def to_messages(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A row per conversation with its turns as an array of (role, content) in order. A conversation is the unit and fits a row."""
    packed = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "role", F.col("text").alias("content")))).alias("m"))
    return packed.select(conv, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def turn_stats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per conversation: turns, those by users and assistants, characters, and whether roles alternate."""
    lagged = turns.withColumn("_last", F.lag("role").over(Window.partitionBy(conv).orderBy(turn)))
    return lagged.groupBy(conv).agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"), (F.count_if(F.col("role") == F.col("_last")) == 0).alias("alternates"))


def tool_scores(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Per conversation: calls and valid ones, results and good ones, final_valid, citation_valid, latency. A result belongs to an earlier
    valid call of its id. Without citations they are valid; else all cited works must have been fetched."""
    calls = turns.where("role = 'assistant'").select(conv, turn, F.explode(blocks(F.col("text"), "toolcall")).alias("b"))
    calls = calls.select(conv, turn, valid_call(F.col("b")).alias("ok"), F.from_json("b", CALL).alias("c"))
    results = turns.where("role = 'tool'").select(conv, turn, F.explode(blocks(F.col("text"), "toolresult")).alias("b"))
    results = results.where(valid_result(F.col("b"))).select(conv, turn, F.from_json("b", RESULT).alias("r"))
    finals = turns.where("role = 'assistant'").select(conv, F.explode(F.slice(blocks(F.col("text"), "final"), 1, 1)).alias("b")).where(F.try_parse_json("b").isNotNull())
    cited = finals.select(conv, F.from_json("b", "struct<evidence:array<struct<doi:string>>>")["evidence"]["doi"].alias("d")).groupBy(conv).agg(F.array_distinct(F.array_compact(F.flatten(F.collect_list("d")))).alias("cited"))
    made = calls.where("ok").select(conv, F.col(turn).alias("_at"), F.col("c.id").alias("_id"), F.col("c.tool").alias("_tool"))
    linked = results.join(made, (results[conv] == made[conv]) & (results["r"]["id"] == made["_id"]) & (made["_at"] < results[turn]), "left").drop(made[conv])
    fetched = linked.where("_tool = 'papers.fetch' AND r.data.doi IS NOT NULL").groupBy(conv).agg(F.collect_set("r.data.doi").alias("fetched"))
    out = turns.select(conv).distinct()
    out = out.join(calls.groupBy(conv).agg(F.count("*").alias("tool_calls"), F.count_if("ok").alias("valid_calls")), conv, "left")
    out = out.join(results.groupBy(conv).agg(F.count("*").alias("tool_results"), F.count_if("r.ok").alias("good_results"), F.avg("r.meta.ms").alias("mean_ms")), conv, "left")
    out = out.join(cited, conv, "left").join(fetched, conv, "left")
    none = F.array().cast("array<string>")
    citations = F.size(F.array_except(F.coalesce("cited", none), F.coalesce("fetched", none))) == 0
    zero = F.lit(0)
    return out.select(conv, *[F.coalesce(c, zero).cast("long").alias(c) for c in ("tool_calls", "valid_calls", "tool_results", "good_results")], "mean_ms", F.col("cited").isNotNull().alias("final_valid"), citations.alias("citation_valid"))


def tool_summary(scores: DataFrame) -> DataFrame:
    """Rates over all conversations; 0 where there is nothing to divide by."""

    def rate(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))

    return scores.agg(
        F.count("*").alias("conversations"),
        F.coalesce(F.avg(F.col("final_valid").cast("double")), F.lit(0.0)).alias("final_valid_rate"),
        rate("valid_calls", "tool_calls").alias("call_valid_rate"),
        rate("good_results", "tool_results").alias("success_rate"),
        F.coalesce(F.avg(F.col("citation_valid").cast("double")), F.lit(0.0)).alias("citation_valid_rate"),
        F.coalesce(F.avg("tool_calls"), F.lit(0.0)).alias("mean_calls"),
        F.coalesce(F.avg("mean_ms"), F.lit(0.0)).alias("mean_latency_ms"),
    )


def sft_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each assistant turn with the user turn right before it: input, output."""
    w = Window.partitionBy(conv).orderBy(turn)
    out = turns.withColumn("_role", F.lag("role").over(w)).withColumn("input", F.lag("text").over(w))
    return out.where("role = 'assistant' AND _role = 'user'").select(conv, turn, "input", F.col("text").alias("output"))
