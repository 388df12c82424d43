"""Conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dialogs as D
from .common import Registry, table
from .models import rounded

R = Registry()


@R.add("SELECT conv_id, len(m) AS turns, sha256(array_to_string(m, '~')) AS digest FROM (SELECT conv_id, list(role || ':' || text ORDER BY turn) AS m FROM conversations GROUP BY 1)")
def conv_to_messages(spark, d):
    m = D.to_messages(table(spark, d, "conversations"))
    flat = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "~")
    return m.select("conv_id", F.size("messages").cast("long").alias("turns"), F.sha2(flat, 256).alias("digest"))


@R.add("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, sum(length(coalesce(text, '')))::BIGINT AS chars, count(*) FILTER (role = p) = 0 AS alternates FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY 1")
def conv_turn_stats(spark, d):
    return D.turn_stats(table(spark, d, "conversations"))


@R.add("SELECT conv_id, turn, input, text AS output FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS input FROM conversations) WHERE role = 'assistant' AND p = 'user'")
def conv_sft_pairs(spark, d):
    return D.sft_pairs(table(spark, d, "conversations"))


def _tool_turns(spark, d):
    """Conversations with tool blocks made from their numbers: a call, its result, and a final report."""
    c = F.col("conv_id").cast("string")
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    call = F.concat(F.lit('{"id": "c'), c, F.lit('", "tool": "'), F.when(F.col("conv_id") % 5 == 0, "unknown").otherwise("papers.fetch"), F.lit('", "args": {}, "return_format": "json"}'))
    result = F.concat(F.lit('{"id": "c'), c, F.lit('", "ok": '), F.when(F.col("conv_id") % 4 == 0, 'false, "error": {"message": "no"}').otherwise('true, "data": {"doi": "10.1/x"}'), F.lit(', "meta": {"ms": '), (F.col("conv_id") % 100).cast("string"), F.lit("}}"))
    final = F.concat(F.lit('{"evidence": [{"doi": "'), F.when(F.col("conv_id") % 3 == 0, "10.1/y").otherwise("10.1/x"), F.lit('"}]}'))
    turns = F.array(F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), D.wrapped("toolcall", call).alias("text")), F.struct(F.lit(2).alias("turn"), F.lit("tool").alias("role"), D.wrapped("toolresult", result).alias("text")), F.struct(F.lit(3).alias("turn"), F.lit("assistant").alias("role"), D.wrapped("final", final).alias("text")))
    return ids.select("conv_id", F.inline(turns))


@R.add("""SELECT DISTINCT conv_id, 1::BIGINT AS tool_calls, (conv_id % 5 <> 0)::BIGINT AS valid_calls, 1::BIGINT AS tool_results, (conv_id % 4 <> 0)::BIGINT AS good_results, (conv_id % 100)::DOUBLE AS mean_ms, true AS final_valid,
conv_id % 3 <> 0 AND conv_id % 5 <> 0 AND conv_id % 4 <> 0 AS citation_valid FROM conversations""")
def conv_tool_scores(spark, d):
    return D.tool_scores(_tool_turns(spark, d))


@R.add("""WITH c AS (SELECT DISTINCT conv_id AS i FROM conversations) SELECT count(*) AS conversations, 1.0::DOUBLE AS final_valid_rate, round(avg((i % 5 <> 0)::INT), 6) AS call_valid_rate, round(avg((i % 4 <> 0)::INT), 6) AS success_rate, round(avg((i % 3 <> 0 AND i % 5 <> 0 AND i % 4 <> 0)::INT), 6) AS citation_valid_rate, 1.0::DOUBLE AS mean_calls, round(avg(i % 100), 6) AS mean_latency_ms FROM c""")
def conv_tool_summary(spark, d):
    return rounded(D.tool_summary(D.tool_scores(_tool_turns(spark, d))))
