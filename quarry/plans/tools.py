"""Tool dialogues over parts, orders and conversations, whose numbers stand for values, outputs and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import operations as O
from ..operators import tools as X
from .common import Registry, table
from .models import rounded

R = Registry()


@R.add(r"SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN false ELSE NOT (p_partkey % 5 = 0) END AS sane FROM part")
def tool_number_bounds(spark, d):
    k = F.col("p_partkey")
    out = F.concat(F.lit("x = "), k.cast("string"), F.lit(", y=-.5 and +3.25e "), F.when(k % 5 == 0, "-2000.5").otherwise("-999"))
    return table(spark, d, "part").select("p_partkey", X.sane_numbers(F.when(k % 7 > 0, out)).alias("sane"))


_UNITS = ("cm", "kg", "min", "mmol", "m", "furlong")
_CONVERTED = "CASE p_partkey % 6 WHEN 0 THEN p_size * 0.01 / 1000.0 WHEN 1 THEN NULL WHEN 2 THEN p_size * 60.0 / 3600.0 WHEN 3 THEN p_size * 0.001 WHEN 4 THEN p_size * 1.0 / 1000.0 END"


@R.add(f"SELECT p_partkey, round({_CONVERTED}, 9) AS converted, coalesce(abs(v - o) <= greatest(1e-3 * greatest(abs(v), abs(o)), 1e-3), false) AS agrees FROM (SELECT *, {_CONVERTED} AS v, {_CONVERTED} * CASE WHEN p_partkey % 4 = 0 THEN 1.5 ELSE 1.0005 END AS o FROM part)")
def tool_unit_conversions(spark, d):
    k = F.col("p_partkey")
    source = F.element_at(F.array(*map(F.lit, _UNITS)), (k % 6 + 1).cast("int"))
    target = F.element_at(F.array(*map(F.lit, ("km", "m", "hour", "mol", "km", "m"))), (k % 6 + 1).cast("int"))
    v = X.converted(F.col("p_size").cast("double"), source, target)
    return rounded(table(spark, d, "part").select("p_partkey", v.alias("converted"), X.close(v, v * F.when(k % 4 == 0, 1.5).otherwise(1.0005)).alias("agrees")), 9)


@R.add("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE p_size + 0.5 END AS value, CASE WHEN p_partkey % 3 = 0 THEN 'mol' ELSE 'kg m' END AS from_unit, CASE WHEN p_partkey % 3 = 0 THEN 'mmol' ELSE 'g cm' END AS to_unit FROM part")
def tool_conversion_requests(spark, d):
    p = F.when(F.col("p_partkey") % 3 == 0, "no request").otherwise(F.concat(F.lit("Please Convert "), F.col("p_size").cast("string"), F.lit(".5 kg m to g cm")))
    return table(spark, d, "part").select("p_partkey", X.conversion_request(p).alias("r")).select("p_partkey", "r.*")


@R.add("""SELECT p_partkey, 2015 + i AS year, '10.1234/' || substr(sha256('part ' || p_partkey), (i * 8 + 1)::INT, 8) AS doi, 'Study on Part ' || p_partkey || ' (' || (i + 1) || ')' AS title, (20 + ('0x' || substr(sha256('part ' || p_partkey), 1, 4))::BIGINT % 120)::INT AS latency,
'~~~final' || chr(10) || '{' || chr(10) || '  "id": ' || p_partkey || ',' || chr(10) || '  "ok": true' || chr(10) || '}' || chr(10) || '~~~' AS block FROM part, range(3) r(i)""")
def tool_synthetic_works(spark, d):
    p = F.concat(F.lit("part "), F.col("p_partkey").cast("string"))
    block = X.pretty_block("final", {"id": F.col("p_partkey").cast("string"), "ok": F.lit("true")})
    works = table(spark, d, "part").select("p_partkey", X.synthetic_latency(F.sha2(p, 256)).alias("latency"), block.alias("block"), F.inline(X.synthetic_works(p, 3)))
    return works.select("p_partkey", F.col("year").cast("long").alias("year"), "doi", "title", "latency", "block")


@R.add("SELECT o_orderkey, o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 AS truncated FROM orders")
def answer_truncation(spark, d):
    k = F.col("o_orderkey")
    raw = F.concat(F.lit('{"choices": [{"finish_reason": "'), F.when(k % 3 == 0, "length").otherwise("stop"), F.lit('"}]}'))
    return table(spark, d, "orders").select("o_orderkey", X.truncated(F.when(k % 4 == 0, True), F.when(k % 3 < 2, raw)).alias("truncated"))


@R.add("SELECT conv_id, turn, sha256('<|user|>' || chr(10) || coalesce(p, '') || chr(10) || '<|assistant|>' || chr(10) || coalesce(text, '')) AS chat, regexp_split_to_array(coalesce(text, ''), ' ')[1:8] AS first_words FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE role = 'assistant'")
def chat_rendering(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations").withColumn("p", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    return c.select("conv_id", "turn", F.sha2(X.chat_text(F.col("p"), F.col("text")), 256).alias("chat"), X.cut(F.split(F.coalesce("text", F.lit("")), " "), 8).alias("first_words"))


@R.add("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Title ' || p_partkey END AS title, CASE WHEN p_partkey % 4 = 0 THEN []::VARCHAR[] ELSE ['Ada L', 'Solo'] END AS authors, CASE WHEN p_partkey % 5 > 0 THEN (2000 + p_size)::INT END AS year, '10.1/' || p_partkey AS doi FROM part")
def scholarly_items(spark, d):
    k = F.col("p_partkey")
    title = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit('"title": ["Title '), k.cast("string"), F.lit('", "other"], ')))
    authors = F.when(k % 4 == 0, "").otherwise('"author": [{"given": " Ada", "family": "L "}, {"family": "Solo"}, {"given": " "}], ')
    date = F.when(k % 5 == 0, "null").otherwise(F.concat(F.lit('null, "x", '), (2000 + F.col("p_size")).cast("string")))
    item = F.concat(F.lit("{"), title, authors, F.lit('"issued": {"date-parts": [['), date, F.lit(']]}, "DOI": "10.1/'), k.cast("string"), F.lit('"}'))
    return table(spark, d, "part").select("p_partkey", X.scholarly_item(item).alias("w")).select("p_partkey", "w.title", "w.authors", "w.year", "w.doi")


@R.add("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '{"id": "c", "args": {"n": ' || p_size || '}}' WHEN 1 THEN '{"id": "c", "ok": true, "none": null}' END AS call FROM part""")
def tool_call_repairs(spark, d):
    k = F.col("p_partkey")
    call = F.when(k % 4 == 0, F.concat(F.lit("{'id': 'c', 'args': {'n': "), F.col("p_size").cast("string"), F.lit("}}"))).when(k % 4 == 1, "{'id': 'c', 'ok': True, 'none': None}").otherwise("{'id': import os")
    return table(spark, d, "part").select("p_partkey", X.repaired(call).alias("call"))


@R.add("""WITH w AS (SELECT l_orderkey AS k, '10.1/' || l_partkey AS doi, bool_or(l_linenumber % 2 = 1) AS fetched FROM lineitem GROUP BY ALL),
c AS (SELECT k, list(doi ORDER BY doi) AS cited, coalesce(list(doi ORDER BY doi) FILTER (NOT fetched), []) AS unfetched FROM w GROUP BY k)
SELECT k AS l_orderkey, cited, unfetched, CASE WHEN len(unfetched) > 0 THEN ['small', 'Controller inserted limitation: verify citation(s) [' || array_to_string(list_transform(unfetched, lambda x: chr(39) || x || chr(39)), ', ') || '] with papers.fetch.'] ELSE ['small'] END AS limitations FROM c""")
def completed_reports(spark, d):
    """A report per order that cites a work for each of its parts; the parts of odd lines were fetched."""
    line = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("10.1/"), F.col("l_partkey").cast("string")).alias("doi"), (F.col("l_linenumber") % 2 == 1).alias("odd"))
    by = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct("doi"))).alias("evidence"), F.collect_set(F.when(F.col("odd"), F.col("doi"))).alias("fetched"))
    report = F.to_json(F.struct("evidence", F.array(F.lit("small")).alias("limitations")))
    return by.select("l_orderkey", X.completed_report(report, F.col("fetched")).alias("r")).select("l_orderkey", "r.*")


@R.add("""SELECT p_partkey, ['units', 'literature', 'simulation', 'hybrid'][p_partkey % 4 + 1] AS category, ['malformed_json', 'missing_fetch', 'python_error'][p_partkey % 3 + 1] AS repair, 1::BIGINT AS tool_calls, 1::BIGINT AS valid_calls, true AS final_valid, true AS cites,
(20 + ('0x' || substr(sha256('convert ' || p_size || ' m to cm'), 1, 4))::BIGINT % 120)::DOUBLE AS mean_ms FROM part""")
def tool_episodes(spark, d):
    """Episodes scored by the operator that scores dialogues: their calls are valid, and cited works are fetched by the call's tool."""
    from ..operators import dialogs as D

    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("convert "), F.col("p_size").cast("string"), F.lit(" m to cm")).alias("prompt"), F.element_at(F.array(*map(F.lit, X.CATEGORIES)), (k % 4 + 1).cast("int")).alias("category"))
    e = X.episodes(p, "p_partkey", "prompt", "category")
    turns = e.select("p_partkey", F.posexplode("messages").alias("turn", "m")).select("p_partkey", "turn", "m.role", F.col("m.content").alias("text"))
    scores = D.tool_scores(turns, "p_partkey")
    return e.join(scores, "p_partkey").select("p_partkey", "category", "repair", "tool_calls", "valid_calls", "final_valid", (F.col("citation_valid") | (F.col("category") == "literature")).alias("cites"), "mean_ms")


@R.add("SELECT o_orderkey, CASE WHEN load > 100 THEN least(20, floor(r * load / 100.0::DOUBLE))::INT WHEN load < 70 AND o_orderkey % 2 = 0 THEN greatest(1, r - 1)::INT ELSE r::INT END AS replicas FROM (SELECT o_orderkey, o_custkey % 12 + 1 AS r, o_orderkey % 250 AS load FROM orders)")
def autoscale_decisions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 12 + 1).alias("r"), (F.col("o_orderkey") % 250).alias("load"))
    return o.select("o_orderkey", O.desired_replicas(F.col("r"), F.col("load"), 100.0, 1, 20, may_shrink=F.col("o_orderkey") % 2 == 0).alias("replicas"))


@R.add("SELECT o_orderkey, CASE WHEN m < 0.5 AND g < 80 THEN 'increase_batch_size' WHEN m > 0.95 THEN 'decrease_batch_size' END AS batch_action, CASE WHEN m < 0.5 AND g < 80 THEN 2 * b WHEN m > 0.95 THEN greatest(1, b // 2) END AS batch_size, CASE WHEN g < 30 THEN 'downgrade_gpu' WHEN c > 90 AND g < 60 THEN 'upgrade_cpu' END AS instance_action FROM (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS m, o_custkey % 100 AS g, o_orderkey % 97 AS c, o_orderkey % 9 AS b FROM orders)")
def resource_advice(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k, (k % 100 / 100.0).alias("m"), (F.col("o_custkey") % 100).alias("g"), (k % 97).alias("c"), (k % 9).alias("b"))
    batch = O.batch_advice(F.col("g"), F.col("m"), F.lit(1.0), F.col("b"))
    return o.select("o_orderkey", batch["action"].alias("batch_action"), batch["batch_size"].alias("batch_size"), O.instance_advice(F.col("g"), F.col("c")).alias("instance_action"))


@R.add("SELECT o_orderkey, (o_orderkey % 3 = 0 OR o_orderkey % 50 <= 30) AND o_totalprice <= 200000 AS within_budget, o_orderkey % 7 > 4 AS reclaim FROM orders")
def policy_checks(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", O.within_budget({"hours": (F.when(k % 3 > 0, k % 50), 30), "cost": (F.col("o_totalprice"), 200000), "gpu_hours": (k, None)}).alias("within_budget"), O.reclaims(k % 7, 4).alias("reclaim"))


@R.add("SELECT event_id FROM events WHERE event_type = 'click' AND user_id = 3 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'")
def usage_in_range(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'")
    return O.of_user(e, "user_id", 3, "ts", "2024-01-03", "2024-01-20").select("event_id")


@R.add("SELECT s_suppkey AS worker FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey % 8 >= 4 AND s_nationkey < 20")
def matching_workers(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("worker"), F.when(F.col("s_nationkey") % 2 == 0, "idle").otherwise("busy").alias("status"), (F.col("s_suppkey") % 8).alias("gpu_count"), F.lit("a100").alias("gpu_type"), (F.col("s_nationkey") < 20).alias("alive"))
    return O.matching_workers(s, 4, "a100").select("worker")


@R.add("SELECT count(*) AS runs, round(sum(o_totalprice), 2) AS total FROM orders")
def cost_totals(spark, d):
    return rounded(O.cost_totals(table(spark, d, "orders"), "o_totalprice"), 2)


@R.add("SELECT o_orderpriority, count(*) AS n, round(avg(f), 6) AS judge_f_mean, round(avg(r), 6) AS judge_r_mean, round(avg((f >= 80 AND r >= 80)::INT), 6) AS pass_rate FROM (SELECT o_orderpriority, o_orderkey % 60 + 50 AS f, o_custkey % 70 + 40 AS r FROM orders) GROUP BY 1")
def batch_judgments(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderkey") % 60 + 50).alias("f"), (F.col("o_custkey") % 70 + 40).alias("r"))
    return rounded(O.batch_judgments(o, "o_orderpriority", "f", "r", 80))
