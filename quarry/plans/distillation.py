"""Judging and distillation. Documents stand for prompts and outputs, labels for annotations; payloads are made from ids, well-formed and not."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import distillation as Q
from ..operators import evaluation as E
from .common import Registry, table
from .documents import _SQUEEZE
from .models import _SCORES, METRICS, _scores, rounded

R = Registry()
_AUDITS = (
    '```json\n{"clarity": 4, "correctness": "3", "educational_value": 5, "reasoning": "fine"}\n```',
    '{"clarity": 2, "correctness": 3, "educational_value": 4.9, "reasoning": "plain", "more": []}',
    "{oops",
    '{"clarity": 4, "correctness": 3, "reasoning": "no value"}',
    '```{"clarity": true, "correctness": 1, "educational_value": 1, "reasoning": null}```',
    '{"clarity": "x", "correctness": 1, "educational_value": 1, "reasoning": "no number"}',
    '{"clarity": "3.5", "correctness": 1, "educational_value": 1, "reasoning": "quoted fraction"}',
    "[1, 2]",
)
_JUDGED = (
    '{"correctness": 4, "methodology": 3, "specificity": 2, "clarity": 5, "hallucination_safety": 1, "comments": "ok"}',
    '{"correctness": "4", "methodology": 3.2, "specificity": 2, "clarity": 5, "hallucination_safety": 1, "comments": "mixed"}',
    '{"correctness": 4, "methodology": 3, "specificity": 2, "clarity": 5, "comments": "a key is missing"}',
    '```json\n{"correctness": 4}\n```',
    '{"correctness": null, "methodology": 3, "specificity": 2, "clarity": 5, "hallucination_safety": 1, "comments": "null"}',
)


def _pick(values: tuple[str, ...], key: str = "doc_id"):
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_pick(values: tuple[str, ...], key: str = "doc_id") -> str:
    return f"{_sql_list(values)}[{key} % {len(values)} + 1]"


def _sql_int(raw: str) -> str:
    return rf"""CASE WHEN {raw} = 'true' THEN 1 WHEN {raw} = 'false' THEN 0 WHEN regexp_full_match({raw}, '-?\d+(\.\d+)?([eE][-+]?\d+)?') THEN CAST(trunc(CAST({raw} AS DOUBLE)) AS INT) WHEN regexp_full_match({raw}, '"\s*[-+]?\d+\s*"') THEN CAST(trim(trim({raw}, '"')) AS INT) END"""


def _judgment_sql(body: str, scores: tuple[str, ...], text: str, source: str) -> str:
    raws = ", ".join(f"CASE WHEN json_valid(b) THEN CAST(b::JSON -> '$.{s}' AS VARCHAR) END AS r_{s}" for s in scores)
    ints = ", ".join(f"{_sql_int('r_' + s)} AS i_{s}" for s in scores)
    ok = " AND ".join([f"i_{s} IS NOT NULL" for s in scores] + ["said IS NOT NULL"])
    out = ", ".join(f"CASE WHEN {ok} THEN i_{s} END AS {s}" for s in scores)
    said = f"CASE WHEN json_valid(b) AND json_type(b::JSON) = 'OBJECT' AND list_contains(json_keys(b::JSON), '{text}') THEN coalesce(b::JSON ->> '$.{text}', 'None') END AS said"
    return f"WITH p AS (SELECT doc_id, {body} AS b FROM {source}), r AS (SELECT doc_id, {raws}, {said} FROM p), i AS (SELECT doc_id, said, {ints} FROM r), j AS (SELECT doc_id, {ok} AS parsed, {out}, CASE WHEN {ok} THEN said END AS {text} FROM i) "


_UNFENCED = "regexp_replace(regexp_replace(trim(p, ' ' || chr(9) || chr(10) || chr(13)), '^(```json)?(```)?', ''), '```$', '')"
_AUDIT_SQL = _judgment_sql(_UNFENCED, Q.AUDIT_SCORES, Q.AUDIT_TEXT, f"(SELECT doc_id, {_sql_pick(_AUDITS)} AS p FROM documents)")
_JUDGE_SQL = _judgment_sql("p", Q.JUDGE_SCORES, Q.JUDGE_TEXT, f"(SELECT doc_id, {_sql_pick(_JUDGED)} AS p FROM documents)")


def _audits(spark, d):
    j = Q.judgment(_pick(_AUDITS), Q.AUDIT_SCORES, Q.AUDIT_TEXT, fenced=True)
    return table(spark, d, "documents").select("doc_id", j.alias("j")).select("doc_id", F.col("j").isNotNull().alias("parsed"), "j.*")


@R.add(_AUDIT_SQL + "SELECT * FROM j")
def judge_audit_parse(spark, d):
    return _audits(spark, d)


@R.add(_JUDGE_SQL + "SELECT * FROM j")
def judge_response_parse(spark, d):
    j = Q.judgment(_pick(_JUDGED))
    return table(spark, d, "documents").select("doc_id", j.alias("j")).select("doc_id", F.col("j").isNotNull().alias("parsed"), "j.*")


@R.add(_AUDIT_SQL + "SELECT round(avg(clarity), 9) AS clarity_mean, round(avg(correctness), 9) AS correctness_mean, round(avg(educational_value), 9) AS educational_value_mean, count(*) AS sample_count FROM j WHERE parsed")
def judge_audit_means(spark, d):
    return rounded(Q.audit_means(_audits(spark, d).where("parsed")), 9)


@R.add(_SCORES + "SELECT count(*) FILTER (quantity >= 4.5) AS high, count(*) FILTER (quantity >= 3.5 AND quantity < 4.5) AS middle, count(*) FILTER (quantity < 3.5) AS low FROM s")
def score_bands(spark, d):
    return Q.score_bands(_scores(spark, d, prompts=False), "quantity")


@R.add("SELECT doc_id, sha256('Domain: ' || coalesce(source, 'unknown') || chr(10) || 'Task Type: ' || CASE WHEN doc_id % 4 > 0 THEN lang ELSE 'unknown' END || chr(10) || chr(10) || 'Original Prompt:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'Model Answer:' || chr(10) || CASE WHEN doc_id % 5 > 0 THEN 'yes' ELSE '' END || chr(10)) AS judge_prompt, sha256(CASE WHEN doc_id % 3 > 0 AND text <> '' THEN 'Context: ' || text || chr(10) || chr(10) || 'Question: Why?' ELSE 'Why?' END) AS generation_prompt FROM documents")
def judge_and_generation_prompts(spark, d):
    k = F.col("doc_id")
    judge = Q.judge_prompt(F.col("source"), F.when(k % 4 > 0, F.col("lang")), F.col("text"), F.when(k % 5 > 0, "yes"))
    made = Q.generation_prompt(F.lit("Why?"), F.when(k % 3 > 0, F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.sha2(judge, 256).alias("judge_prompt"), F.sha2(made, 256).alias("generation_prompt"))


_TEMPLATES = {"hypothesis": "State a hypothesis on {context} now", "methodology": "Plan: {context}"}
_TASKS = ("hypothesis", "Methodology", "other")


@R.add(f"WITH s AS (SELECT doc_id, coalesce(text, '') AS raw, {_SQUEEZE} AS t, {_sql_pick(_TASKS)} AS task FROM documents) SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 AND raw <> '' THEN t WHEN task = 'hypothesis' THEN 'State a hypothesis on ' || t || ' now' WHEN task = 'Methodology' THEN 'Plan: ' || t END) AS prompt FROM s")
def resolved_prompts(spark, d):
    t = table(spark, d, "documents")
    p = Q.resolved_prompt(F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.col("text"), _pick(_TASKS), _TEMPLATES)
    return t.select("doc_id", F.sha2(p, 256).alias("prompt"))


@R.add(rf"""WITH w AS (SELECT doc_id, source, doc_id % 2 = 0 AS hyp, left(array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\x0B\f]+'), lambda x: x <> '')[1:5], ' '), 50) AS topic, i FROM documents, range(3) r(i)),
a AS (SELECT *, {_sql_list(Q.ASPECTS)}[('0x' || substr(md5(concat_ws('|', '5', doc_id, i)), 1, 8))::BIGINT % 8 + 1] AS aspect FROM w)
SELECT doc_id, i AS n, CASE WHEN hyp THEN 'Analyze ' || aspect || ' of ' || topic || ' in ' || source || ' systems' ELSE 'Design a reproducible experimental methodology to investigate ' || topic || ' in ' || source END AS prompt FROM a""")
def prompt_variations(spark, d):
    t = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    v = Q.prompt_variations(F.col("text"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, "hypothesis").otherwise("methodology"), F.col("doc_id"), 3, 5)
    return t.select("doc_id", F.posexplode(v).alias("n", "prompt")).select("doc_id", F.col("n").cast("long").alias("n"), "prompt")


_OUTPUT = "CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' WHEN doc_id % 10 = 2 THEN '**reasoning** ' || text WHEN doc_id % 10 = 3 THEN 'Distilled Response ' || text ELSE text END"


def _outputs(spark, d):
    k = F.col("doc_id")
    out = table(spark, d, "documents").withColumn("teacher_output", F.expr(_OUTPUT)).withColumns({"latency_ms": (k % 700).cast("double"), "prompt_tokens": k % 90, "completion_tokens": k % 200})
    return out.withColumns({"total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"), "domain": F.col("source"), "template_name": F.col("lang"), "user_prompt": F.when(k % 6 > 0, F.col("text"))})


_OUTPUTS = f"WITH o AS (SELECT *, {_OUTPUT} AS teacher_output, (doc_id % 700)::DOUBLE AS latency_ms, doc_id % 90 AS prompt_tokens, doc_id % 200 AS completion_tokens, doc_id % 90 + doc_id % 200 AS total_tokens, CASE WHEN doc_id % 6 > 0 THEN text END AS user_prompt FROM documents) "


@R.add(_OUTPUTS + r"""SELECT round(avg(length(teacher_output)), 6) AS avg_output_length, min(length(teacher_output)) AS min_output_length, max(length(teacher_output)) AS max_output_length, round(count(*) FILTER (length(teacher_output) > 0) / count(*), 6) AS completion_rate, count(teacher_output) AS valid_outputs,
round(avg(len(regexp_extract_all(coalesce(teacher_output, 'None'), '[^ \t\n\r\x0B\f]+'))), 6) AS avg_word_count, round(avg(contains(lower(coalesce(teacher_output, '')), 'reasoning')::INT), 6) AS has_reasoning_section, round(avg(contains(lower(coalesce(teacher_output, '')), 'distilled response')::INT), 6) AS has_distilled_section,
round(avg(latency_ms), 6) AS avg_latency_ms, min(latency_ms) AS min_latency_ms, max(latency_ms) AS max_latency_ms, CAST(sum(total_tokens) AS BIGINT) AS total_tokens_used, round(avg(total_tokens), 6) AS avg_tokens_per_request, round(sum(total_tokens) / 1000000 * 2.0::DOUBLE, 6) AS total_cost_estimate, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens FROM o""")
def distillation_output_metrics(spark, d):
    return rounded(Q.output_metrics(_outputs(spark, d)))


@R.add(_OUTPUTS + "SELECT count(*) AS total_inputs, round(avg(length(coalesce(user_prompt, 'None'))), 6) AS avg_prompt_length, min(length(coalesce(user_prompt, 'None'))) AS min_prompt_length, max(length(coalesce(user_prompt, 'None'))) AS max_prompt_length, round(count(*) FILTER (length(coalesce(user_prompt, 'None')) > 0) / count(*), 6) AS valid_prompt_rate, count(DISTINCT source) AS num_domains, count(DISTINCT lang) AS num_templates FROM o")
def distillation_input_metrics(spark, d):
    return rounded(Q.input_metrics(_outputs(spark, d)))


@R.add(_OUTPUTS + "SELECT source, lang, count(*) AS n, count(*) < 12 AS insufficient FROM o WHERE teacher_output <> '' GROUP BY ALL")
def thin_groups(spark, d):
    return Q.thin_groups(_outputs(spark, d), ("source", "lang"), "teacher_output", 12)


def _sides(spark, d):
    t = table(spark, d, "documents").withColumn("digest", F.sha2("text", 256)).withColumn("lang", F.when(F.col("doc_id") % 20 > 0, F.col("lang")))
    return t.select("source", "lang", "digest").distinct(), t.where("doc_id % 3 > 0").select("source", "lang", "digest", F.col("doc_id").alias("output_id"))


_SIDES = "WITH t AS (SELECT doc_id, source, CASE WHEN doc_id % 20 > 0 THEN lang END AS lang, sha256(text) AS digest FROM documents), i AS (SELECT DISTINCT source, lang, digest FROM t), o AS (SELECT source, lang, digest, doc_id AS output_id FROM t WHERE doc_id % 3 > 0), m AS (SELECT i.*, output_id FROM i LEFT JOIN o ON i.source IS NOT DISTINCT FROM o.source AND i.lang IS NOT DISTINCT FROM o.lang AND i.digest IS NOT DISTINCT FROM o.digest) "
_KEYS = ("source", "lang", "digest")


@R.add(_SIDES + "SELECT * FROM m")
def inputs_with_all_outputs(spark, d):
    return Q.matched(*_sides(spark, d), _KEYS)


@R.add(_SIDES + "SELECT count(output_id) AS matched, count(*) AS total, round(100.0::DOUBLE * count(output_id) / count(*), 6) AS match_rate FROM m")
def output_match_rate(spark, d):
    return rounded(Q.match_rate(Q.matched(*_sides(spark, d), _KEYS), "output_id"))


@R.add(_SIDES + "SELECT source, lang, digest, min(output_id) AS output_id FROM m GROUP BY ALL")
def inputs_with_first_output(spark, d):
    return Q.matched(*_sides(spark, d), _KEYS, ("output_id",))


@R.add(_SCORES + ", b AS (SELECT model_id, avg(overall_score) AS overall_score FROM s GROUP BY 1), t AS (SELECT model_id, count(*) FILTER (quantity > 4.5) AS truncated, count(*) AS total FROM s WHERE model_id % 3 > 0 GROUP BY 1) SELECT model_id, round(overall_score, 6) AS overall_score, truncated, total, round_even(100.0::DOUBLE * truncated / total, 1) AS truncation_rate, CASE WHEN truncated > 0 THEN 'truncated' ELSE 'complete' END AS truncation_status FROM b LEFT JOIN t USING (model_id)")
def leaderboard_with_truncation(spark, d):
    s = _scores(spark, d, prompts=False)
    return rounded(E.with_truncation(E.leaderboard(s, METRICS).select("model_id", "overall_score"), E.truncation(s.where("model_id % 3 > 0"), F.col("quantity") > 4.5)))


_ACTIONS = ("accept", "reject", "regenerate", "skip")


@R.add(f"SELECT d.doc_id, d.source, a.action AS annotation_action FROM documents d JOIN (SELECT doc_id, {_sql_pick(_ACTIONS)} AS action FROM labels) a USING (doc_id) WHERE a.action IN ('reject', 'regenerate')")
def rows_to_regenerate(spark, d):
    notes = table(spark, d, "labels").select("doc_id", _pick(_ACTIONS).alias("action"), F.lit(1).alias("at"))
    return Q.to_regenerate(table(spark, d, "documents").select("doc_id", "source"), notes, "doc_id")


@R.add("SELECT doc_id, quality FROM labels WHERE quality IN (1, 3)")
def label_allow_list(spark, d):
    return Q.searched(table(spark, d, "labels"), {"quality": (1, 3)}).select("doc_id", "quality")


@R.add("SELECT doc_id, source, lang FROM documents WHERE lang IN ('en', 'de') AND source = 'src3' AND contains(lower(text), 'the')")
def inspection_filters(spark, d):
    return Q.searched(table(spark, d, "documents"), {"lang": ("en", "de"), "doc_id": ()}, {"source": "src3"}, {"text": "THE"}).select("doc_id", "source", "lang")


@R.add(_SCORES + ", m AS (SELECT 'eval_loss' AS metric, avg(quantity) AS value FROM s UNION ALL SELECT 'discount', avg(discount) FROM s UNION ALL SELECT 'quantity', avg(quantity) FROM s) SELECT metric, round(value, 6) AS value FROM m WHERE metric LIKE '%loss' OR value < 0.8")
def metric_weaknesses(spark, d):
    one = _scores(spark, d, prompts=False).agg(F.avg("quantity").alias("eval_loss"), F.avg("discount").alias("discount"), F.avg("quantity").alias("quantity"), F.lit(1).alias("one"))
    return rounded(Q.weaknesses(E.long_form(one, ["one"], ["eval_loss", "discount", "quantity"]).withColumnRenamed("score", "value")).select("metric", "value"))


@R.add("SELECT o.o_orderkey AS id, 'm' || (o_custkey % 7) AS model_id, o_orderpriority AS domain, o_orderstatus AS task_type, o_clerk_prompt AS prompt, 'be exact' AS system_prompt, 'answer ' || o_orderkey AS output, o_orderkey % 50 AS tokens_in, o_orderkey % 90 AS tokens_out, (o_orderkey % 1000)::DOUBLE AS latency_ms FROM (SELECT *, 'order ' || o_orderkey AS o_clerk_prompt FROM orders) o WHERE o_orderkey % 4 > 0")
def generation_records(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    prompts = o.select(k.alias("id"), F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("task_type"), F.concat(F.lit("order "), k.cast("string")).alias("prompt"))
    results = o.where("o_orderkey % 4 > 0").select(k.alias("id"), F.concat(F.lit("m"), (F.col("o_custkey") % 7).cast("string")).alias("model_id"), F.concat(F.lit("answer "), k.cast("string")).alias("output"), (k % 50).alias("tokens_in"), (k % 90).alias("tokens_out"), (k % 1000).cast("double").alias("latency_ms"))
    return Q.generation_records(prompts, results, "be exact")


@R.add("SELECT doc_id, source, l.quality::VARCHAR AS teacher_output, 't' AS model_id, (doc_id % 9)::DOUBLE AS latency_ms, CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 ELSE 0 END AS prompt_tokens, doc_id % 7 AS completion_tokens, doc_id % 11 AS total_tokens FROM documents JOIN labels l USING (doc_id)")
def teacher_rows(spark, d):
    k = F.col("doc_id")
    results = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("output_text"), F.lit("t").alias("model_id"), (k % 9).cast("double").alias("latency_ms"), F.when(k % 3 > 0, k % 5).alias("prompt_tokens"), (k % 7).alias("completion_tokens"), (k % 11).alias("total_tokens"))
    return Q.with_results(table(spark, d, "documents").select("doc_id", "source"), results, "doc_id")


_KINDS = ("Hypothesis", "explain", "short_answer", "unheard of")


@R.add(f"SELECT doc_id, source AS domain, {_sql_pick(_KINDS)} AS task_type, sha256(text) AS prompt, lang AS source_file, NULL::VARCHAR AS system_prompt, [3, 2, 1, 2][doc_id % 4 + 1]::INT AS difficulty FROM documents")
def prepared_prompts(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("generated_at"), F.col("source").alias("domain"), _pick(_KINDS).alias("template_name"), F.sha2("text", 256).alias("user_prompt"), F.col("lang").alias("source_file"))
    p = Q.prepared_prompts(t)
    return p.select(F.col("seed_metadata.generated_at").cast("long").alias("doc_id"), "domain", "task_type", "prompt", "seed_metadata.source_file", "seed_metadata.system_prompt", Q.difficulty(F.col("task_type")).alias("difficulty"))


@R.add(f"WITH s AS (SELECT *, {_SQUEEZE} AS t FROM documents) SELECT doc_id AS source_index, sha256(CASE WHEN doc_id % 2 = 0 AND t <> '' THEN t WHEN t <> '' THEN '[TASK: ' || upper(lang) || ']' || chr(10) || t ELSE '' END) AS input, sha256(CASE WHEN doc_id % 3 > 0 THEN t ELSE '' END) AS output, lang AS task_type, doc_id % 5 = 0 AS regenerated FROM s")
def sft_records(spark, d):
    k = F.col("doc_id")
    t = table(spark, d, "documents").select("doc_id", F.when(k % 2 == 0, F.col("text")).alias("prompt"), F.col("text").alias("context"), F.col("lang").alias("task_type"), F.when(k % 3 > 0, F.col("text")).alias("teacher_output"), (k % 5 == 0).alias("regenerated"))
    return Q.sft_records(t, k).select("meta.source_index", F.sha2("input", 256).alias("input"), F.sha2("output", 256).alias("output"), "meta.task_type", "meta.regenerated")


@R.add("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS positives, count(*) - count(*) FILTER (quality = 1) AS negatives FROM labels")
def feedback_totals(spark, d):
    return Q.feedback_totals(table(spark, d, "labels"), F.col("quality") == 1)


@R.add("""WITH q(tool, split, n) AS (VALUES ('en', 'a', 32), ('en', 'b', 8), ('fr', 'a', 8), ('fr', 'b', 2), ('es', 'a', 1), ('es', 'b', 1)),
p AS (SELECT lang AS tool, CASE WHEN doc_id % 4 > 0 THEN 'a' ELSE 'b' END AS split, sha256(coalesce(text, '')) AS prompt, md5(concat_ws('|', 'sel', doc_id)) AS score FROM documents),
r AS (SELECT p.*, n, row_number() OVER (PARTITION BY tool, split ORDER BY score, prompt) AS k FROM p JOIN q USING (tool, split))
SELECT tool, split, prompt, score FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY score) AS u FROM r WHERE k <= n) WHERE u = 1""")
def selected_prompts(spark, d):
    t = table(spark, d, "documents").select(F.col("lang").alias("tool"), F.when(F.col("doc_id") % 4 > 0, "a").otherwise("b").alias("split"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("prompt"), F.md5(F.concat_ws("|", F.lit("sel"), F.col("doc_id").cast("string"))).alias("s"))
    return Q.selected_prompts(t, 50, {"en": 0.8, "fr": 0.2, "es": 0.02, "de": 0.0}, {"a": 0.8, "b": 0.2}, "tool", "split", "prompt", F.col("s")).drop("s")


_REFUSALS = ("as an ai", "i cannot help", "thand", "ereing")


@R.add("SELECT doc_id, " + " OR ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in _REFUSALS) + " AS refused FROM documents")
def refusals(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.refused(F.col("text"), _REFUSALS).alias("refused"))
