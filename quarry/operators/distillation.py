"""Judgments parsed from model answers, prompts and training records built from rows, and metrics of a distillation run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import dedup

# Keys of the judges' answers, actions that ask for another answer, the difficulty of task types, prompt patterns and templates.
AUDIT_SCORES, AUDIT_TEXT = ("clarity", "correctness", "educational_value"), "reasoning"
JUDGE_SCORES, JUDGE_TEXT = ("correctness", "methodology", "specificity", "clarity", "hallucination_safety"), "comments"
TARGET_ACTIONS = ("reject", "regenerate")
DIFFICULTY = {"hypothesis": 3, "methodology": 3, "explain": 2, "compare": 2, "analyze": 2, "short_answer": 1}
ASPECTS = (
    "the evolutionary significance", "the mechanistic basis", "the functional implications", "the regulatory mechanisms",
    "the structural properties", "the kinetic behavior", "the thermodynamic properties", "the molecular interactions",
)
HYPOTHESIS_PROMPT = "Analyze {aspect} of {topic} in {domain} systems"
METHODOLOGY_PROMPT = "Design a reproducible experimental methodology to investigate {topic} in {domain}"
COST_PER_MILLION = 2.0


def unfenced(text: Column) -> Column:
    """The text without white space around it and without the marks of a code block."""
    return F.regexp_replace(F.regexp_replace(F.btrim(text, F.lit(" \t\n\r\f\x0b")), r"^(?:```json)?(?:```)?", ""), r"```\z", "")


def whole_number(raw: Column) -> Column:
    """A JSON value as an integer: numbers lose their fraction, quoted whole numbers count, truth values are 1 and 0; else null."""
    number = F.when(raw.rlike(r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"), raw.try_cast("double").cast("long"))
    quoted = F.when(raw.rlike(r'^"\s*[-+]?\d+\s*"$'), F.btrim(F.btrim(raw, F.lit('"'))).try_cast("long"))
    return F.when(raw == "true", 1).when(raw == "false", 0).otherwise(F.coalesce(number, quoted))


def judgment(payload: Column, scores: tuple[str, ...] = JUDGE_SCORES, text: str = JUDGE_TEXT, fenced: bool = False) -> Column:
    """A struct of integer scores and a text from a judge's JSON answer; null where the answer is no object, lacks a key, or has a score that
    is no number."""
    body = unfenced(payload) if fenced else payload
    parsed = F.try_parse_json(body)
    keys = F.json_object_keys(body)
    raw = {s: F.to_json(F.try_variant_get(parsed, f"$.{s}", "variant")) for s in scores}
    ok = parsed.isNotNull() & keys.isNotNull() & (F.size(F.array_except(F.array(*map(F.lit, (*scores, text))), keys)) == 0)
    for r in raw.values():
        ok = ok & whole_number(r).isNotNull()
    said = F.coalesce(F.try_variant_get(parsed, f"$.{text}", "string"), F.lit("None"))
    return F.when(ok, F.struct(*[whole_number(r).cast("int").alias(s) for s, r in raw.items()], said.alias(text)))


def audit_means(rows: DataFrame, scores: tuple[str, ...] = AUDIT_SCORES) -> DataFrame:
    return rows.agg(*[F.avg(s).alias(f"{s}_mean") for s in scores], F.count("*").alias("sample_count"))


def score_bands(rows: DataFrame, score: str, high: float = 4.5, mid: float = 3.5) -> DataFrame:
    """Rows at or above high, between, and below mid; nulls are in none."""
    s = F.col(score)
    return rows.agg(F.count_if(s >= high).alias("high"), F.count_if((s >= mid) & (s < high)).alias("middle"), F.count_if(s < mid).alias("low"))


# The labels of the judge's and the generation prompt.
JUDGE_LABELS = ("Domain: ", "\nTask Type: ", "\n\nOriginal Prompt:\n", "\n\nModel Answer:\n")
CONTEXT_LABEL, QUESTION_LABEL = "Context: ", "\n\nQuestion: "


def judge_prompt(domain: Column, task: Column, prompt: Column, answer: Column) -> Column:
    unknown, none = F.lit("unknown"), F.lit("")
    values = (F.coalesce(domain, unknown), F.coalesce(task, unknown), F.coalesce(prompt, none), F.coalesce(answer, none))
    return F.concat(*[x for label, v in zip(JUDGE_LABELS, values) for x in (F.lit(label), v)], F.lit("\n"))


def generation_prompt(prompt: Column, context: Column) -> Column:
    p = F.coalesce(prompt, F.lit(""))
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(F.lit(CONTEXT_LABEL), context, F.lit(QUESTION_LABEL), p)).otherwise(p)


def resolved_prompt(prompt: Column, context: Column, task: Column, templates: dict[str, str]) -> Column:
    """The row's own prompt, else the task's template with the context in it; null where the task (hypothesis if none) has no template."""
    own = F.coalesce(prompt, F.lit(""))
    name, ctx, out = F.lower(F.coalesce(task, F.lit("hypothesis"))), T.squeezed(F.coalesce(context, F.lit(""))), None
    for key, template in templates.items():
        filled = F.replace(F.lit(template), F.lit("{context}"), ctx)
        out = F.when(name == key, filled) if out is None else out.when(name == key, filled)
    return F.when(own != "", T.squeezed(own)).otherwise(out)


def prompt_variations(context: Column, domain: Column, task: Column, key: Column, n: int = 1, seed: int = 0) -> Column:
    """n prompts on the context's first words; the aspect of each is drawn by a hash of seed, key and number, so that it stays the same."""
    words = F.filter(F.split(context, r"[ \t\n\r\f\x0b]+"), lambda w: w != "")
    topic = F.substring(F.array_join(F.slice(words, 1, 5), " "), 1, 50)

    def one(i: Column) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long")
        aspect = F.element_at(F.array(*map(F.lit, ASPECTS)), (draw % len(ASPECTS) + 1).cast("int"))
        text = F.when(task == "hypothesis", F.replace(F.lit(HYPOTHESIS_PROMPT), F.lit("{aspect}"), aspect)).otherwise(F.lit(METHODOLOGY_PROMPT))
        return F.replace(F.replace(text, F.lit("{topic}"), topic), F.lit("{domain}"), domain)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one)


def difficulty(task: Column, default: int = 2) -> Column:
    table = F.create_map(*[F.lit(x) for kv in DIFFICULTY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(task)), F.lit(default))


def prepared_prompts(df: DataFrame) -> DataFrame:
    """domain, task_type, prompt and seed_metadata of generated inputs; a field that the table lacks is null."""
    if "user_prompt" not in df.columns:
        raise ValueError("the table has no column user_prompt")
    fields = {"template_prompt": "template_prompt", "system_prompt": "system_prompt", "source_file": "source_file", "source_path": "__source_path", "generated_at": "generated_at"}
    seed = F.struct(*[(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(n) for n, c in fields.items()])
    return df.select(F.col("domain").cast("string"), F.col("template_name").cast("string").alias("task_type"), F.col("user_prompt").cast("string").alias("prompt"), seed.alias("seed_metadata"))


def with_results(df: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """df with its teacher's results by row id: output, model, latency and token counts, 0 where a result has no count."""
    tokens = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return df.join(results.select(key, F.col("output_text").alias("teacher_output"), "model_id", "latency_ms", *tokens), key)


def generation_records(prompts: DataFrame, results: DataFrame, system_prompt: str) -> DataFrame:
    """Prompts joined with results by id, in the columns of the output table; raw_response only where there is one."""
    out = prompts.join(results, "id").withColumn("system_prompt", F.lit(system_prompt))
    columns = ["id", "model_id", "domain", "task_type", "prompt", "system_prompt", "output", "tokens_in", "tokens_out", "latency_ms"]
    return out.select(*columns, *[c for c in ("raw_response",) if c in out.columns])


def sft_records(df: DataFrame, index: Column, prompt: str = "prompt", context: str = "context", task: str = "task_type", output: str = "teacher_output") -> DataFrame:
    """input, output and meta (task_type, model_id, regenerated, source_index) of rows. Without a prompt the input is the context under its
    task's name."""

    def named(c: str) -> Column:
        return F.col(c) if c in df.columns else F.lit(None).cast("string")

    own, ctx = (T.squeezed(F.coalesce(named(c), F.lit(""))) for c in (prompt, context))
    tagged = F.when(ctx != "", F.concat(F.lit("[TASK: "), F.upper(F.coalesce(named(task), F.lit(""))), F.lit("]\n"), ctx)).otherwise(ctx)
    regenerated = F.coalesce(F.col("regenerated"), F.lit(False)) if "regenerated" in df.columns else F.lit(False)
    meta = F.struct(named(task).alias("task_type"), named("model_id").alias("model_id"), regenerated.alias("regenerated"), index.alias("source_index"))
    return df.select(F.when(own != "", own).otherwise(tagged).alias("input"), T.squeezed(F.coalesce(named(output), F.lit(""))).alias("output"), meta.alias("meta"))


def output_metrics(df: DataFrame) -> DataFrame:
    """One row of metrics of teacher outputs. A null output counts in every rate's base and as one word, but is not valid."""
    out = F.col("teacher_output")
    valid = out.isNotNull() & ~out.isin("None", "nan")
    n, length = F.count("*"), F.when(valid, F.length(out))
    seen = F.coalesce(out, F.lit("None"))

    def rate(hit: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(hit), n), F.lit(0.0))

    zero = F.lit(0)
    return df.agg(
        F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_output_length"), F.min(length).alias("min_output_length"), F.max(length).alias("max_output_length"),
        rate(length > 0).alias("completion_rate"), F.count_if(valid).alias("valid_outputs"), F.avg(T.word_count(seen)).alias("avg_word_count"),
        rate(F.lower(seen).contains("reasoning")).alias("has_reasoning_section"), rate(F.lower(seen).contains("distilled response")).alias("has_distilled_section"),
        F.avg("latency_ms").alias("avg_latency_ms"), F.min("latency_ms").alias("min_latency_ms"), F.max("latency_ms").alias("max_latency_ms"),
        F.coalesce(F.sum("total_tokens"), zero).alias("total_tokens_used"), F.avg("total_tokens").alias("avg_tokens_per_request"), (F.coalesce(F.sum("total_tokens"), zero) / 1_000_000 * COST_PER_MILLION).alias("total_cost_estimate"),
        F.coalesce(F.sum("prompt_tokens"), zero).alias("total_prompt_tokens"), F.coalesce(F.sum("completion_tokens"), zero).alias("total_completion_tokens"),
    )


def input_metrics(df: DataFrame) -> DataFrame:
    """One row of metrics of inputs; a null prompt counts with the four characters of its name."""
    length = F.length(F.coalesce("user_prompt", F.lit("None")))
    return df.agg(
        F.count("*").alias("total_inputs"), F.avg(length).alias("avg_prompt_length"), F.min(length).alias("min_prompt_length"), F.max(length).alias("max_prompt_length"),
        F.coalesce(F.try_divide(F.count_if(length > 0), F.count("*")), F.lit(0.0)).alias("valid_prompt_rate"), F.count_distinct("domain").alias("num_domains"), F.count_distinct("template_name").alias("num_templates"),
    )


def thin_groups(df: DataFrame, by: tuple[str, ...], output: str, least: int) -> DataFrame:
    """Groups of rows with an output, their size, and whether it is below the least."""
    rows = df.where(F.col(output).isNotNull() & (F.col(output) != ""))
    return rows.groupBy(*by).agg(F.count("*").alias("n")).withColumn("insufficient", F.col("n") < least)


def matched(left: DataFrame, right: DataFrame, keys: tuple[str, ...], first_by: tuple[str, ...] = ()) -> DataFrame:
    """left joined on equal keys, nulls being equal, with right: with all of its rows of a key, or with the first in the given order."""
    if first_by:
        right = dedup.keep_first(right, keys, first_by)
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = None
    for k in keys:
        here = left[k].eqNullSafe(other[f"_k_{k}"])
        same = here if same is None else same & here
    return left.join(other, same, "left").drop(*[f"_k_{k}" for k in keys])


def match_rate(joined: DataFrame, output: str) -> DataFrame:
    n = F.count("*")
    return joined.agg(F.count(output).alias("matched"), n.alias("total"), F.coalesce(F.try_divide(100.0 * F.count(output), n), F.lit(0.0)).alias("match_rate"))


def to_regenerate(df: DataFrame, annotations: DataFrame, key: str, actions: tuple[str, ...] = TARGET_ACTIONS) -> DataFrame:
    """The rows that annotations (key, action, at) send back, with the last such action of each."""
    last = annotations.where(F.col("action").isin(*actions)).groupBy(key).agg(F.max_by("action", "at").alias("annotation_action"))
    return df.join(last, key)


def weaknesses(metrics: DataFrame) -> DataFrame:
    """Of (metric, value) rows those of losses and those below 0.8."""
    return metrics.where(F.col("metric").endswith("loss") | (F.col("value") < 0.8))


def searched(df: DataFrame, among: dict[str, tuple] | None = None, equal: dict[str, object] | None = None, words: dict[str, str] | None = None) -> DataFrame:
    """Rows whose columns are among the given values, equal a value, and hold a text in either case. An empty choice is no filter."""
    for c, values in (among or {}).items():
        df = df.where(F.col(c).isin(*values)) if values else df
    for c, value in (equal or {}).items():
        df = df.where(F.col(c) == value)
    for c, word in (words or {}).items():
        df = df.where(F.lower(c).contains(word.lower()))
    return df


def refused(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether an answer has one of the phrases of a refusal."""
    return T.contains_any(text, phrases)


def feedback_totals(df: DataFrame, correct: Column) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(correct).alias("positives"), (F.count("*") - F.count_if(correct)).alias("negatives"))


def selected_prompts(df: DataFrame, total: int, tool_ratios: dict[str, float], split_weights: dict[str, float], tool: str, split: str, prompt: str, score: Column) -> DataFrame:
    """Per tool and split the rows of least score, as many as the quotas ask for (one at least); of equal prompts, the one of least score."""
    from pyspark.sql import Window

    quotas = [(t, s, max(1, round(round(total * r) * w))) for t, r in tool_ratios.items() if round(total * r) > 0 for s, w in split_weights.items()]
    limits = df.sparkSession.createDataFrame(quotas, f"`{tool}` string, `{split}` string, _quota int")
    ranked = df.withColumn("_score", score).join(F.broadcast(limits), [tool, split])  # a row per tool and split
    nth = F.row_number().over(Window.partitionBy(tool, split).orderBy("_score", prompt))
    chosen = ranked.withColumn("_nth", nth).where(F.col("_nth") <= F.col("_quota")).drop("_nth", "_quota")
    return dedup.keep_first(chosen, (prompt,), ("_score",)).withColumnRenamed("_score", "score")
