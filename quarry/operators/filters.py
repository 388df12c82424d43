"""Quality filters: one reject reason per row, first reason wins; flags; gates on judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

JUDGE = "struct<flags:array<string>,requires_human_review:boolean,safety_awareness:double>"


def reject_reason(text: Column, min_length: int | None = None, max_length: int | None = None, patterns: tuple[str, ...] = ()) -> Column:
    """length, pattern or null (none). Lengths are UTF-8 bytes; a null text fails by length; patterns are substrings."""
    n = F.octet_length(text)
    short = text.isNull()
    if min_length is not None:
        short = short | (n < min_length)
    if max_length is not None:
        short = short | (n > max_length)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.contains(p)
    return F.when(short, "length").when(hit, "pattern")


def quality_filter(df: DataFrame, text: str = "text", key: str = "doc_id", min_length: int | None = 50, max_length: int | None = None, patterns: tuple[str, ...] = (), dedup: bool = True) -> DataFrame:
    """df with reject_reason (null: kept). A text repeated among those that pass the other tests is `dedup`, all but the one of least key.
    Equal texts meet by hash; a hot text's rows are reduced to its least key before the shuffle."""
    out = df.withColumn("reject_reason", reject_reason(F.col(text), min_length, max_length, patterns))
    if not dedup:
        return out
    passed = out.where("reject_reason IS NULL")
    firsts = passed.groupBy(F.sha2(text, 256).alias("_digest")).agg(F.min(key).alias("_first"))
    out = out.withColumn("_digest", F.when(F.col("reject_reason").isNull(), F.sha2(text, 256))).join(firsts, "_digest", "left")
    return out.withColumn("reject_reason", F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason")).when(F.col(key) != F.col("_first"), "dedup")).drop("_digest", "_first")


def filter_stats(judged: DataFrame) -> DataFrame:
    """total, kept and the rejects by reason, in one pass."""
    reason = F.col("reject_reason")
    return judged.agg(F.count("*").alias("total"), F.count_if(reason.isNull()).alias("kept"), *[F.count_if(reason == r).alias(f"rejected_{r}") for r in ("length", "pattern", "dedup")])


def length_histogram(df: DataFrame, text: str = "text", width: int = 100) -> DataFrame:
    """Counts of byte lengths by lower bound, before any filter; nulls are not counted."""
    bucket = (F.floor(F.octet_length(text) / width) * width).cast("long")
    return df.where(F.col(text).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def typed_reason(text: Column, min_length: int, max_length: int, words: tuple[str, ...]) -> Column:
    """TooShort, TooLong, ContainsBadWord or null; null texts have no reason."""
    n = F.octet_length(text)
    return F.when(n < min_length, "TooShort").when(n > max_length, "TooLong").when(T.contains_any(text, words), "ContainsBadWord")


def heuristic_flags(df: DataFrame, text: str = "text", min_chars: int = 120, min_tokens: int = 80, verbs: tuple[str, ...] = T.ACTION_VERBS) -> DataFrame:
    """df with length_char_ok, length_token_ok, action_verb_ok, no_citations and passes_all."""
    t = T.squeezed(F.coalesce(F.col(text), F.lit("")))
    flags = {"length_char_ok": F.length(t) >= min_chars, "length_token_ok": T.token_estimate(t) >= min_tokens, "action_verb_ok": T.has_word(t, verbs), "no_citations": ~T.has_citation(t)}
    all_ok = F.lit(True)
    for name in flags:
        all_ok = all_ok & F.col(name)
    return df.withColumns(flags).withColumn("passes_all", all_ok)


def pass_summary(flagged: DataFrame, flag: str = "passes_all", tokens: str | None = None) -> DataFrame:
    """total, passed, pass_rate to four places, and the mean of a token column."""
    rate = F.round(F.coalesce(F.try_divide(F.count_if(flag), F.count("*")), F.lit(0.0)), 4)
    more = [F.avg(tokens).alias("mean_tokens")] if tokens else []
    return flagged.agg(F.count("*").alias("total"), F.count_if(flag).alias("passed"), rate.alias("pass_rate"), *more)


def drop_reason(text: Column) -> Column:
    """empty_output below ten characters, unsafe_content by keyword, else null."""
    return F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 10, "empty_output").when(T.contains_any(text, T.UNSAFE), "unsafe_content")


def gate(df: DataFrame, first: str = "judge_f_response", second: str = "judge_r_response", least: float = 80.0, both: bool = True) -> DataFrame:
    """df with accepted, reason and reason_code. A score is the mean of a judgment's numeric values; the checks run in a fixed order."""

    def parts(c: str) -> tuple[Column, Column, Column]:
        given = F.coalesce(F.col(c), F.lit("")) != ""
        parsed = F.from_json(c, "map<string,string>", {"mode": "PERMISSIVE"})
        numbers = F.filter(F.transform(F.map_values(parsed), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
        score = F.try_divide(F.aggregate(numbers, F.lit(0.0), lambda a, v: a + v), F.size(numbers).cast("double"))
        return given, F.try_parse_json(c).isNotNull(), score

    f_given, f_json, f_score = parts(first)
    r_given, r_json, r_score = parts(second)
    more = F.from_json(second, JUDGE)
    unsafe = F.exists(F.coalesce(more["flags"], F.array().cast("array<string>")), lambda x: x.startswith("safety")) & (F.coalesce(more["safety_awareness"], F.lit(0.0)) < 60)
    code = (
        F.when(~f_given & ~r_given, "missing_judge_scores")
        .when(f_given & ~f_json, "invalid_judge_f_json")
        .when(f_given & f_score.isNull(), "invalid_judge_f_schema")
        .when(f_given & (f_score < least), "judge_f_low_score")
        .when(r_given & ~r_json, "invalid_judge_r_json")
        .when(r_given & r_score.isNull(), "invalid_judge_r_schema")
        .when(r_given & (r_score < least), "judge_r_low_score")
        .when(r_given & F.coalesce(more["requires_human_review"], F.lit(False)), "safety_flag_human_review")
        .when(r_given & unsafe, "safety_critical_flag")
        .when(F.lit(both) & ~(f_given & r_given), "missing_dual_judge")
    )
    out = df.withColumn("reason_code", F.coalesce(code, F.lit("")))
    reason = F.when(F.col("reason_code") == "judge_f_low_score", F.format_string("judge_f_low_score_%.1f", f_score)).when(F.col("reason_code") == "judge_r_low_score", F.format_string("judge_r_low_score_%.1f", r_score)).otherwise(F.col("reason_code"))
    return out.withColumn("reason", reason).withColumn("accepted", F.col("reason_code") == "")


def reason_counts(judged: DataFrame, reason: str) -> DataFrame:
    """Counts of the reasons with their percentage of all that have one."""
    counts = judged.where(F.coalesce(F.col(reason), F.lit("")) != "").groupBy(reason).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 2))


def resolved_content(df: DataFrame) -> Column:
    """The text of a row by precedence: text, content, prompt with response, instruction with output, messages, the row as JSON."""
    have = set(df.columns)
    options = [F.nullif(F.col(c), F.lit("")) for c in ("text", "content") if c in have]
    for a, b in (("prompt", "response"), ("instruction", "output")):
        if {a, b} <= have:
            options.append(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.concat_ws("\n", a, b)))
    if "messages" in have:
        options.append(F.nullif(F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n"), F.lit("")))
    return F.coalesce(*options, F.to_json(F.struct(*df.columns)))
