"""Joins of outputs with judgments, leaderboards, and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import bound, total


def row_mean(columns: list[str]) -> Column:
    """The mean of the values that are there (not null, not NaN); null without any."""
    values = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull() & ~F.isnan(v))
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values).cast("double"))


def merge_judgments(outputs: DataFrame, judgments: DataFrame, metrics: list[str], keys: tuple[str, ...] = ("id", "model_id"), prompts: DataFrame | None = None, prompt_key: str = "id") -> DataFrame:
    """Outputs joined with judgments on the keys, with prompts (their clashing columns get a suffix), and overall_score."""
    out = outputs.join(judgments, list(keys), "inner")
    if prompts is not None:
        clash = [c for c in prompts.columns if c != prompt_key and c in out.columns]
        out = out.join(prompts.withColumnsRenamed({c: f"{c}_prompt" for c in clash}), prompt_key, "left")
    return out.withColumn("overall_score", row_mean(metrics))


def leaderboard(scores: DataFrame, metrics: list[str], model: str = "model_id") -> DataFrame:
    """Mean of each metric and of overall_score per model, ranked by the latter, then by model."""
    means = scores.where(F.col(model).isNotNull()).groupBy(model).agg(*[F.avg(m).alias(m) for m in [*metrics, "overall_score"]], F.count("*").alias("n"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("overall_score"), model)))  # a row per model


def grouped_means(scores: DataFrame, metrics: list[str], sets: list[tuple[str, ...]]) -> DataFrame:
    """The means for several groupings in one pass, by grouping sets; keys outside a grouping are null and `grouping` tells which it is."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    return scores.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.grouping_id().alias("grouping"), *[F.avg(m).alias(m) for m in metrics], F.count("*").alias("n"))


def truncation(outputs: DataFrame, flag: Column, model: str = "model_id") -> DataFrame:
    """truncated, total and rate in percent per model."""
    out = outputs.groupBy(model).agg(F.count_if(flag).alias("truncated"), F.count("*").alias("total"))
    return out.withColumn("truncation_rate", F.bround(100.0 * F.col("truncated") / F.col("total"), 1))


def with_truncation(board: DataFrame, stats: DataFrame, model: str = "model_id") -> DataFrame:
    """A leaderboard with each model's truncation, where there is any, and its status. stats: a row per model."""
    out = board.join(stats, model, "left")
    return out.withColumn("truncation_status", F.when(F.col("truncation_rate") > 0, "truncated").otherwise("complete"))


def long_form(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """A row per id and metric: metric, score."""
    return df.unpivot(ids, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "score")


def best_per_metric(board: DataFrame, metrics: list[str], model: str = "model_id") -> DataFrame:
    """The first model, in order, of the highest mean for each metric."""
    long = long_form(board, [model], metrics)
    return long.groupBy("metric").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(model).alias("m"))).alias("b")).select("metric", F.col("b.m").alias(model), (-F.col("b.s")).alias("score"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy and macro precision, recall and F1; a class without predictions or rows counts as 0."""
    cells = confusion(df, truth, predicted)
    per = cells.select(F.explode(F.array_distinct(F.array(truth, predicted))).alias("label"), truth, predicted, "n").groupBy("label").agg(
        F.sum(F.when((F.col(truth) == F.col("label")) & (F.col(predicted) == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col(truth) == F.col("label"), F.col("n")).otherwise(0)).alias("real"),
        F.sum(F.when(F.col(predicted) == F.col("label"), F.col("n")).otherwise(0)).alias("said"),
    )
    zero = F.lit(0.0)
    precision, recall = F.coalesce(F.try_divide("tp", "said"), zero), F.coalesce(F.try_divide("tp", "real"), zero)
    per = per.withColumn("p", precision).withColumn("r", recall).withColumn("f", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), zero))
    return per.agg((F.sum("tp") / F.sum("real")).alias("accuracy"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg("f").alias("f1"))


def auroc(df: DataFrame, truth: Column, score: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the curve, of each group if asked for, by the rank sum with ties at mid rank. Rows are counted by score first, and ranks
    come from bucketed sums."""
    from .ordering import range_bucket, range_edges, running

    counts = df.select(*by, truth.cast("int").alias("y"), score.cast("double").alias("s")).where("y IS NOT NULL AND s IS NOT NULL").groupBy(*by, "s").agg(F.sum("y").cast("long").alias("pos"), F.count("*").alias("n"))
    ranked = running(counts, range_bucket(F.col("s"), range_edges(counts, "s", 32)), [F.col("s")], {"upto": F.col("n")}, by)
    mid = F.col("upto") - (F.col("n") - 1) / 2.0
    out = ranked.groupBy(*by).agg(F.sum(mid * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return out.select(*by, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0, (F.col("p") * (F.col("n") - F.col("p"))).cast("double")).alias("auroc"))


def auroc_of_classes(df: DataFrame, truth: str, scores: str) -> DataFrame:
    """The mean over ordered pairs of classes (one against one) of the area under the curve. truth: a class from 0; scores: an array with a
    score for each class. A row takes part in twice as many pairs as there are other classes, and pairs are ranked side by side."""
    y, s = F.col(truth).cast("int"), F.col(scores)
    others = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: k != y)
    positive = F.transform(others, lambda k: F.struct(y.alias("i"), k.alias("j"), F.lit(1).alias("y"), s[y].cast("double").alias("s")))
    negative = F.transform(others, lambda k: F.struct(k.alias("i"), y.alias("j"), F.lit(0).alias("y"), F.element_at(s, k + 1).cast("double").alias("s")))
    pairs = df.where(y.between(0, F.size(s) - 1)).select(F.inline(F.concat(positive, negative)))
    return auroc(pairs, F.col("y"), F.col("s"), ("i", "j")).agg(F.avg("auroc").alias("auroc"))


def best_tier(tiers: DataFrame, group: str = "model_id") -> DataFrame:
    """The highest tier that each group of adoption_tiers()'s rows has reached."""
    best = F.max(F.when(F.col("reached"), F.col("tier")))  # tiers' names are in order
    return tiers.groupBy(group).agg(F.coalesce(best, F.lit("Below Tier 1")).alias("tier"))


def rmse(truth: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((truth - predicted) * (truth - predicted)))


def calibration(df: DataFrame, truth: Column, probability: Column, bins: int = 10) -> DataFrame:
    """Per filled bin of equal width: share of positives, mean probability, rows."""
    which = F.least(F.floor(probability * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(which.alias("bin")).agg(F.avg(truth.cast("double")).alias("true_rate"), F.avg(probability).alias("mean_probability"), F.count("*").alias("n"))


def calibration_error(curve: DataFrame) -> DataFrame:
    """The expected calibration error of calibration()'s rows."""
    return curve.agg((F.sum(F.col("n") * F.abs(F.col("true_rate") - F.col("mean_probability"))) / F.sum("n")).alias("ece"))


def softmax(logits: Column) -> Column:
    raised = bound(F.struct(logits.alias("v"), F.array_max(logits).alias("top")), lambda b: F.transform(b["v"], lambda x: F.exp((x - b["top"]).cast("double"))))
    whole = bound(raised, lambda e: F.struct(e.alias("e"), total(e).alias("s")))
    return bound(whole, lambda b: F.transform(b["e"], lambda x: x / b["s"]))


def argmax(values: Column) -> Column:
    """The first place, from 0, of the largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def verdicts(metrics: DataFrame, rubric: DataFrame) -> DataFrame:
    """rubric: metric, threshold, direction (min or max). A metric that is not there fails."""
    both = rubric.join(metrics, "metric", "left")
    ok = F.when(F.col("direction") == "max", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return both.withColumn("passed", F.coalesce(ok, F.lit(False)))


# Thresholds of the adoption tiers. For mces_at1 less is better.
TIERS = {
    "Tier 1": {"top10_accuracy": 0.05, "tanimoto_at1": 0.50, "hitrate_at1": 0.35, "peaks_explained": 0.60, "intensity_explained": 0.60, "formula_match": 0.90},
    "Tier 2": {"top10_accuracy": 0.10, "top1_tanimoto": 0.55, "mces_at1": 9.0, "hitrate_at1": 0.50, "intensity_explained": 0.70, "candidate_reduction": 10.0, "class_accuracy": 0.80},
    "Tier 3": {"top1_accuracy": 0.08, "top10_accuracy": 0.20, "tanimoto_at1": 0.60, "mces_at1": 8.0, "hitrate_at1": 0.60, "hitrate_at20": 0.95, "intensity_explained": 0.80, "candidate_reduction": 30.0},
}


def adoption_tiers(metrics: DataFrame, group: str = "model_id") -> DataFrame:
    """metrics: group, metric, value. Per group and tier the thresholds met, and whether they are four fifths of the tier's."""
    spark = metrics.sparkSession
    rows = [(t, m, v, len(ms)) for t, ms in TIERS.items() for m, v in ms.items()]
    limits = spark.createDataFrame(rows, "tier string, metric string, threshold double, of int")
    met = F.when(F.col("metric") == "mces_at1", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    out = metrics.join(F.broadcast(limits), "metric").groupBy(group, "tier", "of").agg(F.count_if(met).alias("met"))
    return out.withColumn("reached", F.col("met") >= 0.8 * F.col("of"))


def ranked_hits(ranks: DataFrame, cuts: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Hit rates at the cuts and the mean reciprocal rank; a null rank is a miss."""
    hit = [F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"hit_at_{k}") for k in cuts]
    return ranks.agg(*hit, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
