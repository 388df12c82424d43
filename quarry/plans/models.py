"""Model outputs, judgments and labels. Suppliers stand for models and ship flags for tasks: the driver tables have no judgments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup, evaluation as E
from ..operators import filters
from .common import Registry, table

R = Registry()
METRICS = ["quantity", "discount", "tax"]


def _scores(spark, d, prompts=True):
    """(id, model_id, task, three metrics, overall_score), with the prompts' domain and task where they are asked for"""
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").alias("part"), (F.col("l_suppkey") % 20).alias("model_id"), F.col("l_returnflag").alias("task"), (F.col("l_quantity") / 10).alias("quantity"), (F.col("l_discount") * 10).alias("discount"), F.when(F.col("l_tax") > 0, F.col("l_tax") * 10).alias("tax"))
    outputs, judged = line.select("id", "part", "model_id", "task"), line.select("id", "part", "model_id", *METRICS)
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), F.col("o_orderstatus").alias("task")) if prompts else None
    return E.merge_judgments(outputs, judged, METRICS, ("id", "part", "model_id"), asked)


_SCORES = """WITH s0 AS (SELECT l_orderkey AS id, l_suppkey % 20 AS model_id, l_returnflag AS task, o_orderpriority AS domain, o_orderstatus AS task_prompt, l_quantity / 10 AS quantity, l_discount * 10 AS discount, CASE WHEN l_tax > 0 THEN l_tax * 10 END AS tax FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT *, (quantity + discount + coalesce(tax, 0)) / CASE WHEN tax IS NULL THEN 2 ELSE 3 END AS overall_score FROM s0) """


def rounded(df, places: int = 6):
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


@R.add(_SCORES + "SELECT id, model_id, task, domain, task_prompt, round(overall_score, 6) AS overall_score FROM s")
def model_scores(spark, d):
    return rounded(_scores(spark, d).select("id", "model_id", "task", "domain", "task_prompt", "overall_score"))


_BOARD = _SCORES + ", b AS (SELECT model_id, avg(quantity) AS quantity, avg(discount) AS discount, avg(tax) AS tax, avg(overall_score) AS overall_score, count(*) AS n FROM s GROUP BY 1) "


@R.add(_BOARD + "SELECT model_id, round(quantity, 6) AS quantity, round(discount, 6) AS discount, round(tax, 6) AS tax, round(overall_score, 6) AS overall_score, n, row_number() OVER (ORDER BY overall_score DESC, model_id) AS rank FROM b")
def model_leaderboard(spark, d):
    return rounded(E.leaderboard(_scores(spark, d, prompts=False), METRICS))


@R.add(_SCORES + "SELECT model_id, domain, task, CAST(grouping(model_id, domain, task) AS BIGINT) AS grouping, round(avg(overall_score), 6) AS overall_score, count(*) AS n FROM s GROUP BY GROUPING SETS ((model_id), (model_id, domain), (model_id, task))")
def model_grouped_means(spark, d):
    return rounded(E.grouped_means(_scores(spark, d), ["overall_score"], [("model_id",), ("model_id", "domain"), ("model_id", "task")]))


@R.add(_BOARD + ", u AS (UNPIVOT (SELECT model_id, quantity, discount, tax, overall_score FROM b) ON quantity, discount, tax, overall_score INTO NAME metric VALUE score) SELECT metric, model_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC, model_id) AS r FROM u) WHERE r = 1")
def metric_argmax(spark, d):
    return rounded(E.best_per_metric(E.leaderboard(_scores(spark, d, prompts=False), METRICS), [*METRICS, "overall_score"]))


@R.add(_BOARD + "SELECT model_id, metric, round(score, 6) AS score FROM (UNPIVOT (SELECT model_id, quantity, discount, tax FROM b) ON quantity, discount, tax INTO NAME metric VALUE score)")
def score_unpivot(spark, d):
    return rounded(E.long_form(E.leaderboard(_scores(spark, d, prompts=False), METRICS), ["model_id"], METRICS))


@R.add(_SCORES + "SELECT model_id, count(*) FILTER (quantity > 4.5) AS truncated, count(*) AS total, round_even(100.0::DOUBLE * count(*) FILTER (quantity > 4.5) / count(*), 1) AS truncation_rate FROM s GROUP BY 1")
def truncation_rates(spark, d):
    return E.truncation(_scores(spark, d, prompts=False), F.col("quantity") > 4.5)


def _labelled(spark, d):
    """Documents with labels and a stand-in prediction by the length of the text."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    p = F.least(F.lit(1.0), F.col("n_chars") / 3000.0)
    return table(spark, d, "labels").join(docs, "doc_id").withColumn("p", p).withColumn("predicted", (F.col("p") >= 0.3).cast("long"))


_LABELLED = "WITH l AS (SELECT l.doc_id, quality, toxic, lang, n_chars, least(1.0::DOUBLE, n_chars / 3000.0::DOUBLE) AS p FROM labels l JOIN documents d USING (doc_id)), y AS (SELECT *, (p >= 0.3)::BIGINT AS predicted FROM l) "


@R.add(_LABELLED + "SELECT lang, count(*) AS n, avg(quality) AS quality, avg(toxic) AS toxic FROM y GROUP BY lang")
def label_quality_join(spark, d):
    return _labelled(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))


@R.add(_LABELLED + "SELECT quality, predicted, count(*) AS n FROM y GROUP BY ALL")
def label_confusion(spark, d):
    return E.confusion(_labelled(spark, d), "quality", "predicted")


@R.add(_LABELLED + """, c AS (SELECT k, count(*) FILTER (quality = k AND predicted = k) AS tp, count(*) FILTER (quality = k) AS real, count(*) FILTER (predicted = k) AS said FROM y, (VALUES (0), (1)) v(k) GROUP BY k),
m AS (SELECT tp, real, CASE WHEN said = 0 THEN 0 ELSE tp / said END AS p, CASE WHEN real = 0 THEN 0 ELSE tp / real END AS r FROM c)
SELECT round(sum(tp) / sum(real), 9) AS accuracy, round(avg(p), 9) AS "precision", round(avg(r), 9) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 9) AS f1 FROM m""")
def label_classifier_metrics(spark, d):
    return rounded(E.classification_report(_labelled(spark, d), "quality", "predicted"), 9)


@R.add(_LABELLED + "SELECT round((sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*))::DOUBLE, 9) AS auroc FROM y a, y b WHERE a.quality = 1 AND b.quality = 0")
def label_auroc(spark, d):
    return rounded(E.auroc(_labelled(spark, d), F.col("quality"), F.col("p")), 9)


_CURVE = _LABELLED + ", k AS (SELECT least(floor(p * 10), 9)::INT AS bin, avg(quality) AS true_rate, avg(p) AS mean_probability, count(*) AS n FROM y GROUP BY 1) "


@R.add(_CURVE + "SELECT bin, round(true_rate, 9) AS true_rate, round(mean_probability, 9) AS mean_probability, n FROM k")
def label_calibration(spark, d):
    return rounded(E.calibration(_labelled(spark, d), F.col("quality"), F.col("p")), 9)


@R.add(_CURVE + "SELECT round(sum(n * abs(true_rate - mean_probability)) / sum(n), 9) AS ece FROM k")
def label_calibration_error(spark, d):
    return rounded(E.calibration_error(E.calibration(_labelled(spark, d), F.col("quality"), F.col("p"))), 9)


@R.add(_LABELLED + "SELECT round(sqrt(avg((quality - p) * (quality - p))), 9) AS rmse FROM y")
def label_rmse(spark, d):
    return rounded(_labelled(spark, d).agg(E.rmse(F.col("quality"), F.col("p")).alias("rmse")), 9)


@R.add("SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS predicted, round(1 / list_sum(list_transform(embedding, lambda x: exp((x - list_max(embedding))::DOUBLE))), 6) AS confidence FROM embeddings")
def embedding_softmax(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rounded(e.select("vec_id", E.argmax(F.col("v")).alias("predicted"), F.array_max(E.softmax(F.col("v"))).alias("confidence")))


_TIERS_SQL = _BOARD + """, m AS (SELECT model_id, 'top10_accuracy' AS metric, discount / 10 AS value FROM b UNION ALL SELECT model_id, 'tanimoto_at1', quantity / 5 FROM b UNION ALL SELECT model_id, 'hitrate_at1', overall_score / 2 FROM b UNION ALL SELECT model_id, 'mces_at1', tax * 20 FROM b),
t(tier, metric, threshold, "of") AS (VALUES ('Tier 1', 'top10_accuracy', 0.05, 6), ('Tier 1', 'tanimoto_at1', 0.50, 6), ('Tier 1', 'hitrate_at1', 0.35, 6), ('Tier 2', 'top10_accuracy', 0.10, 7), ('Tier 2', 'mces_at1', 9.0, 7), ('Tier 2', 'hitrate_at1', 0.50, 7), ('Tier 3', 'top10_accuracy', 0.20, 8), ('Tier 3', 'tanimoto_at1', 0.60, 8), ('Tier 3', 'mces_at1', 8.0, 8), ('Tier 3', 'hitrate_at1', 0.60, 8))
SELECT model_id, tier, "of", count(*) FILTER (CASE WHEN metric = 'mces_at1' THEN value <= threshold ELSE value >= threshold END) AS met, met >= 0.8 * "of" AS reached FROM m JOIN t USING (metric) GROUP BY model_id, tier, "of" """


def _tiers(spark, d):
    b = E.leaderboard(_scores(spark, d, prompts=False), METRICS)
    values = b.select("model_id", (F.col("discount") / 10).alias("top10_accuracy"), (F.col("quantity") / 5).alias("tanimoto_at1"), (F.col("overall_score") / 2).alias("hitrate_at1"), (F.col("tax") * 20).alias("mces_at1"))
    return E.adoption_tiers(E.long_form(values, ["model_id"], values.columns[1:]).withColumnRenamed("score", "value"))


@R.add(_TIERS_SQL)
def adoption_tiers(spark, d):
    return _tiers(spark, d)


#: The tiers with thresholds that each supplier's own orders reach or miss: shares of its lines by what holds of them.
_SHARES = {"top10_accuracy": "l_discount >= 0.05", "tanimoto_at1": "l_quantity > 25", "hitrate_at1": "l_tax < 0.05", "peaks_explained": "l_returnflag <> 'R'", "intensity_explained": "l_linestatus = 'O' OR l_quantity > 20", "formula_match": "l_quantity > 5", "class_accuracy": "l_quantity > 8", "top1_tanimoto": "l_quantity > 22", "candidate_reduction": "l_discount >= 0"}
_SHARES_SQL = " UNION ALL ".join(f"SELECT l_suppkey AS model_id, '{m}' AS metric, avg(({c})::INT) * {40 if m == 'candidate_reduction' else 1} AS value FROM lineitem GROUP BY 1" for m, c in _SHARES.items())
_LIMITS_SQL = ", ".join(f"('{t}', '{m}', {v}::DOUBLE, {len(ms)})" for t, ms in E.TIERS.items() for m, v in ms.items())


@R.add(f"""WITH m AS ({_SHARES_SQL}), t(tier, metric, threshold, of) AS (VALUES {_LIMITS_SQL}),
r AS (SELECT model_id, tier, count(*) FILTER (CASE WHEN metric = 'mces_at1' THEN value <= threshold ELSE value >= threshold END) >= 0.8 * max(of) AS reached FROM m JOIN t USING (metric) GROUP BY 1, 2)
SELECT model_id, coalesce(max(tier) FILTER (reached), 'Below Tier 1') AS tier FROM r GROUP BY 1""")
def adoption_best_tier(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("model_id"))
    shares = lines.agg(*[(F.avg(F.expr(c).cast("int")) * (40 if m == "candidate_reduction" else 1)).alias(m) for m, c in _SHARES.items()])
    return E.best_tier(E.adoption_tiers(E.long_form(shares, ["model_id"], list(_SHARES)).withColumnRenamed("score", "value")))


@R.add("""WITH e AS (SELECT vec_id, vec_id % 4 AS y, embedding[1:4] AS s FROM embeddings),
p AS (SELECT a.y AS i, b.y AS j, avg(CASE WHEN a.s[a.y + 1] > b.s[a.y + 1] THEN 1.0 WHEN a.s[a.y + 1] = b.s[a.y + 1] THEN 0.5 ELSE 0.0 END) AS u FROM e a, e b WHERE a.y <> b.y GROUP BY ALL) SELECT round(avg(u)::DOUBLE, 9) AS auroc FROM p""")
def class_auroc(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("y"), F.slice("embedding", 1, 4).alias("s"))
    return rounded(E.auroc_of_classes(e, "y", "s"), 9)


@R.add(_BOARD + ", m AS (SELECT avg(quantity) AS quantity, avg(tax) AS tax FROM b) SELECT v.metric, v.threshold, v.direction, coalesce(CASE v.metric WHEN 'quantity' THEN (SELECT quantity FROM m) >= v.threshold WHEN 'tax' THEN (SELECT tax FROM m) <= v.threshold END, false) AS passed FROM (VALUES ('quantity', 2.0::DOUBLE, 'min'), ('tax', 0.1::DOUBLE, 'max'), ('other', 1.0::DOUBLE, 'min')) v(metric, threshold, direction)")
def rubric_verdicts(spark, d):
    b = E.leaderboard(_scores(spark, d, prompts=False), METRICS).agg(F.avg("quantity").alias("quantity"), F.avg("tax").alias("tax"), F.lit(1).alias("one"))
    rubric = spark.createDataFrame([("quantity", 2.0, "min"), ("tax", 0.1, "max"), ("other", 1.0, "min")], "metric string, threshold double, direction string")
    return E.verdicts(E.long_form(b, ["one"], ["quantity", "tax"]).withColumnRenamed("score", "value"), rubric).select("metric", "threshold", "direction", "passed")


@R.add("WITH g AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings), r AS (SELECT rank FROM g) SELECT avg((rank <= 1)::INT) AS hit_at_1, avg((rank <= 5)::INT) AS hit_at_5, avg((rank <= 20)::INT) AS hit_at_20, round(avg(1.0::DOUBLE / rank), 9) AS mrr FROM r")
def ranked_hits(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "embeddings").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.col("embedding")[0]), "vec_id")))
    return rounded(E.ranked_hits(e), 9)


@R.add("SELECT s_suppkey AS key, old, new FROM (SELECT s_suppkey, round(s_acctbal, 2) AS old FROM supplier WHERE s_suppkey % 5 > 0) FULL JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN round(s_acctbal, 2) ELSE round(s_acctbal + 1, 2) END AS new FROM supplier WHERE s_suppkey % 7 > 0) USING (s_suppkey) WHERE old IS DISTINCT FROM new")
def version_diff(spark, d):
    s = table(spark, d, "supplier").withColumn("key", F.col("s_suppkey"))
    a = s.where("key % 5 > 0").select("key", F.round("s_acctbal", 2).alias("v"))
    b = s.where("key % 7 > 0").select("key", F.when(F.col("key") % 3 == 0, F.round("s_acctbal", 2)).otherwise(F.round(F.col("s_acctbal") + 1, 2)).alias("v"))
    return dedup.changed(a, b, "key", "v")


@R.add("SELECT s_suppkey AS key, expected, actual, coalesce(abs(expected - actual) <= 1e-8 + 1e-5 * abs(expected), false) AS agrees FROM (SELECT s_suppkey, s_acctbal AS expected FROM supplier WHERE s_suppkey % 5 > 0) FULL JOIN (SELECT s_suppkey, s_acctbal * (1 + (s_suppkey % 3) * 8e-6) AS actual FROM supplier) USING (s_suppkey)")
def golden_comparison(spark, d):
    s = table(spark, d, "supplier").withColumn("key", F.col("s_suppkey"))
    return dedup.compare(s.where("key % 5 > 0").select("key", F.col("s_acctbal").alias("v")), s.select("key", (F.col("s_acctbal") * (1 + (F.col("key") % 3) * 8e-6)).alias("v")), "key", "v")


def _gated(spark, d):
    """Two judgment payloads made from labels: well-formed, malformed and missing ones."""
    lab = table(spark, d, "labels").withColumn("f", F.when(F.col("doc_id") % 11 == 0, F.lit("{oops")).when(F.col("doc_id") % 13 != 0, F.concat(F.lit('{"a": '), (F.col("doc_id") % 50 + 60).cast("string"), F.lit(', "b": 90}'))))
    r = F.when(F.col("doc_id") % 17 != 0, F.concat(F.lit('{"c": '), (F.col("doc_id") % 40 + 70).cast("string"), F.lit(', "requires_human_review": '), F.when(F.col("doc_id") % 9 == 0, "true").otherwise("false"), F.lit("}")))
    return filters.gate(lab.withColumn("r", r), "f", "r")


@R.add("""WITH p AS (SELECT doc_id, (doc_id % 50 + 60 + 90) / 2 AS fs, doc_id % 40 + 70 AS rs FROM labels)
SELECT doc_id, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 = 0 AND doc_id % 17 = 0 THEN 'missing_judge_scores' WHEN doc_id % 11 = 0 THEN 'invalid_judge_f_json' WHEN doc_id % 13 <> 0 AND fs < 80 THEN 'judge_f_low_score' WHEN doc_id % 17 <> 0 AND rs < 80 THEN 'judge_r_low_score' WHEN doc_id % 17 <> 0 AND doc_id % 9 = 0 THEN 'safety_flag_human_review' WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'missing_dual_judge' ELSE '' END AS reason_code FROM p""")
def judgment_gate(spark, d):
    return _gated(spark, d).select("doc_id", "reason_code")
