"""Statistics and drift over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as S
from .common import Registry, table
from .models import rounded

R = Registry()


def _halves(spark, d):
    """Line items by linestatus: reference O, current F, with values that differ."""
    line = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.when(F.col("l_linestatus") == "F", F.col("l_quantity") * 1.1).otherwise(F.col("l_quantity")).alias("v"), "l_extendedprice")
    return line.where("l_linestatus = 'O'"), line.where("l_linestatus = 'F'")


_HALVES = "WITH l AS (SELECT l_linestatus, l_returnflag, CASE WHEN l_linestatus = 'F' THEN l_quantity * 1.1 ELSE l_quantity END AS v FROM lineitem), o AS (SELECT v, l_returnflag FROM l WHERE l_linestatus = 'O'), f AS (SELECT v, l_returnflag FROM l WHERE l_linestatus = 'F') "


@R.add("SELECT 'l_quantity' AS \"column\", count(l_quantity) AS n, min(l_quantity) AS min, max(l_quantity) AS max, round(sum(l_quantity), 2) AS sum FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount), min(l_discount), max(l_discount), round(sum(l_discount), 2) FROM lineitem UNION ALL SELECT 'l_orderkey', count(l_orderkey), min(l_orderkey), max(l_orderkey), sum(l_orderkey)::DOUBLE FROM lineitem UNION ALL SELECT 'l_returnflag', count(l_returnflag), NULL, NULL, NULL FROM lineitem")
def column_stats(spark, d):
    return rounded(S.column_stats(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_orderkey", "l_returnflag"]), 2)


@R.add("""WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT max(n) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, min(v) AS min, max(v) AS max, max(v) FILTER (i = n // 2) AS p50, max(v) FILTER (i = least(floor(n * 0.95), n - 1)) AS p95, max(v) FILTER (i = least(floor(n * 0.99), n - 1)) AS p99 FROM s""")
def reductions(spark, d):
    return rounded(S.reductions(table(spark, d, "orders"), "o_totalprice"), 4)


@R.add("""WITH e AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 20 AS st FROM orders),
c AS (SELECT least(floor((o_totalprice - lo) / st), 19)::INT AS bin, count(*) AS n FROM orders, e GROUP BY 1)
SELECT b::INT AS bin, round(lo + b * st, 4) AS low, round(lo + (b + 1) * st, 4) AS high, coalesce(n, 0) AS n FROM e, range(20) r(b) LEFT JOIN c ON c.bin = b""")
def numeric_histogram(spark, d):
    return rounded(S.histogram(table(spark, d, "orders"), "o_totalprice", 20), 4)


@R.add("SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, round(min(c_acctbal), 4) AS min, round(quantile_cont(c_acctbal, 0.25), 4) AS q1, round(median(c_acctbal), 4) AS median, round(quantile_cont(c_acctbal, 0.75), 4) AS q3, round(max(c_acctbal), 4) AS max FROM customer GROUP BY 1")
def describe_numeric(spark, d):
    return rounded(S.describe(table(spark, d, "customer"), "c_acctbal", ("c_mktsegment",)), 4)


@R.add("SELECT 'doc_id' AS \"column\", avg((doc_id IS NULL)::INT) AS null_rate, count(DISTINCT doc_id) = count(*) AS is_unique FROM documents UNION ALL SELECT 'text', avg((text IS NULL)::INT), count(DISTINCT text) = count(*) FROM documents UNION ALL SELECT 'lang', avg((lang IS NULL)::INT), count(DISTINCT lang) = count(*) FROM documents")
def null_and_unique_checks(spark, d):
    return S.null_and_unique(table(spark, d, "documents"), ["doc_id", "text", "lang"])


@R.add("SELECT 'quality' AS \"column\", count(quality) / count(*) AS completeness FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'text', count(text) / count(*) FROM documents LEFT JOIN labels USING (doc_id)")
def completeness(spark, d):
    return S.completeness(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left"), ["quality", "text"])


_KS = """, b AS (SELECT v, count(*) FILTER (w = 0) AS a, count(*) FILTER (w = 1) AS b FROM (SELECT v, 0 AS w FROM o UNION ALL SELECT v, 1 FROM f) GROUP BY v),
c AS (SELECT sum(a) OVER (ORDER BY v) / (SELECT count(*) FROM o) AS ca, sum(b) OVER (ORDER BY v) / (SELECT count(*) FROM f) AS cb FROM b) """


@R.add(_HALVES + _KS + "SELECT round(max(abs(ca - cb)), 9) AS ks, (SELECT count(*) FROM o) AS n_reference, (SELECT count(*) FROM f) AS n_current FROM c")
def ks_statistic(spark, d):
    o, f = _halves(spark, d)
    return rounded(S.ks_statistic(o, f, "v"), 9)


@R.add(_HALVES + """, e AS (SELECT min(v) AS lo, (max(v) - min(v)) / 10 AS st FROM o),
p AS (SELECT k, count(*) AS n FROM (SELECT greatest(0, least(floor((v - lo) / st), 9)) AS k FROM o, e) GROUP BY k),
q AS (SELECT k, count(*) AS n FROM (SELECT greatest(0, least(floor((v - lo) / st), 9)) AS k FROM f, e) GROUP BY k),
c AS (SELECT coalesce(p.n, 0) + 1 AS e, coalesce(q.n, 0) + 1 AS a FROM range(10) r(b) LEFT JOIN p ON p.k = b LEFT JOIN q ON q.k = b),
s AS (SELECT e / sum(e) OVER () AS pe, a / sum(a) OVER () AS pa FROM c) SELECT round(sum((pa - pe) * ln(pa / pe)), 9) AS psi FROM s""")
def psi_equal_width(spark, d):
    o, f = _halves(spark, d)
    return rounded(S.psi_equal_width(o, f, "v"), 9)


@R.add(_HALVES + """, g AS (SELECT quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS x FROM o),
p AS (SELECT k, count(*) AS n FROM (SELECT CASE WHEN v >= x[1] AND v <= x[11] THEN least(len(list_filter(x, lambda y: y <= v)), 10) - 1 ELSE -1 END AS k FROM o, g) GROUP BY k),
q AS (SELECT k, count(*) AS n FROM (SELECT CASE WHEN v >= x[1] AND v <= x[11] THEN least(len(list_filter(x, lambda y: y <= v)), 10) - 1 ELSE -1 END AS k FROM f, g) GROUP BY k),
c AS (SELECT CASE WHEN coalesce(p.n, 0) = 0 THEN 0.0001 ELSE p.n END / (SELECT count(*) FROM o) AS pe, CASE WHEN coalesce(q.n, 0) = 0 THEN 0.0001 ELSE q.n END / (SELECT count(*) FROM f) AS pa FROM range(10) r(b) LEFT JOIN p ON p.k = b LEFT JOIN q ON q.k = b)
SELECT round(sum((pa - pe) * ln(pa / pe)), 9) AS psi FROM c""")
def psi_deciles(spark, d):
    o, f = _halves(spark, d)
    return rounded(S.psi_deciles(o, f, "v"), 9)


_CATS = """WITH a AS (SELECT event_type AS value, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS value, count(*) AS n FROM events WHERE user_id % 2 = 1 GROUP BY 1),
m AS (SELECT value, coalesce(a.n, 0) AS n_reference, coalesce(b.n, 0) AS n_current FROM a FULL JOIN b USING (value)) """


def _events(spark, d):
    e = table(spark, d, "events")
    return e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1")


@R.add(_CATS + "SELECT * FROM m")
def categorical_alignment(spark, d):
    return S.categorical_alignment(*_events(spark, d), "event_type")


@R.add(_CATS + ", x AS (SELECT n_current AS o, n_reference / sum(n_reference) OVER () * sum(n_current) OVER () AS e FROM m) SELECT round(sum((o - e) * (o - e) / e), 9) AS chi2, count(*) - 1 AS dof, count(*) FILTER (e = 0) AS new_categories FROM x")
def chi_square_categorical(spark, d):
    return rounded(S.categorical_drift(*_events(spark, d), "event_type"), 9)


@R.add(_CATS + ", x AS (SELECT (n_reference + 1) / sum(n_reference + 1) OVER () AS p, (n_current + 1) / sum(n_current + 1) OVER () AS q FROM m) SELECT round(sum(p * ln(p / q)), 9) AS kl_pq, round(sum(q * ln(q / p)), 9) AS kl_qp, round((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2, 9) AS js FROM x")
def js_divergence(spark, d):
    return rounded(S.divergences(*_events(spark, d), "event_type"), 9)


@R.add("""WITH x AS (SELECT event_id // 500 AS w, value AS v FROM events WHERE value IS NOT NULL),
all_v AS (SELECT DISTINCT v FROM x), n AS (SELECT w, count(*) AS n FROM x GROUP BY w),
g AS (SELECT n.w, n.n, a.v FROM n, all_v a), c AS (SELECT w, v, count(*) AS c FROM x GROUP BY ALL), t AS (SELECT v, sum(c) AS c FROM c GROUP BY v),
u AS (SELECT v, sum(c) OVER (ORDER BY v) / (SELECT count(*) FROM x) AS f FROM t),
k AS (SELECT g.w, g.n, g.v, sum(coalesce(c.c, 0)) OVER (PARTITION BY g.w ORDER BY g.v) / g.n AS f FROM g LEFT JOIN c ON c.w = g.w AND c.v = g.v)
SELECT k.w AS "window", round(max(abs(k.f - u.f)), 9) AS ks, max(k.n) AS n FROM k JOIN u USING (v) GROUP BY k.w""")
def windowed_drift(spark, d):
    return rounded(S.windowed_drift(table(spark, d, "events"), "value", "event_id", 500).drop("n_reference"), 9)


@R.add("WITH r AS (SELECT count(*) AS n, count(DISTINCT doc_id) = count(*) AS unique_ids, avg((text IS NULL)::INT) AS nulls FROM documents) SELECT n, unique_ids, nulls, list_filter([CASE WHEN NOT n >= 500 THEN 'rows' END, CASE WHEN NOT unique_ids THEN 'unique' END, CASE WHEN NOT nulls < 0.01 THEN 'nulls' END], lambda x: x IS NOT NULL) AS failures, n >= 500 AND unique_ids AND nulls < 0.01 AS passed FROM r")
def training_contract(spark, d):
    report = table(spark, d, "documents").agg(F.count("*").alias("n"), (F.count_distinct("doc_id") == F.count("*")).alias("unique_ids"), F.avg(F.col("text").isNull().cast("int")).alias("nulls"))
    return S.contract(report, {"rows": "n >= 500", "unique": "unique_ids", "nulls": "nulls < 0.01"})

