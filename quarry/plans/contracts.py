"""Contracts, quality reports and spectra by shard. Embeddings seen as spectra, cut into shards by id, stand for spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import contracts as C
from ..operators import spectra as P
from ..operators import statistics as S
from .common import Registry, table
from .models import rounded
from .spectra import _INT, _STATUS, _spectra

R = Registry()
_RECORDS = ("""{"input": "a", "output": "b"}""", """{"input": "a"}""", "", "[1]", """{"output": null, "input": 1, "more": 2}""", "{oops")
_LIST = "[" + ", ".join(f"'{r}'" for r in _RECORDS) + "]"
_REC = f"WITH r AS (SELECT doc_id, {_LIST}[doc_id % 6 + 1] AS record, [[]::VARCHAR[], ['output'], NULL, ['input', 'output'], []::VARCHAR[], ['input', 'output']][doc_id % 6 + 1] AS missing FROM documents) "


def _records(spark, d):
    r = F.element_at(F.array(*map(F.lit, _RECORDS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", r.alias("record"))


@R.add(_REC + "SELECT doc_id, missing, 'row ' || doc_id || ': missing fields ' || array_to_string(missing, ', ') AS message FROM r WHERE len(missing) > 0")
def record_faults(spark, d):
    return C.record_faults(_records(spark, d), "record", "doc_id", ("input", "output"))


@R.add(_REC + "SELECT count(missing) AS n, count(*) FILTER (len(missing) > 0) AS faulty, count(missing) >= 100 AS enough, false AS passed FROM r")
def record_check(spark, d):
    return C.record_check(_records(spark, d), "record", ("input", "output"), 100)


@R.add("SELECT 'missing column price' AS fault UNION ALL SELECT 'o_orderpriority: expected int, got string' UNION ALL SELECT 'o_totalprice: expected int, got double'")
def schema_check(spark, d):
    faults = C.schema_faults(table(spark, d, "orders"), {"o_orderkey": "int", "o_custkey": "float", "o_totalprice": "int", "o_orderpriority": "int", "price": "float"})
    return spark.createDataFrame([(f,) for f in faults], "fault string")


@R.add("SELECT 'required_columns' AS \"check\", true AS ok UNION ALL SELECT 'minimum_rows', count(*) >= 500 FROM documents UNION ALL SELECT 'filled_text', count(text) = count(*) FROM documents UNION ALL SELECT 'filled_source', count(source) = count(*) FROM documents")
def input_readiness(spark, d):
    return C.readiness(table(spark, d, "documents"), ("text", "source"), 500, ("text", "source"))


@R.add("WITH c AS (SELECT 'quality' AS \"column\", count(quality) / count(*) AS completeness FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'text', count(text) / count(*) FROM documents) SELECT *, CASE WHEN completeness >= 0.99 THEN 'ok' WHEN completeness >= 0.3 THEN 'warn' ELSE 'fail' END AS status FROM c")
def completeness_status(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return C.completeness_status(S.completeness(both, ["quality", "text"]), 0.3, 0.99)


_COUNTS = f"WITH s AS (SELECT vec_id, {_STATUS} AS status FROM embeddings), c AS (SELECT count(*) AS total, count(*) FILTER (status IN ('shape_mismatch', 'non_positive_mz')) AS integrity_errors, count(*) FILTER (status = 'bad_precursor') AS attrition FROM s) "


def _counts(spark, d):
    return C.attrition(A.canonicalise(_spectra(spark, d)), "status", ("shape_mismatch", "non_positive_mz"))


@R.add(_COUNTS + "SELECT total, integrity_errors, round(integrity_errors / total, 9) AS integrity_error_rate, attrition, round(attrition / total, 9) AS attrition_rate FROM c")
def spectrum_attrition(spark, d):
    return rounded(_counts(spark, d), 9)


@R.add(_COUNTS + "SELECT total, integrity_errors, round(integrity_errors / total, 9) AS integrity_error_rate, attrition, round(attrition / total, 9) AS attrition_rate, CASE WHEN integrity_errors / total > 0.001 THEN 'FAIL' WHEN integrity_errors / total > 0.0001 THEN 'WARN' ELSE 'PASS' END AS canonicalization, 'PASS' AS shard_construction, CASE WHEN attrition > 0 THEN 'FAIL' ELSE 'PASS' END AS training_readiness, 'WARN' AS overall, ['integrity errors above the limit'] AS recommendations FROM c")
def quality_report(spark, d):
    return rounded(C.quality_report(_counts(spark, d), F.lit(0), F.lit(0), F.col("attrition")), 9)


_FIELDS = {"array_sizes": "size(mzs) = size(intensities)", "positive_masses": "array_min(mzs) > 0", "precursor": "precursor_mz > 0 AND precursor_mz < 10000"}


@R.add("WITH s AS (SELECT vec_id % 4 AS shard, CASE WHEN vec_id % 13 = 0 THEN 'a' WHEN vec_id % 11 = 0 THEN 'm' WHEN vec_id % 7 = 0 THEN 'p' END AS f FROM embeddings) SELECT shard, count(*) AS n, count(*) FILTER (f = 'a') AS array_sizes, count(*) FILTER (f = 'm') AS positive_masses, count(*) FILTER (f = 'p') AS precursor FROM s GROUP BY 1")
def shard_faults(spark, d):
    s = _spectra(spark, d).withColumn("shard", F.col("vec_id") % 4)
    return C.shard_faults(s, "shard", {k: F.expr(e) for k, e in _FIELDS.items()})


_SHARDS = f"WITH s AS (SELECT vec_id, vec_id % 4 AS shard, CASE WHEN vec_id % 13 = 0 THEN {_INT}[1:60] ELSE {_INT} END AS v, CASE WHEN vec_id % 7 > 0 THEN vec_id + 0.5 END AS p, CASE WHEN vec_id % 11 = 0 THEN 0.0 ELSE 1.0 END AS lo FROM embeddings) "


def _shards(spark, d):
    """Spectra by shard, with the ids themselves as precursors: statistics have no limit."""
    k = F.col("vec_id")
    return _spectra(spark, d).withColumn("shard", k % 4).withColumn("precursor_mz", F.when(k % 7 > 0, k + 0.5))


@R.add(_SHARDS + "SELECT shard, count(*) AS n, 64 AS min_peaks, 64 AS max_peaks, 64.0 AS mean_peaks, min(lo) AS min_mz, 64.0 AS max_mz, round(min(list_min(v)), 6) AS min_intensity, round(max(list_max(v)), 6) AS max_intensity, round(min(p), 6) AS min_precursor, round(max(p), 6) AS max_precursor, round(avg(p), 6) AS mean_precursor, round(count(p) / count(*), 6) AS precursor_mz_completeness FROM s GROUP BY 1")
def shard_statistics(spark, d):
    return rounded(P.shard_statistics(_shards(spark, d), "shard", fields=("precursor_mz",)))


@R.add("""WITH s AS (SELECT vec_id % 4 AS shard, (vec_id % 3 + 1)::VARCHAR AS charge, CASE WHEN label <> 1 THEN '[M+H]' || label END AS adduct FROM embeddings)
SELECT shard, 'charge' AS field, charge AS value, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT shard, 'adduct', adduct, count(*) FROM s WHERE adduct IS NOT NULL GROUP BY ALL""")
def shard_value_counts(spark, d):
    k = F.col("vec_id")
    rows = table(spark, d, "embeddings").select((k % 4).alias("shard"), (k % 3 + 1).alias("charge"), F.when(F.col("label") != 1, F.concat(F.lit("[M+H]"), F.col("label").cast("string"))).alias("adduct"))
    return P.shard_value_counts(rows, "shard", ("charge", "adduct"))


@R.add(_SHARDS + "SELECT shard, round(quantile_cont(x, 0.05), 6) AS q05, round(quantile_cont(x, 0.25), 6) AS q25, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q75, round(quantile_cont(x, 0.95), 6) AS q95 FROM (SELECT shard, unnest(v) AS x FROM s) GROUP BY 1")
def intensity_quantiles(spark, d):
    return rounded(P.intensity_quantiles(_shards(spark, d), ("shard",)))


@R.add(_SHARDS + "SELECT shard, round(median(len(v)), 6) AS median_peaks FROM s GROUP BY 1")
def shard_median_peaks(spark, d):
    return rounded(P.peak_counts(_shards(spark, d), ("shard",), "intensities"))


@R.add("SELECT round(avg(CASE WHEN vec_id % 11 = 0 THEN 63 ELSE 64 END), 6) AS avg_peaks, 64 AS max_peaks, count(*) AS n FROM embeddings")
def spectrum_complexity(spark, d):
    return rounded(P.complexity(_spectra(spark, d)))


@R.add("""WITH s AS (SELECT vec_id, i, k, sum(i) OVER (PARTITION BY vec_id) AS t FROM (SELECT vec_id, k, CASE WHEN vec_id % 3 = 0 THEN CASE WHEN k = 5 THEN 1000.0::DOUBLE ELSE abs(embedding[k]::DOUBLE) END ELSE abs(embedding[k]::DOUBLE) END AS i FROM embeddings, range(1, 65) r(k))),
e AS (SELECT vec_id, -sum(i / t * ln(i / t + 1e-10)) < 0.5 AS low FROM s GROUP BY 1), r AS (SELECT s.*, low, row_number() OVER (PARTITION BY vec_id ORDER BY i DESC, k) AS r FROM s JOIN e USING (vec_id))
SELECT vec_id, low AS low_entropy, count(*) FILTER (NOT low OR r <= 8) AS peaks, round(sum(i) FILTER (NOT low OR r <= 8), 6) AS total FROM r GROUP BY vec_id, low""")
def spectrum_low_entropy(spark, d):
    from ..operators import vectors as V

    s = V.as_spectrum(table(spark, d, "embeddings"))
    s = s.withColumn("intensities", F.transform("intensities", lambda x, i: F.when((F.col("vec_id") % 3 == 0) & (i == 4), 1000.0).otherwise(x)))
    f = P.filter_low_entropy(s, 8)
    return rounded(f.select("vec_id", "low_entropy", F.size("mzs").cast("long").alias("peaks"), A.total(F.col("intensities")).alias("total")))


@R.add("SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 0 END AS adduct_id, CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 0 END AS instrument_id FROM embeddings")
def spectrum_categories(spark, d):
    k = F.col("vec_id")
    adduct = F.element_at(F.array(*map(F.lit, (*P.ADDUCTS, "other"))), (k % 4 + 1).cast("int"))
    tool = F.when(k % 3 == 0, "Orbitrap").when(k % 3 == 1, "FTICR")
    return table(spark, d, "embeddings").select("vec_id", P.category_id(adduct, P.ADDUCTS).alias("adduct_id"), P.category_id(tool, P.INSTRUMENTS).alias("instrument_id"))


_P = "least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda j: pow(-1.0, j - 1) * exp(-2 * pow(j * x, 2))))))"


@R.add(f"""WITH l AS (SELECT CASE WHEN l_linestatus = 'F' THEN l_quantity + CASE WHEN l_orderkey % 9 = 0 THEN 1 ELSE 0 END ELSE l_quantity END AS v, l_linestatus AS s FROM lineitem), o AS (SELECT v FROM l WHERE s = 'O'), f AS (SELECT v FROM l WHERE s = 'F'),
b AS (SELECT v, count(*) FILTER (w = 0) AS a, count(*) FILTER (w = 1) AS b FROM (SELECT v, 0 AS w FROM o UNION ALL SELECT v, 1 FROM f) GROUP BY v), n AS (SELECT (SELECT count(*) FROM o) AS n, (SELECT count(*) FROM f) AS m),
c AS (SELECT sum(a) OVER (ORDER BY v) / n AS ca, sum(b) OVER (ORDER BY v) / m AS cb FROM b, n), k AS (SELECT max(abs(ca - cb)) AS ks FROM c),
x AS (SELECT ks, n, m, (sqrt(n * m / (n + m)::DOUBLE) + 0.12 + 0.11 / sqrt(n * m / (n + m)::DOUBLE)) * ks AS x FROM k, n)
SELECT round(ks, 9) AS ks, n AS n_reference, m AS n_current, round({_P}, 6) AS p_value, {_P} < 0.05 AS drift FROM x""")
def ks_decision(spark, d):
    line = table(spark, d, "lineitem").select("l_linestatus", F.when(F.col("l_linestatus") == "F", F.col("l_quantity") + F.when(F.col("l_orderkey") % 9 == 0, 1).otherwise(0)).otherwise(F.col("l_quantity")).alias("v"))
    out = S.ks_test(line.where("l_linestatus = 'O'"), line.where("l_linestatus = 'F'"), "v")
    return out.select(F.round("ks", 9).alias("ks"), "n_reference", "n_current", F.round("p_value", 6).alias("p_value"), "drift")


_SEMANTIC = f"""WITH w AS (SELECT vec_id // 100 AS "window", vec_id % 17 + CASE WHEN vec_id >= 300 THEN 4 ELSE 0 END AS peaks, vec_id % 23 + 0.5 AS precursor, embedding, 'a' || (vec_id * vec_id % 3) AS adduct FROM embeddings),
g AS (SELECT DISTINCT "window" AS win FROM w WHERE "window" > 0),
kp AS (SELECT win, max(abs(c - f)) AS ks, max(n) AS n, max(m) AS m FROM (SELECT win, v, (SELECT count(*) FROM w WHERE "window" = 0 AND peaks <= v) / (SELECT count(*) FROM w WHERE "window" = 0) AS f, (SELECT count(*) FROM w WHERE "window" = win AND peaks <= v) / (SELECT count(*) FROM w WHERE "window" = win) AS c, (SELECT count(*) FROM w WHERE "window" = 0) AS n, (SELECT count(*) FROM w WHERE "window" = win) AS m FROM g, (SELECT DISTINCT peaks AS v FROM w)) GROUP BY win),
kq AS (SELECT win, max(abs(c - f)) AS ks, max(n) AS n, max(m) AS m FROM (SELECT win, v, (SELECT count(*) FROM w WHERE "window" = 0 AND precursor <= v) / (SELECT count(*) FROM w WHERE "window" = 0) AS f, (SELECT count(*) FROM w WHERE "window" = win AND precursor <= v) / (SELECT count(*) FROM w WHERE "window" = win) AS c, (SELECT count(*) FROM w WHERE "window" = 0) AS n, (SELECT count(*) FROM w WHERE "window" = win) AS m FROM g, (SELECT DISTINCT precursor AS v FROM w)) GROUP BY win),
pp AS (SELECT win, ks, {_P} AS p FROM (SELECT *, (sqrt(n * m / (n + m)::DOUBLE) + 0.12 + 0.11 / sqrt(n * m / (n + m)::DOUBLE)) * ks AS x FROM kp)),
pq AS (SELECT win, ks, CASE WHEN ks <= 0 THEN 1.0 ELSE {_P} END AS p FROM (SELECT *, (sqrt(n * m / (n + m)::DOUBLE) + 0.12 + 0.11 / sqrt(n * m / (n + m)::DOUBLE)) * ks AS x FROM kq)),
i AS (SELECT "window" AS win, quantile_cont(abs(v::DOUBLE), [0.25, 0.5, 0.75]) AS q FROM (SELECT "window", unnest(embedding) AS v FROM w) GROUP BY 1),
gap AS (SELECT a.win, greatest(abs(a.q[1] - b.q[1]), abs(a.q[2] - b.q[2]), abs(a.q[3] - b.q[3])) AS gap FROM i a, i b WHERE b.win = 0 AND a.win > 0),
ca AS (SELECT "window" AS win, adduct, count(*) AS n FROM w GROUP BY ALL), sz AS (SELECT win, sum(n) AS s FROM ca GROUP BY 1),
ch AS (SELECT sz.win, sum(pow(coalesce(c.n, 0) - b.n / (SELECT s FROM sz WHERE win = 0) * sz.s, 2) / (b.n / (SELECT s FROM sz WHERE win = 0) * sz.s)) AS x, count(*) - 1 AS dof FROM sz JOIN ca b ON b.win = 0 LEFT JOIN ca c ON c.win = sz.win AND c.adduct = b.adduct WHERE sz.win > 0 GROUP BY sz.win)
SELECT pp.win AS "window", round(pp.ks, 6) AS peaks_ks, round(pp.p, 6) AS peaks_p, round(pq.ks, 6) AS precursor_ks, round(pq.p, 6) AS precursor_p, round(gap, 6) AS intensity_gap, round(x, 6) AS adduct_chi2,
list_filter([CASE WHEN pp.p < 0.01 THEN 'peak counts' END, CASE WHEN pq.p < 0.01 THEN 'precursor masses' END, CASE WHEN gap > 0.1 THEN 'intensity quantiles' END, CASE WHEN exp(-x / 2) < 0.01 THEN 'adduct' END], lambda r: r IS NOT NULL) AS reasons, pp.p < 0.01 OR pq.p < 0.01 OR gap > 0.1 OR exp(-x / 2) < 0.01 AS drift FROM pp JOIN pq USING (win) JOIN gap USING (win) JOIN ch USING (win)"""


def semantic_rows(vectors):
    """Stand-ins for spectra: peak counts, precursors, intensities and adducts made from ids and embeddings."""
    k = F.col("vec_id")
    return vectors.select("vec_id", (k % 17 + F.when(k >= 300, 4).otherwise(0)).alias("peaks"), (k % 23 + 0.5).alias("precursor"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("intensities"), F.concat(F.lit("a"), (k * k % 3).cast("string")).alias("adduct"))


semantic_rows.sql = _SEMANTIC


@R.add(_SEMANTIC)
def semantic_drift(spark, d):
    t = semantic_rows(table(spark, d, "embeddings"))
    return rounded(P.semantic_drift(t, "vec_id", 100, "peaks", "precursor", "intensities", ("adduct",)).drop("adduct_p"))


@R.add("SELECT avg((list_contains([vec_id % 5, vec_id % 7, vec_id % 3], label))::INT) AS exact_at_3, avg((vec_id % 5 = label)::INT) AS exact_at_1, avg(((label + 0.25 BETWEEN vec_id % 4 AND vec_id % 4 + 3))::INT) AS picp, round(avg(abs((vec_id + 1.001 - (vec_id + 1)) / (vec_id + 1) * 1e6)), 6) AS mean_ppm, round(avg((vec_id + 1)::DOUBLE / nullif(vec_id % 3, 0)), 6) AS reduction FROM embeddings")
def structure_measures(spark, d):
    k, label = F.col("vec_id"), F.col("label").cast("long")
    ranked = F.array(k % 5, k % 7, k % 3)
    ppm = F.abs(P.mass_error_ppm(k + 1.001, (k + 1).cast("double")))
    return rounded(table(spark, d, "embeddings").agg(F.avg(P.exact_at_k(label, ranked, 3).cast("int")).alias("exact_at_3"), F.avg(P.exact_at_k(label, ranked, 1).cast("int")).alias("exact_at_1"), P.coverage(label + 0.25, k % 4, k % 4 + 3).alias("picp"), F.avg(ppm).alias("mean_ppm"), F.avg(P.reduction_factor(k + 1, F.nullif(k % 3, F.lit(0).cast("long")))).alias("reduction")))
