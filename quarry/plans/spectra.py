"""Spectra and vectors. Embeddings seen as spectra stand for spectra: places are masses, absolute values intensities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import vectors as V
from .common import Registry, table
from .models import rounded

R = Registry()
_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_TOP = f"""WITH s AS (SELECT b.vec_id AS query_id, a.vec_id, a.label, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) """


def _queries(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@R.add(_TOP + "SELECT query_id, vec_id, label, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def vector_topk(spark, d):
    return rounded(V.top_k(table(spark, d, "embeddings"), _queries(spark, d), 10))


@R.add(_TOP.replace("WHERE b.vec_id % 20 = 0", "WHERE b.vec_id % 20 = 0 AND a.label = 3") + "SELECT query_id, vec_id, label, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def vector_filtered_topk(spark, d):
    return rounded(V.top_k(table(spark, d, "embeddings").where("label = 3"), _queries(spark, d), 5))


@R.add(_TOP.replace("b.vec_id % 20 = 0", "b.vec_id IN (7, 11)") + "SELECT query_id, vec_id, label, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def vector_nearest_to_id(spark, d):
    return rounded(V.nearest_to(table(spark, d, "embeddings"), [7, 11], 5))


@R.add(_TOP + "SELECT query_id, vec_id, label, round(score, 6) AS score, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS collection, rank FROM r WHERE rank <= 6")
def vector_federated(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(V.federated({"even": e.where("vec_id % 2 = 0"), "odd": e.where("vec_id % 2 = 1")}, _queries(spark, d), 6))


@R.add(_TOP + "SELECT query_id, vec_id, label, round(score, 6) AS score, rank FROM r WHERE rank <= 20 AND label = 2 AND (CASE WHEN vec_id % 5 > 0 THEN vec_id % 9 END IS NULL OR abs(vec_id % 9 - 4) <= 2)")
def vector_rerank(spark, d):
    found = V.top_k(table(spark, d, "embeddings"), _queries(spark, d), 20).withColumn("rt", F.when(F.col("vec_id") % 5 > 0, F.col("vec_id") % 9))
    return rounded(V.rerank(found, {"label": "2"}, "rt", 4, 2).drop("rt"))


_HEX = "(('0x' || substr(md5(concat_ws('|', 7, vec_id, v, i - 1)), {at}, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"


@R.add(f"""WITH q AS (SELECT vec_id AS query_id, v, list(embedding[i]::DOUBLE + CASE WHEN v > 0 THEN 0.05::DOUBLE * sqrt(-2 * ln({_HEX.format(at=1)})) * cos(2 * pi() * {_HEX.format(at=9)}) ELSE 0 END ORDER BY i) AS x FROM embeddings, range(3) t(v), range(1, 65) r(i) WHERE vec_id % 20 = 0 GROUP BY ALL),
s AS (SELECT query_id, v, vec_id, list_dot_product(embedding::DOUBLE[], x) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(x, x))) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(max(score), 6) AS score FROM r WHERE rank <= 8 GROUP BY ALL""")
def vector_expanded(spark, d):
    variants = V.expanded(_queries(spark, d), 2, 0.05).select(F.struct("query_id", "variant").alias("query_id"), "query_vector")
    found = V.top_k(table(spark, d, "embeddings"), variants, 8).withColumn("query_id", F.col("query_id.query_id"))
    return rounded(V.best_per_id(found))


@R.add("SELECT vec_id, list_transform(embedding, lambda x: round(x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8), 6)) AS unit FROM embeddings")
def vector_l2norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.transform(A.l2(F.col("embedding")), lambda x: A.nearest(x, 6)).alias("unit"))


@R.add("SELECT label, i - 1 AS place, round(avg(embedding[i]::DOUBLE), 6) AS value FROM embeddings, range(1, 65) r(i) GROUP BY ALL")
def vector_centroids(spark, d):
    return rounded(V.mean_vector(table(spark, d, "embeddings"), ("label",))).select("label", F.col("place").cast("long").alias("place"), "value")


def _spectra(spark, d):
    """Some spectra are spoilt: no precursor, a zero mass, zero intensities, a lost value. Ids have no bound, but precursors do: they begin
    again after 9,999, below the mass from which on a precursor is bad."""
    s = V.as_spectrum(table(spark, d, "embeddings"))
    k = F.col("vec_id")
    return s.select("vec_id", F.when(k % 11 == 0, F.transform("mzs", lambda x: x - 1)).otherwise(F.col("mzs")).alias("mzs"), F.when(k % 13 == 0, F.slice("intensities", 1, 60)).otherwise(F.transform("intensities", lambda x: F.when(x < 0.05, 0.0).otherwise(x))).alias("intensities"), F.when(k % 7 != 0, F.pmod(k, F.lit(9_999)) + 0.5).alias("precursor_mz"))


_STATUS = "CASE WHEN vec_id % 13 = 0 THEN 'shape_mismatch' WHEN vec_id % 11 = 0 THEN 'non_positive_mz' WHEN vec_id % 7 = 0 THEN 'bad_precursor' ELSE 'ok' END"
_INT = "list_transform(embedding, lambda x: CASE WHEN abs(x::DOUBLE) < 0.05 THEN 0.0::DOUBLE ELSE abs(x::DOUBLE) END)"


@R.add(f"WITH s AS (SELECT vec_id, {_STATUS} AS status, {_INT} AS v FROM embeddings) SELECT vec_id, status, CASE WHEN status = 'ok' THEN round(list_sum(v) / list_max(v), 6) END AS mass FROM s")
def spectrum_canonicalize(spark, d):
    c = A.canonicalise(_spectra(spark, d))
    return rounded(c.select("vec_id", "status", A.total(F.transform("canon", lambda x: x["i"])).alias("mass")))


@R.add(f"WITH s AS (SELECT {_STATUS} AS status FROM embeddings) SELECT status, count(*) AS n FROM s GROUP BY 1")
def spectrum_reject_summary(spark, d):
    return A.canonicalise(_spectra(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@R.add(f"WITH s AS (SELECT vec_id, {_STATUS} AS status, {_INT} AS v FROM embeddings), k AS (SELECT vec_id, status, list_reverse_sort(list_filter(v, lambda x: x > 0))[1:50] AS v FROM s) SELECT vec_id, CASE WHEN status = 'ok' AND len(v) < 50 THEN 'too_few_peaks' ELSE status END AS status, CASE WHEN status = 'ok' AND len(v) >= 50 THEN round(list_sum(v) / list_max(v), 6) END AS mass FROM k")
def spectrum_strict(spark, d):
    c = A.canonicalise(_spectra(spark, d), min_peaks=50, max_peaks=50, drop_zero=True)
    return rounded(c.select("vec_id", "status", A.total(F.transform("canon", lambda x: x["i"])).alias("mass")))


@R.add("SELECT vec_id, i // 10 AS bin, round(sum(abs(embedding[i]::DOUBLE)), 6) AS intensity FROM embeddings, range(1, 65) r(i) GROUP BY ALL")
def spectrum_binning(spark, d):
    s = V.as_spectrum(table(spark, d, "embeddings"))
    return rounded(A.binned(s, "vec_id", "mzs", "intensities", 0, 2000, 10)).select("vec_id", F.col("bin").cast("long").alias("bin"), "intensity")


@R.add("WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings), t AS (SELECT vec_id, v, list_sum(v) AS s FROM s) SELECT vec_id, round(list_sum(list_transform(v, lambda x: -(x / s) * ln(x / s + 1e-10))), 6) AS entropy FROM t")
def spectrum_entropy(spark, d):
    s = V.as_spectrum(table(spark, d, "embeddings"))
    return rounded(s.select("vec_id", A.entropy(F.col("intensities")).alias("entropy")))


@R.add("SELECT vec_id, mz, round(i, 6) AS i FROM (SELECT vec_id, k::DOUBLE AS mz, abs(embedding[k]::DOUBLE) AS i, row_number() OVER (PARTITION BY vec_id ORDER BY abs(embedding[k]) DESC, k) AS r FROM embeddings, range(1, 65) t(k)) WHERE r <= 5")
def spectrum_topk_peaks(spark, d):
    s = V.as_spectrum(table(spark, d, "embeddings"))
    return rounded(s.select("vec_id", F.inline(A.strongest(F.col("mzs"), F.col("intensities"), 5))).select("vec_id", "mz", "i"))


@R.add("""WITH p AS (SELECT vec_id, k::DOUBLE AS mz, abs(embedding[k]::DOUBLE) AS i FROM embeddings, range(1, 65) t(k)), q AS (SELECT vec_id, k + (vec_id % 5) * 0.004 AS m FROM embeddings, range(1, 65, 2) t(k))
SELECT vec_id, round(avg(h), 6) AS peaks_explained, round(sum(i * h) / sum(i), 6) AS intensity_explained FROM (SELECT vec_id, i, EXISTS (SELECT 1 FROM q WHERE q.vec_id = p.vec_id AND abs(q.m - p.mz) <= 0.01)::INT AS h FROM p) GROUP BY vec_id""")
def spectrum_explained(spark, d):
    s = V.as_spectrum(table(spark, d, "embeddings"))
    seen = s.select("vec_id", F.inline(A.peaks(F.col("mzs"), F.col("intensities"))))
    said = seen.where("mz % 2 = 1").select("vec_id", (F.col("mz") + (F.col("vec_id") % 5) * 0.004).alias("mz"), "i")
    return rounded(V.explained(seen, said, "vec_id"))


@R.add("SELECT vec_id, round(list_max(embedding[1:60]), 6) AS top, round(list_sum(list_transform(embedding[1:60], lambda x: x::DOUBLE / CASE WHEN list_max(embedding[1:60]) > 0 THEN list_max(embedding[1:60])::DOUBLE ELSE 1 END)), 6) AS total, 100 AS length FROM embeddings")
def spectrum_fitted(spark, d):
    """Cut to 60 peaks and filled up to 100 with zeros, then divided by the largest."""
    v = A.fitted(F.slice("embedding", 1, 60).cast("array<double>"), 100)
    e = table(spark, d, "embeddings").select("vec_id", F.array_max(v).alias("top"), A.total(A.normalised(v)).alias("total"), F.size(v).alias("length"))
    return rounded(e)
