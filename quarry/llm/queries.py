"""Queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, hash_tree, html_blocks, kmeans_tree, langid, line_dedup, near_dups, quality_crf, resampling, secret_scan, wordpiece
from .common import fold, table

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs, langid.train(docs)).select("doc_id", fold().alias("held_out"), "lang_pred", "score")


def op4_lstm_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.train(pages)).select("page_id", "url", "text", "n_chars")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), BYTE_RANKS, outputs=("digests",))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), BYTE_RANKS)


def op9_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard(table(spark, sf_dir, "documents"), hash_tree.Topology.laid_out(40))


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.judge(docs, field).drop("line_labels")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM q),
p AS (
  SELECT rn, n, i, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
h AS (SELECT p.rn, p.i, p.n, q.item FROM p JOIN q ON p.n = q.n AND p.k = q.k),
c AS (SELECT rn, count(DISTINCT j) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS j FROM h) GROUP BY rn),
t AS (SELECT rn, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rn, item FROM h) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rn) LEFT JOIN t USING (rn)
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


#: All windows of all documents, where the operator takes those around repeated fingerprints only.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rn, doc_id, i, ls[i] AS line, len(regexp_extract_all(ls[i], '[^ \t\n\r\x0B\f]+')) AS w FROM (SELECT rn, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
c AS (SELECT rn, doc_id, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, w, row_number() OVER (PARTITION BY rn ORDER BY i) - 1 AS k, sum(w) OVER (PARTITION BY rn ORDER BY i) AS upto FROM l WHERE w > 0),
f AS (SELECT a.rn, a.doc_id, a.k AS s, min(b.k) + 1 AS e FROM c a JOIN c b ON a.rn = b.rn AND b.k >= a.k AND b.upto - a.upto + a.w >= 50 GROUP BY ALL),
g AS (SELECT b.rn, b.doc_id, max(a.k) AS s, b.k + 1 AS e FROM c a JOIN c b ON a.rn = b.rn AND b.k >= a.k AND b.upto - a.upto + a.w >= 50 GROUP BY b.rn, b.doc_id, b.k),
w AS (SELECT DISTINCT rn, doc_id, s, e FROM (SELECT * FROM f UNION ALL SELECT * FROM g)),
h AS (SELECT w.rn, w.doc_id, w.s, w.e, sha256(string_agg(c.t, chr(10) ORDER BY c.k)) AS h FROM w JOIN c ON c.rn = w.rn AND c.k >= w.s AND c.k < w.e GROUP BY ALL),
o AS (SELECT *, first_value(rn) OVER p AS rn0, first_value(s) OVER p AS s0 FROM h WINDOW p AS (PARTITION BY h ORDER BY doc_id NULLS LAST, s)),
r AS (SELECT rn, CASE WHEN rn = rn0 THEN greatest(s, s0 + e - s) ELSE s END AS b, e FROM o WHERE rn <> rn0 OR s <> s0),
x AS (SELECT DISTINCT c.rn, c.i FROM r JOIN c ON c.rn = r.rn AND c.k >= r.b AND c.k < r.e),
n AS (SELECT l.rn, count(*) FILTER (l.w > 0) AS n_lines, count(x.i) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (x.i IS NULL) AS left_over FROM l LEFT JOIN x ON x.rn = l.rn AND x.i = l.i GROUP BY l.rn)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN coalesce(n_removed, 0) = 0 THEN text WHEN n_removed = n_lines THEN '' ELSE left_over END AS text FROM d LEFT JOIN n USING (rn)
"""


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_dup_classes(table(spark, sf_dir, "documents"))


def op10_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))

    def line(column: str) -> Column:
        return F.concat_ws(",", F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))

    def of(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\x0B\f]+') AS w FROM documents),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(min(w.doc_id) OVER (PARTITION BY t) < w.doc_id, min(w.doc_id) OVER (PARTITION BY t) IS NOT NULL) AS e,
    CAST(coalesce(good, FALSE) AS INT) AS good, CAST(coalesce(toxic, FALSE) AS INT) AS toxic
  FROM w LEFT JOIN l USING (doc_id)),
k AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails, good, toxic FROM m),
n AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM k GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS o FROM f p, f q, f r, f s, f t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
s AS (SELECT o, step, substr(o, CAST(step AS INT), 1) AS own, substr(o, 1, CAST(step AS INT) - 1) AS before FROM o, range(1, 6) AS g(step)),
x AS (
  SELECT part, n, n.good, n.toxic, o, step, contains(fails, own) AS hit, len(translate(fails, before, '')) < len(fails) AS gone, len(fails) AS size
  FROM n, s)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(sum(CASE WHEN hit OR gone THEN 0 ELSE n END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN hit AND size = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost, CAST(sum(CASE WHEN hit THEN n * 120 // size ELSE 0 END) AS BIGINT) AS shapley
FROM x GROUP BY part, o, step
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The crc32 of a feature byte by byte, from the table of its polynomial; each different feature once.
OP12_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY b) AS tab FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i : CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS g(b))),
d AS (
  SELECT 0 AS side, row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
g AS (
  SELECT side, rn, array_to_string(w[i : i + n - 1], ' ') AS f
  FROM (SELECT side, rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, range(1, 4) AS k(n) WHERE len(w) >= n)),
c AS (SELECT side, rn, f, count(*) AS n FROM g GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM c)),
b AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda i : CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
    lambda c, y : xor(c >> 8, tab[CAST(xor(c & 255, y) AS INT) + 1])), 4294967295) % 10000 AS bucket
  FROM h, tab),
e AS (SELECT side, rn, bucket, sum(n) AS n FROM c JOIN b USING (f) GROUP BY ALL),
s AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM e GROUP BY bucket),
z AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) + 10000 AS zs, CAST(coalesce(sum(t), 0) AS DOUBLE) + 10000 AS zt FROM s),
a AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * zs / ((CAST(s AS DOUBLE) + 1) * zt))) AS BIGINT) AS gain FROM s, z),
q AS (SELECT rn, sum(n) AS n_features, sum(n * gain) AS weight FROM e JOIN a USING (bucket) WHERE side = 0 GROUP BY rn),
r AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN q USING (rn) WHERE side = 0),
v AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM r),
u AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS nth, count(*) FILTER (n_words >= 20) OVER () AS total FROM v)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_words >= 20 AND nth <= 5 * total // 100 THEN nth END AS BIGINT) AS rank FROM u
"""


def op13_kmeans_tree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = kmeans_tree.neighbours(rows, rows.where("vec_id % 100 = 0"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_crf_quality, op2_decontaminate, op3_ppm_language, op4_lstm_main_text, op5_byte_bpe, op6_token_counts, op7_line_dedup, op8_order_minhash, op9_hash_tree_shards, op10_grammar_secrets, op11_filter_audit, op12_importance_resampling, op13_kmeans_tree_neighbours, pipeline)
}
ORACLE: dict[str, str] = {"op2_decontaminate": OP2_SQL, "op7_line_dedup": OP7_SQL, "op11_filter_audit": OP11_SQL, "op12_importance_resampling": OP12_SQL}
