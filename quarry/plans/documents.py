"""Queries over documents: filters, flags, deduplication, sampling, chunking, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, filters, sampling
from ..operators import statistics as S
from ..operators.ordering import hash_order
from .common import Registry, table

R = Registry()
BAD = ("http", "@")


def _judged(spark, d):
    return filters.quality_filter(table(spark, d, "documents"), patterns=BAD, min_length=80)


_JUDGED_SQL = """WITH a AS (SELECT doc_id, text, CASE WHEN text IS NULL OR strlen(text) < 80 THEN 'length' WHEN contains(text, 'http') OR contains(text, '@') THEN 'pattern' END AS r FROM documents),
f AS (SELECT text, min(doc_id) AS first FROM a WHERE r IS NULL GROUP BY text),
j AS (SELECT a.doc_id, a.text, coalesce(r, CASE WHEN a.doc_id <> f.first THEN 'dedup' END) AS reject_reason FROM a LEFT JOIN f ON a.text = f.text AND a.r IS NULL) """


@R.add(_JUDGED_SQL + "SELECT doc_id FROM j WHERE reject_reason IS NULL")
def doc_quality_filter(spark, d):
    return _judged(spark, d).where("reject_reason IS NULL").select("doc_id")


@R.add(_JUDGED_SQL + "SELECT doc_id, reject_reason FROM j WHERE reject_reason IS NOT NULL")
def doc_filter_rejects(spark, d):
    return _judged(spark, d).where("reject_reason IS NOT NULL").select("doc_id", "reject_reason")


@R.add(_JUDGED_SQL + "SELECT count(*) AS total, count(*) FILTER (reject_reason IS NULL) AS kept, count(*) FILTER (reject_reason = 'length') AS rejected_length, count(*) FILTER (reject_reason = 'pattern') AS rejected_pattern, count(*) FILTER (reject_reason = 'dedup') AS rejected_dedup FROM j")
def doc_filter_stats(spark, d):
    return filters.filter_stats(_judged(spark, d))


@R.add(_JUDGED_SQL + ", c AS (SELECT reject_reason, count(*) AS n FROM j WHERE reject_reason IS NOT NULL GROUP BY 1) SELECT reject_reason, n, round(100.0 * n / sum(n) OVER (), 2)::DOUBLE AS pct FROM c")
def doc_reject_counts(spark, d):
    return filters.reason_counts(_judged(spark, d), "reject_reason")


@R.add("SELECT (strlen(text) // 100) * 100 AS bucket, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def doc_length_histogram(spark, d):
    return filters.length_histogram(table(spark, d, "documents"))


@R.add("SELECT doc_id, CASE WHEN strlen(text) < 200 THEN 'TooShort' WHEN strlen(text) > 20000 THEN 'TooLong' WHEN contains(lower(text), 'disgusting') OR contains(lower(text), 'pathetic') THEN 'ContainsBadWord' END AS reason FROM documents")
def doc_typed_reasons(spark, d):
    return table(spark, d, "documents").select("doc_id", filters.typed_reason(F.col("text"), 200, 20000, ("disgusting", "pathetic")).alias("reason"))


_VERBS = "the|and|than|with|der|que"
_SQUEEZE = r"trim(regexp_replace(coalesce(text, ''), '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"
_FLAGS_SQL = rf"""WITH s AS (SELECT doc_id, {_SQUEEZE} AS t FROM documents),
f AS (SELECT doc_id, length(t) >= 120 AS length_char_ok, ceil(length(t) / 4.0) >= 80 AS length_token_ok, regexp_matches(lower(t), '(^|[^\p{{L}}\p{{M}}\p{{N}}_])({_VERBS})($|[^\p{{L}}\p{{M}}\p{{N}}_])') AS action_verb_ok, NOT regexp_matches(t, '(?i)(\[[0-9]{{1,3}}\]|\(ref\)|doi:\S+|arxiv:\d+)') AS no_citations FROM s) """


@R.add(_FLAGS_SQL + "SELECT *, length_char_ok AND length_token_ok AND action_verb_ok AND no_citations AS passes_all FROM f")
def doc_heuristic_flags(spark, d):
    return filters.heuristic_flags(table(spark, d, "documents"), verbs=tuple(_VERBS.split("|"))).select("doc_id", "length_char_ok", "length_token_ok", "action_verb_ok", "no_citations", "passes_all")


@R.add(_FLAGS_SQL + "SELECT count(*) AS total, count(*) FILTER (p) AS passed, round(count(*) FILTER (p) / count(*), 4) AS pass_rate FROM (SELECT length_char_ok AND length_token_ok AND action_verb_ok AND no_citations AS p FROM f)")
def doc_pass_summary(spark, d):
    return filters.pass_summary(filters.heuristic_flags(table(spark, d, "documents"), verbs=tuple(_VERBS.split("|"))))


@R.add("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY coalesce(text, '')")
def doc_exact_dedup(spark, d):
    return dedup.exact_dedup(table(spark, d, "documents"))


@R.add("SELECT count(*) AS total, count(DISTINCT coalesce(text, '')) AS distinct_texts, (SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY coalesce(text, '') HAVING count(*) > 1)) AS groups, count(*) - count(DISTINCT coalesce(text, '')) AS duplicates, round((count(*) - count(DISTINCT coalesce(text, ''))) / count(*), 6) AS duplicate_rate FROM documents")
def doc_dedup_report(spark, d):
    return dedup.dedup_report(table(spark, d, "documents"))


@R.add("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def doc_duplicate_keys(spark, d):
    return dedup.duplicate_keys(table(spark, d, "documents"), ("source", "lang"))


@R.add("SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r = 1")
def doc_keep_first(spark, d):
    return dedup.keep_first(table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars"), ("source", "lang"), ("n_chars", "doc_id"))


@R.add("SELECT doc_id, s AS start, substr(text, s + 1, 2000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 1600)) AS s FROM documents WHERE length(text) > 0)")
def doc_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.inline(T.chunks(F.col("text"), 2000, 1600))).select("doc_id", F.col("start").cast("long").alias("start"), "chunk")


_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\x0B\f]+'))"


@R.add(f"SELECT lang, count(*) AS n, avg(w) AS mean_words, median(w) AS median_words, min(w) AS min_words, max(w) AS max_words FROM (SELECT lang, {_WORDS} AS w FROM documents) WHERE w > 0 GROUP BY lang")
def doc_word_stats(spark, d):
    w = table(spark, d, "documents").select("lang", T.word_count(F.col("text")).alias("w")).where("w > 0")
    out = S.describe(w, "w", ("lang",))
    return out.select("lang", "n", F.col("mean").alias("mean_words"), F.col("median").alias("median_words"), F.col("min").cast("long").alias("min_words"), F.col("max").cast("long").alias("max_words"))


@R.add("SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE CAST(ceil(length(text) / 4.0) AS BIGINT) END AS tokens FROM documents")
def doc_token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def _any_sql(words, column="lower(coalesce(text, ''))"):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@R.add(f"SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 10 THEN 'empty_output' WHEN {_any_sql(T.UNSAFE)} THEN 'unsafe_content' END AS reason, {_any_sql(T.MEASURABLE)} AS measurable, {_any_sql(T.ACTIONABLE)} AS actionable, {_any_sql(T.FLUFF)} AS fluff FROM documents")
def doc_keyword_safety(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", filters.drop_reason(t).alias("reason"), T.contains_any(t, T.MEASURABLE).alias("measurable"), T.contains_any(t, T.ACTIONABLE).alias("actionable"), T.contains_any(t, T.FLUFF).alias("fluff"))


def _class_sql():
    cases = " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join('(?:' + p + ')' for p in ps)}') THEN '{n}'" for n, ps in T.PROMPT_CLASSES)
    return f"SELECT item_id, CASE {cases} ELSE 'hybrid' END AS class FROM benchmark"


@R.add(_class_sql())
def benchmark_prompt_class(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.prompt_class(F.col("text")).alias("class"))


_WHITE = r"[ \t\n\x0B\f\r]"


def _parts_sql(t: str) -> str:
    return rf"string_split(regexp_replace({t}, '([.!?]){_WHITE}+', '\1' || chr(1), 'g'), chr(1))"


def _sentences_sql(t: str) -> str:
    return f"list_filter(list_transform({_parts_sql(f'trim({t})')}, lambda p: trim(p)), lambda p: length(p) > 0)"


def _ended_sql(t: str) -> str:
    return f"CASE WHEN {t} <> '' AND NOT regexp_matches({t}, '[.!?]$') THEN {t} || '.' ELSE {t} END"


_DISTILLED = rf"""WITH d0 AS (SELECT doc_id, trim(coalesce(text, '')) AS t FROM documents),
d1 AS (SELECT doc_id, t, trim(replace(replace(replace(regexp_extract(t, '(?s)"distilled_response"{_WHITE}*:{_WHITE}*"([^"]+(?:\\.[^"]*)*)"', 1), '\n', chr(10)), '\"', '"'), '\/', '/')) AS quoted, trim(trim(regexp_extract(t, '(?s)"distilled_response"{_WHITE}*:{_WHITE}*([^,}}]+)', 1)), '"') AS bare,
trim(regexp_replace(t, '(?i)\*\*Distilled Response\*\*{_WHITE}*|\*\*Reasoning\*\*{_WHITE}*|Distilled Response{_WHITE}*|Reasoning{_WHITE}*', '', 'g')) AS plain FROM d0),
d AS (SELECT doc_id, coalesce(nullif(quoted, ''), nullif(bare, ''), plain) AS t FROM d1), """
_CUT = f"""c0 AS (SELECT doc_id, t, {_parts_sql("t")} AS ps FROM found),
c1 AS (SELECT doc_id, t, array_to_string(ps[1 : len(list_filter(range(1, len(ps) + 1), lambda k: list_sum(list_transform(ps[1:k], lambda x: length(x) + 1)) <= 600))], ' ') AS j FROM c0)
SELECT doc_id, CASE WHEN length(t) > 600 THEN {_ended_sql("j")} ELSE t END AS text FROM c1"""


def _said(words, x="x"):
    return _any_sql(words, f"lower({x})")


@R.add(rf"WITH p AS (SELECT doc_id, trim(coalesce(text, '')) AS t, {_sentences_sql("coalesce(text, '')")} AS s FROM documents), c AS (SELECT doc_id, t, s, regexp_replace(array_to_string(s[1:3], ' '), '{_WHITE}*\.\.\.{_WHITE}*$', '') AS j FROM p) SELECT doc_id, CASE WHEN len(s) > 3 THEN {_ended_sql('j')} ELSE t END AS text FROM c")
def doc_first_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", T.first_sentences(F.col("text")).alias("text"))


@R.add(
    _DISTILLED
    + f"""s AS (SELECT doc_id, list_filter({_sentences_sql("t")}, lambda x: NOT {_said(T.FLUFF)} AND ({_said(T.MEASURABLE)} OR {_said(T.ACTIONABLE)}) AND NOT {_said(T.KNOWN_FACTS)}) AS clean FROM d),
h AS (SELECT doc_id, clean, list_filter(clean[1:6], lambda x: {_said(T.TESTABLE)} OR ({_said(T.MEASURABLE)} AND {_said(T.ACTIONABLE)})) AS testable FROM s),
b AS (SELECT doc_id, array_to_string(CASE WHEN len(testable) >= 3 THEN testable[1:3] ELSE clean[1:3] END, ' ') AS j FROM h),
found AS (SELECT doc_id, trim({_ended_sql("j")}) AS t FROM b), """
    + _CUT
)
def doc_hypotheses(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cut_at_sentence(T.hypothesis(F.col("text"))).alias("text"))


_SCORE = " + ".join([f"CASE WHEN {_said(T.ACTIONABLE)} THEN 1 ELSE 0 END", *(f"CASE WHEN {_said(g)} THEN 2 ELSE 0 END" for g in T.METHOD_GROUPS)])


@R.add(
    _DISTILLED
    + f"""l0 AS (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda p: trim(p)), lambda p: length(p) > 0) AS ls FROM d),
l AS (SELECT doc_id, CASE WHEN len(ls) = 1 THEN {_sentences_sql("t")} ELSE ls END AS ls FROM l0),
s AS (SELECT doc_id, ls, list_transform(ls, lambda x, i: {{'s': -({_SCORE}), 'i': i, 'line': x, 'f': {_said(T.FLUFF)}}}) AS sc FROM l),
b AS (SELECT doc_id, ls, list_transform(list_sort(list_filter(sc, lambda e: e.s < 0 AND NOT e.f))[1:6], lambda e: e.line) AS best FROM s),
f AS (SELECT doc_id, ls, best, list_filter(ls, lambda x: NOT list_contains(best, x)) AS rest FROM b),
found AS (SELECT doc_id, trim(array_to_string(CASE WHEN len(best) < 4 AND len(ls) >= 4 THEN list_concat(best, rest[1 : 4 - len(best)]) ELSE best END, chr(10))) AS t FROM f), """
    + _CUT
)
def doc_methods(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cut_at_sentence(T.methodology(F.col("text"))).alias("text"))


@R.add("SELECT doc_id FROM (SELECT doc_id, md5(concat_ws('|', '', doc_id)) AS k FROM documents) ORDER BY k, doc_id LIMIT 100")
def doc_hash_top_n(spark, d):
    return sampling.first_n(table(spark, d, "documents").select("doc_id"), hash_order("doc_id"), 100, ("doc_id",))


@R.add("SELECT doc_id, source, lang FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY md5(concat_ws('|', '7', doc_id)), doc_id) AS r FROM documents) WHERE r <= 3")
def doc_stratified(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "source", "lang"), ("source", "lang"), ("doc_id",), 3, seed=7)


@R.add("SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) AS position FROM documents")
def doc_shuffled(spark, d):
    return sampling.shuffled(table(spark, d, "documents").select("doc_id"), ("doc_id",))


def _split_sql(first, second):
    return f"""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN p <= {first} THEN 'train' WHEN p <= {first} + {second} THEN 'val' ELSE 'test' END AS split FROM o"""


_W = {"train": 0.8, "val": 0.1, "test": 0.1}


@R.add(_split_sql("floor(n * 0.8 + 0.5)", "floor(n * 0.1 + 0.5)"))
def doc_split_rounded(spark, d):
    return sampling.split(table(spark, d, "documents").select("doc_id"), ("doc_id",), _W)


@R.add(_split_sql("floor(n * 0.8 + 1e-9)", "floor(n * 0.1 + 1e-9)"))
def doc_split_floor_first(spark, d):
    return sampling.split(table(spark, d, "documents").select("doc_id"), ("doc_id",), _W, "floor_first")


@R.add("SELECT split, count(*) AS n FROM (" + _split_sql("(n - 2 * floor(n * 0.1 + 1e-9))", "floor(n * 0.1 + 1e-9)") + ") GROUP BY split")
def doc_split_sizes(spark, d):
    return sampling.split(table(spark, d, "documents").select("doc_id"), ("doc_id",), _W, "floor_last").groupBy("split").agg(F.count("*").alias("n"))


def _mix_sql():
    one = "SELECT * FROM (SELECT doc_id, '{l}' AS part FROM documents WHERE lang = '{l}' ORDER BY md5(concat_ws('|', 'mix', doc_id)), doc_id LIMIT {n})"
    return " UNION ALL ".join(one.format(l=k, n=n) for k, n in sampling.quotas(200, {"en": 0.6, "fr": 0.3, "es": 0.1}).items())


@R.add(_mix_sql())
def doc_mix(spark, d):
    docs = table(spark, d, "documents")
    parts = {k: (docs.where(F.col("lang") == k).select("doc_id"), r) for k, r in {"en": 0.6, "fr": 0.3, "es": 0.1}.items()}
    return sampling.mix(parts, 200, ("doc_id",), "mix")


@R.add("SELECT doc_id, CASE WHEN u < 0.5 THEN 'a' WHEN u < 0.8 THEN 'b' ELSE 'c' END AS dataset FROM (SELECT doc_id, ('0x' || substr(md5(concat_ws('|', '1', doc_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)")
def doc_weighted_choice(spark, d):
    return sampling.weighted_choice(table(spark, d, "documents").select("doc_id"), ("doc_id",), {"a": 0.5, "b": 0.3, "c": 0.2}, 1)


@R.add("""WITH t AS (SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE ceil(length(text) / 4.0) END AS BIGINT) AS tokens, md5(concat_ws('|', '3', doc_id)) AS k FROM documents),
c AS (SELECT doc_id, tokens, CAST(sum(tokens) OVER (ORDER BY k, doc_id) AS BIGINT) AS e FROM t)
SELECT doc_id, tokens, (e - tokens) // 2048 AS first_pack, (e - tokens) % 2048 AS "offset", greatest(e - 1, e - tokens) // 2048 AS last_pack FROM c""")
def doc_pack_sequences(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sampling.pack(docs, T.token_estimate(F.col("text")), 2048, hash_order("doc_id", seed=3), ("doc_id",)).select("doc_id", "tokens", "first_pack", "offset", "last_pack")


@R.add("SELECT item_id, repeat FROM (SELECT item_id, unnest(range(0, 10)) AS repeat FROM benchmark) ORDER BY repeat, item_id LIMIT 100")
def benchmark_tiled(spark, d):
    return sampling.tiled(table(spark, d, "benchmark").select("item_id"), 100, ("item_id",)).select("item_id", F.col("repeat").cast("long").alias("repeat"))


@R.add("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 20")
def doc_page(spark, d):
    return sampling.page(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.asc("doc_id")], 20, 50)


@R.add("SELECT lang, source, n, n / sum(n) OVER (PARTITION BY lang) AS share FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)")
def doc_source_shares(spark, d):
    return S.shares(table(spark, d, "documents"), ("source",), ("lang",))


@R.add("SELECT d.doc_id, d.text FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def doc_resume_anti(spark, d):
    return dedup.remaining(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"), "doc_id")


@R.add("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'label' ELSE d.source END AS source, l.doc_id IS NOT NULL AS regenerated FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l USING (doc_id)")
def doc_update_join(spark, d):
    new = table(spark, d, "labels").where("quality = 0").select("doc_id", F.lit("label").alias("source"))
    return dedup.update_from(table(spark, d, "documents").select("doc_id", "source"), new, ("doc_id",), ("source",))


@R.add("SELECT doc_id, CAST(quality AS BIGINT) AS value FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def doc_upsert(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.lit(-1).cast("long").alias("value"))
    return dedup.upsert(old, table(spark, d, "labels").where("quality = 1").select("doc_id", F.col("quality").cast("long").alias("value")), ("doc_id",))


_PAYLOAD = "CASE doc_id % 5 WHEN 0 THEN '{\"distilled_response\": \"a b\", \"x\": 1}' WHEN 1 THEN '**Distilled Response** first part' || chr(10) || chr(10) || 'rest' WHEN 2 THEN '{\"instruction\": 1' WHEN 3 THEN 'see distilled response below **end**' ELSE coalesce(text, '') END"


@R.add("SELECT doc_id, doc_id % 5 = 0 AS like_json FROM documents")
def doc_json_like(spark, d):
    return table(spark, d, "documents").select("doc_id", T.looks_like_json(F.expr(_PAYLOAD)).alias("like_json"))


@R.add(f"SELECT doc_id, sha256(CASE doc_id % 5 WHEN 1 THEN 'first part' WHEN 3 THEN 'below' ELSE trim({_PAYLOAD}) END) AS section FROM documents")
def doc_section(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.section(F.expr(_PAYLOAD)), 256).alias("section"))


@R.add("SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 AND text <> '' THEN text WHEN doc_id % 3 < 2 THEN source || chr(10) || lang ELSE 'user: ' || source || chr(10) || 'assistant: ' || lang END) AS content FROM documents")
def doc_resolved_content(spark, d):
    k = F.col("doc_id")
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("source").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("lang").alias("content")))
    t = table(spark, d, "documents").select("doc_id", F.when(k % 3 == 0, F.col("text")).alias("text"), F.when(k % 3 < 2, F.col("source")).alias("prompt"), F.col("lang").alias("response"), turns.alias("messages"))
    return t.select("doc_id", F.sha2(filters.resolved_content(t), 256).alias("content"))


@R.add("""WITH o AS (SELECT 'shard-' || lpad(doc_id::VARCHAR, 9, '0') AS shard FROM documents), p AS (SELECT shard, row_number() OVER (ORDER BY md5(concat_ws('|', '42', shard)), shard) AS p, count(*) OVER () AS n FROM o)
SELECT shard, CASE WHEN p <= floor(n * 0.98 + 0.5) THEN 'train' WHEN p <= floor(n * 0.98 + 0.5) + floor(n * 0.01 + 0.5) THEN 'val' ELSE 'test' END AS split FROM p""")
def shard_split(spark, d):
    names = table(spark, d, "documents").select(F.concat(F.lit("shard-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("shard"))
    return sampling.split(names, ("shard",), {"train": 0.98, "val": 0.01, "test": 0.01})


@R.add("SELECT doc_id, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS occurrence FROM documents")
def doc_occurrences(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return dedup.occurrence(t, ("digest",), ("doc_id",)).select("doc_id", F.col("occurrence").cast("long").alias("occurrence"))
