"""Importance resampling: weights and draws from their definition, dictionaries that start anew, odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import queries, resampling

from .. import oracle

SMALL = "/root/testdata/sf0.001"


def grams(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(w), [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(rows, target, buckets=10_000, least=20):
    counted = [(i, *grams(t)) for i, t in rows]
    s, t = (Counter(zlib.crc32(f) % buckets for g in side for f in g) for side in ([g for _, _, g in counted], [grams(x)[1] for x in target]))
    zs, zt = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, n, g in counted:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * zs / ((s[b] + 1) * zt))) for b in (zlib.crc32(f) % buckets for f in g))
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0]))
    drawn = [x[:1] + x[2:] + (k,) for k, x in enumerate(order[: 5 * len(order) // 100], 1)]
    rest = [x[:1] + x[2:] + (None,) for x in order[len(drawn) :] + [x for x in out if x[1] < least]]
    return drawn + rest


def same(got, want):
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünï", "ÀB", "x_y", "don't", "日本", "A1"]
    texts = [r.choice([" ", "  ", ", ", "\n"]).join(r.choices(vocabulary, k=r.choice([0, 1, 2, 3, 19, 20, 40, 200]))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (None, None), (7, texts[7]), (8, None), (9, ""), (10, "... --"), (11, "same " * 5000)]
    return rows, texts[:4] + [None, "", "w1 w2 w3 w1 w2 w3"]


def test_matches_the_definition(spark):
    for seed in (1, 2):
        rows, target = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 AS id", "2 AS score", "'x' AS RANK", "3 AS sums")
        bench = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
        got = resampling.resample(docs, bench)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        same(got.collect(), brute(rows, target))


def by_definition(self, tuples, buckets):
    mask = (1 << resampling.WORD_BITS) - 1
    ids = [[t >> resampling.WORD_BITS * i & mask for i in range(3)] for t in tuples.tolist()]
    return np.array([zlib.crc32(b" ".join(self.words[i] for i in t if i)) % buckets for t in ids], dtype=np.int64)


def test_a_dictionary_that_starts_anew_gives_the_same(spark, monkeypatch):
    rows, target = corpus(3)
    texts = [resampling.words(t) for _, t in rows]
    whole = resampling.counted(texts, resampling.Words(), 3, 10_000)
    parts = [resampling.counted([t], resampling.Words(), 3, 10_000) for t in texts]
    assert whole[0].tolist() == [int(p[0][0]) for p in parts]
    assert np.array_equal(whole[2], np.concatenate([p[2] for p in parts])) and np.array_equal(whole[3], np.concatenate([p[3] for p in parts]))
    for most in (4, 9, 50):  # pieces cut through runs, too
        monkeypatch.setattr(resampling, "MOST_WORDS", most)
        monkeypatch.setattr(resampling.Words, "buckets", by_definition)
        assert all(np.array_equal(a, b) for a, b in zip(whole, resampling.counted(texts, resampling.Words(), 3, 10_000)))


def test_each_distinct_tuple_is_hashed_once(monkeypatch):
    calls = []
    hashed = resampling.Words.buckets
    monkeypatch.setattr(resampling.Words, "buckets", lambda self, t, b: calls.append(len(t)) or hashed(self, t, b))
    per_row, *_ = resampling.counted([[b"a", b"b"] * 1000, [b"b", b"a"] * 1000], resampling.Words(), 3, 10_000)
    assert calls == [6] and per_row.tolist() == [5997, 5997]


def test_ranks_go_through_ranges(spark):
    """Many equal scores over many ranges: places follow the id, and none is missing."""
    scored = spark.range(2000).selectExpr("id", "IF(id % 3 = 0, 5L, id % 7) AS score", "id % 4 AS n_words")
    got = resampling.ranked(resampling.common.materialise(scored, "t"), F.col("n_words") > 0, 40).where("rank IS NOT NULL").orderBy("rank").collect()
    want = sorted(((-(5 if i % 3 == 0 else i % 7), i) for i in range(2000) if i % 4))[: 1500 * 40 // 100]
    assert [(r.rank, r.id) for r in got] == [(k, i) for k, (_, i) in enumerate(want, 1)]


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert resampling.resample(none, docs).collect() == []
    same(resampling.resample(docs, none).collect(), brute([(1, "a b")], []))


def test_query_matches_its_sql(spark):
    oracle.check(queries.op12_importance_resampling(spark, SMALL), queries.OP12_SQL, SMALL)
