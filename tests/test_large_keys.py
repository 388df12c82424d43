"""Limits and averages of one key with many rows, against plain loops."""

import random

from pyspark.sql import functions as F

from quarry.operators import operations as O
from quarry.streaming import stateful as S


def log_of(hits, seconds, most):
    logs, out = {}, {}
    for k, t, i in sorted(hits):
        log = [x for x in logs.get(k, []) if x > t - seconds]
        out[i] = len(log) < most
        logs[k] = log + [t] if out[i] else log
    return out


def test_ema_of_groups_over_many_blocks(spark):
    r = random.Random(1)
    rows = [(None if i % 10 == 0 else i % 3 // 2, i, r.random()) for i in range(3000)]
    want, last = {}, {}
    for k, i, x in rows:
        last[k] = want[i] = 0.95 * last[k] + (1 - 0.95) * x if k in last else x
    df = spark.createDataFrame(rows, "k long, i long, x double").repartition(5)
    for blocks in (1, 7, 64):
        got = {r.i: r.ema for r in O.ema(df, ("k",), "i", "x", blocks=blocks).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_ema_is_null_from_a_null_on(spark):
    df = spark.createDataFrame([(1, i, None if i == 5 else 1.0) for i in range(12)], "k long, i long, x double")
    assert [r.ema is None for r in O.ema(df, ("k",), "i", "x", blocks=4).orderBy("i").collect()] == [i >= 5 for i in range(12)]
    assert O.ema(df.limit(0), ("k",), "i", "x").collect() == []


def test_one_group_in_no_row(spark):
    hits = spark.range(100_000).select((F.col("id") % 2 * 0).alias("k"), (F.col("id") * 7919 % 100_003).cast("double").alias("t"), F.col("id").alias("i"))
    out = O.sliding_log_limit(hits, "k", "t", "i", 50, 3)
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert {r.i: r.allowed for r in out.collect()} == log_of([tuple(r) for r in hits.collect()], 50, 3)
    ema = O.ema(hits, ("k",), "t", "t")
    assert ema.count() == 100_000


def test_stream_of_a_key_beyond_memory_runs(spark, tmp_path):
    hits = spark.range(30_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 10_007).cast("double").alias("t"), F.col("id").alias("i"))
    hits.repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    got = S.drained(S.limited(S.stream_of(spark, str(tmp_path), "t"), "k", "t", "i", 50.0, 3, run_rows=1000))
    assert {r.i: r.allowed for r in got.collect()} == log_of([tuple(r) for r in hits.collect()], 50.0, 3)
