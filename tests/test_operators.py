"""Operators without a query of their own, and the hard cases of those with one."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quarry.functions import arrays as A
from quarry.functions import text as T
from quarry.operators import contracts as C
from quarry.operators import dedup, operations as O, ordering, sampling
from quarry.operators import statistics as S
from quarry.streaming import stateful


def reached(edges, start):
    depth, todo = {start: 0}, [start]
    for node in todo:
        for a, b in edges:
            if a == node and b not in depth:
                depth[b] = depth[node] + 1
                todo.append(b)
    return {(start, n, d) for n, d in depth.items()}


def test_closure_of_deep_graphs_with_cycles(spark):
    edges = [(i, i + 1) for i in range(14)] + [(14, 3), (5, 5), (2, 9), (20, 21), (None, 1)]
    df = spark.createDataFrame(edges, "source long, target long")
    starts = spark.createDataFrame([(0,), (20,), (99,), (0,)], "node long")
    got = {tuple(r) for r in O.closure(df, starts).collect()}
    assert got == reached(edges[:-1], 0) | reached(edges, 20) | {(99, 99, 0)}
    up = {tuple(r) for r in O.closure(df, spark.createDataFrame([(4,)], "node long"), downstream=False).collect()}
    assert up == reached([(b, a) for a, b in edges[:-1]], 4)
    with pytest.raises(ValueError, match="deeper"):
        O.closure(df, starts, depth=3)
    assert len(O.closure(df, starts)._jdf.queryExecution().analyzed().toString().splitlines()) < 5


def test_array_expressions_take_linear_time_and_share_values(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)]
    df = spark.createDataFrame(rows, "v array<double>")
    got = [tuple(r) for r in df.select(A.l2(F.col("v")), A.normalised(F.col("v")), A.entropy(F.col("v")), A.finite(F.col("v"))).collect()]
    assert np.allclose(got[0][0], [0.6, 0.8]) and got[0][1] == [0.75, 1.0] and got[1][1] == [0.0, 0.0] and got[2][:2] == ([], []) and got[3][0] is None
    assert got[2][3] is True and [x[2] for x in got[1:3]] == [0.0, 0.0]
    odd = spark.createDataFrame([([1.0, None],), ([math.nan],), ([math.inf],), ([-math.inf],)], "v array<double>")
    assert [r[0] for r in odd.select(A.finite(F.col("v"))).collect()] == [False] * 4
    plan = df.select(A.l2(F.col("v")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sqrt") == 1 or plan.count("SQRT") == 1
    assert [r[0] for r in df.select(A.fitted(F.col("v"), 3)).collect()] == [[3.0, 4.0, 0.0], [0.0] * 3, [0.0] * 3, None]


def test_quantiles_are_numpys(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.randint(0, 9) / 2, r.gauss(0, 1)])) for _ in range(700)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: [x for g, x in rows if g == k and x is not None] for k in ("a", "b", None)}
    got = {x.k: (x.lo, x.mid) for x in S.quantiles(df, "v", {"lo": 0.05, "mid": 0.5}, ("k",)).collect()}
    for k, values in want.items():
        assert np.allclose(got[k], np.percentile(values, [5, 50]))
    desc = {x.k: x for x in S.describe(df, "v", ("k",)).collect()}
    assert desc[None].n == len(want[None]) and abs(desc[None].q3 - np.percentile(want[None], 75)) < 1e-9
    assert S.quantiles(df.limit(0), "v", {"q": 0.5}).collect()[0].q is None
    assert S.psi_deciles(df.limit(0), df, "v").first().psi is None


def test_p_values(spark):
    assert abs(S.chi_square_p_value(4.0, 2) - math.exp(-2)) < 1e-12 and S.chi_square_p_value(0, 3) == 1.0
    assert abs(S.chi_square_p_value(3.841458820694124, 1) - 0.05) < 1e-9 and abs(S.chi_square_p_value(60.0, 30) - 0.00091) < 1e-4
    df = spark.createDataFrame([(0.1, 100, 100), (0.0, 5, 5), (0.9, 50, 70)], "d double, n long, m long")
    got = df.select(S.ks_p(F.col("d"), F.col("n"), F.col("m")).alias("p"), "d", "n", "m").collect()
    assert all(abs(r.p - S.ks_p_value(r.d, r.n, r.m)) < 1e-12 for r in got) and got[0].p > 0.6 and got[1].p == 1.0
    x = spark.createDataFrame([(4.0, 2), (None, 1)], "x double, k long").select(S.chi_square_p(F.col("x"), F.col("k")).alias("p")).collect()
    assert abs(x[0].p - math.exp(-2)) < 1e-9 and x[1].p is None


def test_first_rows_are_the_same_by_either_way(spark, monkeypatch):
    df = spark.range(3000)
    key = ordering.hash_order("id", seed=3)
    want = [r.id for r in sampling.first_n(df, key, 700, ("id",)).collect()]
    monkeypatch.setattr(sampling, "TOP_IN_ONE_TASK", 10)
    assert sorted(r.id for r in sampling.first_n(df, key, 700, ("id",)).collect()) == sorted(want)
    assert ordering.hash_digits(10**6) == 3 and ordering.hash_digits(10**11) == 4 and ordering.hash_digits(10**14) == 5


def test_range_buckets_halve_the_edges(spark):
    edges = sorted(random.Random(1).sample(range(100), 13))
    df = spark.createDataFrame([(float(x),) for x in range(-3, 103)] + [(None,)], "v double")
    got = df.select("v", ordering.range_bucket(F.col("v"), [float(e) for e in edges]).alias("b")).collect()
    assert all(r.b == (0 if r.v is None else sum(e <= r.v for e in edges)) for r in got)


def test_schema_contracts():
    a = StructType([StructField("id", LongType(), False), StructField("t", StringType(), True)])
    assert C.strict_schema_faults(a, a) == []
    want = StructType([StructField("id", LongType(), True), StructField("t", LongType(), True), StructField("x", LongType(), True)])
    assert C.strict_schema_faults(a, want) == ["id: expected nullable True, got False", "t: expected bigint, got string", "x: missing"]


def test_table_fingerprints_do_not_depend_on_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    one, two = (dedup.content_hash(x).first() for x in (df.repartition(7), df.orderBy(F.desc("v"))))
    assert one == two and dedup.content_hash(df.where("id < 99")).first() != one


def test_json_like_texts(spark):
    rows = ['{"distilled_response": "a"}', "{\"a\": 1}", "plain", "{oops}", None]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(T.looks_like_json(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False]


def test_observed_metrics_and_routed_alerts(spark, tmp_path):
    spark.range(10).withColumn("level", F.when(F.col("id") < 3, "high").otherwise("low")).withColumn("v", F.col("id").cast("double")).write.parquet(f"{tmp_path}/t.parquet")
    seen = {"high": 0}

    def count(df):
        seen["high"] += df.count()

    stream = stateful.observed(stateful.stream_of(spark, str(tmp_path), "t"), "measures", "v")
    query = stream.writeStream.foreachBatch(stateful.routed(None, {"high": count})).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen["high"] == 3
    assert query.lastProgress["observedMetrics"]["measures"] is not None
