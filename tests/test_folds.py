"""Ordered folds in blocks against plain loops: hot keys, ties, nulls, folds that never forget."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from quarry.operators import folds
from quarry.operators import operations as O


def hits(seed, n=4000):
    """Nine tenths of all hits are one user's."""
    r = random.Random(seed)
    return [(None if r.random() < 0.01 else "hot" if r.random() < 0.9 else f"u{r.randrange(5)}", r.choice(["free", "pro", "academic", None]), None if r.random() < 0.01 else float(r.randrange(3000)), i) for i in range(n)]


def by_loop(rows, limits, other):
    out, logs = [], {}
    for u, tier, t, i in sorted(rows, key=lambda x: (str(x[0]), str(x[1]), x[2] is not None, x[2], x[3])):
        limit = limits.get(tier, other)
        if limit is None:
            out.append((u, tier, i, True))
            continue
        log = [x for x in logs.get((u, tier), []) if t is not None and x is not None and x > t - limit[1]]
        ok = len(log) < limit[0]
        logs[u, tier] = log + [t] * ok
        out.append((u, tier, i, ok))
    return sorted(out, key=str)


def test_tiers_with_one_hot_key_in_many_blocks(spark):
    rows = hits(1)
    df = spark.createDataFrame(rows, "user string, tier string, t double, i long").repartition(7)
    limits = spark.createDataFrame([("free", 2, 50), ("pro", 7, 130), ("academic", None, None)], "tier string, most int, seconds int")
    want = by_loop(rows, {"free": (2, 50), "pro": (7, 130), "academic": None}, (3, 40))
    for block_rows in (10**6, 150):
        got = O.tiered_limit(df, limits, "user", "tier", "t", "i", 3, 40, block_rows).select("user", "tier", "i", "allowed").collect()
        assert sorted(map(tuple, got), key=str) == want
    alone = df.where("user = 'hot' AND tier = 'free'").select(F.lit("k").alias("k"), "t", "i").where("t IS NOT NULL")
    log = {r.i: r.allowed for r in O.sliding_log_limit(alone, "k", "t", "i", 50, 2).collect()}
    folded = {r.i: r.allowed for r in O.tiered_limit(alone.withColumn("x", F.lit("free")), limits, "k", "x", "t", "i", 3, 40, 100).collect()}
    assert folded == log


def test_one_pool_over_many_tasks(spark):
    r = random.Random(2)
    rows = [("p" if r.random() < 0.95 else "q", float(i * 7 + r.randrange(5)), i, None if r.random() < 0.02 else r.uniform(0, 100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "pool string, t double, i long, load double").repartition(5)
    want = []
    for pool in "pq":
        now, last = 1, None
        for p, t, i, v in rows:
            if p != pool:
                continue
            if v is not None and not (last is not None and t - last < 60):
                new = min(int(now * (v / 50.0)), 20) if v > 50 else max(now - 1, 1) if v < 35 and (last is None or t - last > 300) else now
                last = t if new != now else last
                now = new
            want.append((pool, i, now))
    for block_rows in (10**6, 100):
        assert sorted(map(tuple, O.autoscaled(df, "pool", "t", "i", "load", 50.0, 1, 20, block_rows=block_rows).collect())) == sorted(want)


def test_a_fold_that_never_forgets(spark):
    """A running sum needs a round for each block of its key, and still is exact."""
    rows = [(i % 2, i, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i long, x double")
    out = folds.folded(df, ("k",), ("i",), ("x",), lambda s, x: (s + x, s + x), 0.0, ("total", DoubleType()), ("i",), 12)
    sums, want = [0.0, 0.0], []
    for k, i, x in rows:
        sums[k] += x
        want.append((k, i, sums[k]))
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert folds.folded(df.limit(0), ("k",), ("i",), ("x",), lambda s, x: (s, x), 0.0, ("total", DoubleType()), ("i",)).collect() == []


def test_few_rows_are_objects_at_a_time(spark):
    """The memory that Python's objects of a block of 400,000 rows take, measured where it is folded, is that of a slice."""

    def step(state, x):
        import tracemalloc

        if state[0] == 0:
            tracemalloc.start()
        state = [state[0] + 1, max(state[1], tracemalloc.get_traced_memory()[0] >> 20 if state[0] % 1000 == 0 else 0)]
        if state[0] == 400_000:
            tracemalloc.stop()
        return state, state[1] if state[0] == 400_000 else state[0]

    df = spark.range(400_000).select(F.lit(1).alias("k"), "id", (F.col("id") * 1.5).alias("x"))
    out = folds.folded(df, ("k",), ("id",), ("x",), step, [0, 0], ("n", LongType()), ("id",))
    got = out.agg(F.count("*").alias("n"), F.sum(F.when(F.col("id") < 399_999, (F.col("n") != F.col("id") + 1).cast("int"))).alias("wrong"), F.max(F.when(F.col("id") == 399_999, F.col("n"))).alias("mb")).first()
    assert got.n == 400_000 and got.wrong == 0 and got.mb < 12
