"""Closures by path doubling and relaxation against a breadth-first search."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quarry.operators import operations as O


def brute(edges, starts):
    out, ahead = [], {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    for s in starts:
        depth, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v in ahead.get(u, ()):
                if v not in depth:
                    depth[v] = depth[u] + 1
                    queue.append(v)
        out += [(s, v, d) for v, d in depth.items()]
    return sorted(out)


def frame(spark, edges):
    return spark.createDataFrame(edges, "source long, target long")


def test_random_graphs_with_chains_rings_and_branches(spark):
    for seed in (1, 2):
        r, edges, top = random.Random(seed), [], 1000
        for _ in range(14):
            a, b, n = r.randrange(12), r.randrange(12), r.choice([0, 1, 2, 5, 9])
            way = [a, *range(top, top + n), b]
            top += n
            edges += list(zip(way, way[1:]))
        ring = [*range(5000, 5006), 5000]
        edges += list(zip(ring, ring[1:])) + [(3, 3), (None, 1), (edges[0])]
        clean = [e for e in edges if None not in e]
        starts = [0, 5, edges[3][0], 1003, 5002, 77]
        got = O.closure(frame(spark, edges), spark.createDataFrame([(s,) for s in starts], "node long"))
        assert sorted(map(tuple, got.collect())) == brute(clean, sorted(set(starts)))
        up = O.closure(frame(spark, edges), spark.createDataFrame([(s,) for s in starts], "node long"), downstream=False)
        assert sorted(map(tuple, up.collect())) == brute([(b, a) for a, b in clean], sorted(set(starts)))


def test_a_chain_of_a_thousand_takes_ten_rounds(spark, monkeypatch):
    rounds = []
    keep = O.written
    monkeypatch.setattr(O, "written", lambda df, label: rounds.append(label) or keep(df, label))
    chain = spark.range(1000).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    got = O.closure(chain, spark.createDataFrame([(0,)], "node long"))
    assert got.count() == 1001 and got.where("depth <> node").count() == 0
    assert rounds.count("ways") <= 2 * 11 + 2  # forwards and backwards
    with pytest.raises(ValueError, match="deeper than 998"):
        O.closure(chain, spark.createDataFrame([(0,)], "node long"), depth=998)
    assert O.closure(chain.limit(0), spark.createDataFrame([(0,)], "node long")).collect() == [(0, 0, 0)]
