"""Sharding by a hash tree: shares, movement and slots."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarry.llm import hash_tree
from quarry.llm.hash_tree import Topology


def place(spark, topology, n=20000):
    ids = spark.range(n).select(F.col("id").cast("string").alias("k"), "id")
    return {r.id: r.s for r in ids.select("id", hash_tree.descend(F.col("k"), topology).alias("s")).collect()}


def test_shares_follow_weights(spark):
    topology = Topology(tuple((s // 4, s // 2, s, 1.0 + s) for s in range(8)))
    got = Counter(place(spark, topology).values())
    for s in range(8):
        assert abs(got[s] / 20000 - (1 + s) / 36) < 0.015


def test_a_change_of_weight_moves_rows_only_in_and_out_of_its_subtree(spark):
    old = Topology.laid_out(20)
    new = Topology(tuple((*x[:3], 3.0) if x[2] == 3 else x for x in old.shards))
    before, after = place(spark, old), place(spark, new)
    moved = [(before[i], after[i]) for i in before if before[i] != after[i]]
    assert moved and all(b == 3 or b // 10 == 0 or a // 10 == 0 for b, a in moved)
    assert all(a // 10 == 0 for _, a in moved)  # more weight only draws rows in
    assert all(before[i] == after[i] for i in after if after[i] // 10 == 1)


def test_growth_fills_only_the_new_shard(spark):
    before, after = place(spark, Topology.laid_out(40)), place(spark, Topology.laid_out(40).grown())
    moved = {i: after[i] for i in before if before[i] != after[i]}
    assert set(moved.values()) == {40} and abs(len(moved) / len(before) - 1 / 41) < 0.01


def test_rows(spark):
    rows = [(i, f"text {i % 5} é", "x") for i in range(300)] + [(None, None, "y"), (None, "", "y")] + [(7, "text 2 é", "x")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = hash_tree.shard(docs, Topology.laid_out(4, 1, 2)).collect()
    assert len(got) == len(rows)
    slots, homes = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        homes[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and (r.grown_shard in (r.shard, 4))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert hash_tree.shard(docs.limit(0), Topology.laid_out(4)).count() == 0
