"""Nearest neighbours by the k-means tree: recall and exact scores against brute force, copies, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import common, kmeans_tree as kt
from quarry.llm import queries


def brute(rows, queries_, n=10):
    """{query: [(distance, id)]} in doubles. rows: (id, vector)."""
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q, v in queries_:
        d = np.sqrt(((x - np.array(v, dtype=np.float64)) ** 2).sum(1))
        out[q] = sorted((a, i) for a, i in zip(d.tolist(), ids) if i != q)[:n]
    return out


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, r.id))
    return out


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_all_leaves_are_exact(spark):
    """With a recall of 1 asked for and every query calibrated with, nothing is missed: ties by id, distances as from the original values."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(size=(300, 6)), r.integers(0, 2, size=(300, 6)) + 0.5]).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = by_query(kt.neighbours(table, table.where("vec_id % 5 = 0"), recall=1.0, leaf_rows=20).collect())
    want = brute(rows, [x for x in rows if x[0] % 5 == 0])
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-14, atol=0)


def test_traversal_takes_the_nearest_open_cell():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 4))
    tree = kt.Tree(x, 25, branch=4)
    assert tree.leaves > 40
    leaves = tree.leaf(x)
    assert {c for c, (a, b) in enumerate(tree.children) if a == b} >= set(leaves.tolist())
    q, seen, queue = r.normal(size=4), [], {0: 0.0}
    while queue:
        cell = min(queue, key=lambda c: (queue[c], c))
        del queue[cell]
        a, b = tree.children[cell]
        if a == b:
            seen.append(cell)
        queue |= {c: ((tree.centres[c] - q) ** 2).sum() for c in range(a, b)}
    assert tree.visits(q, tree.leaves) == seen and tree.visits(q, 5) == seen[:5] and len(seen) == tree.leaves


def test_recall_of_the_query_on_the_documents_vectors(spark):
    """The registered query at sf0.1, all of its rows against brute force over all vectors."""
    table = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found = queries.op13_kmeans_tree_neighbours(spark, "/root/testdata/sf0.1").withColumnRenamed("vec_id", "id").collect()
    want, got = brute(rows, [x for x in rows if x[0] % 100 == 0]), by_query(found)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for r in found:
        assert r.rank == 1 + [i for _, i in got[r.query_id]].index(r.id)
        assert abs(r.score - np.sqrt(((vectors[r.query_id] - vectors[r.id]) ** 2).sum())) < 1e-12


def test_many_copies_are_one_entry(spark):
    """A vector that a third of the rows have: the least ids are its neighbours, no leaf holds the copies, each query is answered."""
    r = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else v) for i, v in enumerate(r.normal(size=(3000, 3)).tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    index = kt.Index(kt.clean(table, "vec_id", "embedding"), 11)
    assert index.entries.count() == 2001 and index.entries.agg(F.max(F.size("ids"))).first()[0] == 11
    got = by_query(kt.neighbours(table, table.where("vec_id % 100 = 0"), recall=1.0).collect())
    want = brute(rows, [x for x in rows if x[0] % 100 == 0])
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_blocks_and_slots_change_nothing(spark, monkeypatch):
    r = np.random.default_rng(4)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(r.normal(size=(800, 5)).tolist())], "vec_id long, embedding array<double>")
    plain = sorted(map(tuple, kt.neighbours(table, leaf_rows=100, recall=0.95).collect()))
    monkeypatch.setattr(kt, "BLOCK_ROWS", 30), monkeypatch.setattr(kt, "SLOT_ROWS", 25), monkeypatch.setattr(kt, "CELLS", 500)
    assert sorted(map(tuple, kt.neighbours(table, leaf_rows=100, recall=0.95).collect())) == plain


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [-0.0, 1.0]), (0, [1.0, 0.0]), (100, [5.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS leaf", "3 AS v", "4 AS KEY")
    got = by_query(kt.neighbours(table, table.where("vec_id % 100 = 0")).collect())
    assert {q: [i for _, i in v] for q, v in got.items()} == {0: [1, 10, 100], 100: [0, 1, 10]}
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    for few in (alone, alone.limit(0)):
        out = kt.neighbours(few, few.where("vec_id % 100 = 0"))
        assert out.collect() == [] and out.columns == ["query_id", "rank", "id", "score"]
    assert kt.neighbours(table, table.where("vec_id = 7")).collect() == []
