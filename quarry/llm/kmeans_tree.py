"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

1. Tree. k-means of `BRANCH` centres on a bounded sample of the vectors, then on each cell's part of the sample again, until cells hold few enough.
   The tree is small and goes to every task.
2. Index. Every vector goes down to the nearest child at each level; its leaf is stored beside it. Equal vectors are one entry with their least
   ids, as many as a result can name, so that a vector with very many copies is no large leaf. Leaves side by side in the tree share a block of
   at most `BLOCK_ROWS` entries; a larger leaf is cut into blocks by hash.
3. Traversal. A priority queue holds cells by distance of their centre from the query; the nearest one is opened, its children are pushed, and
   leaves are visited in the order in which they come up.
4. Calibration. A bounded sample of the queries is answered by brute force over all vectors, in one pass. For each true neighbour the traversal
   says as how manyth leaf its own comes up; the number of visits is widened, by an eighth each time, until the share found reaches `recall`.
5. Search. A query goes once to each block that holds leaves of its visits, with their list, and meets those leaves' entries alone; the queries of a
   block that many visit are dealt into slots. Each block and slot gives the nearest few of each query, and those are merged by query.

Distances are Euclidean, in doubles, from the original values; ties go to the smaller id. Equal query vectors are searched once.

Cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, neither do rows without an id, nor vectors of
another length than the most frequent one (the shorter of equally frequent ones). Rows of equal id and vector count once; a query is no neighbour of
rows with its own id. With fewer candidates than asked for, all are returned. Other columns do not matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

NEAREST, EVERY, RECALL = 10, 100, 0.97
BRANCH, LEAF_ROWS, MOST_LEAVES, ROUNDS = 16, 128, 8192, 8
#: Bytes of the sample that the tree is fitted on, and the queries that the visits are calibrated with.
SAMPLE_BYTES, SAMPLE_PER_LEAF, PROBES = 64 << 20, 40, 256
#: Entries of a block and queries that meet in one group.
BLOCK_ROWS, SLOT_ROWS = 4096, 2048
#: Numbers of a distance matrix at a time.
CELLS = 1 << 21


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from those of y, by the product of the two: near, not exact."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    for at in range(0, len(x), step := max(1, CELLS // len(centres))):
        out[at : at + step] = squares(x[at : at + step], centres).argmin(1)
    return out


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of at most k cells, none of them empty."""
    centres = x[np.sort(rng.choice(len(x), k, replace=False))]
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, x)
        centres = sums[n > 0] / n[n > 0, None]
    return centres


class Tree:
    """Cells in arrays: a cell's centre, and its children, which lie side by side (none for a leaf). Cell 0 is the root."""

    def __init__(self, sample: np.ndarray, leaf_rows: int, branch: int = BRANCH, seed: int = 7):
        """Cells of more than leaf_rows sample vectors are split."""
        rng = np.random.default_rng(seed)
        centres, children, parts = [sample.mean(0) if len(sample) else np.zeros(0)], [(0, 0)], [np.arange(len(sample))]
        cell = 0
        while cell < len(centres):
            part = parts[cell]
            if len(part) > leaf_rows:
                own = k_means(sample[part], min(branch, -(-2 * len(part) // leaf_rows), len(part)), rng)
                if len(own) > 1:
                    of = nearest_centre(sample[part], own)
                    children[cell] = (len(centres), len(centres) + len(own))
                    for i, c in enumerate(own):
                        centres.append(c), children.append((0, 0)), parts.append(part[of == i])
            parts[cell] = part[:0]
            cell += 1
        self.centres, self.children = np.array(centres), children
        self.leaves = sum(a == b for a, b in children)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out, open_ = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while open_:
            cell, rows = open_.pop()
            a, b = self.children[cell]
            if a == b:
                out[rows] = cell
            elif len(rows):
                own = nearest_centre(x[rows], self.centres[a:b])
                open_ += [(a + i, rows[own == i]) for i in range(b - a)]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first leaves that come up for a query."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, cell = heapq.heappop(queue)
            a, b = self.children[cell]
            if a == b:
                out.append(cell)
            else:
                gap = self.centres[a:b] - q
                for d, child in zip(np.einsum("ij,ij->i", gap, gap).tolist(), range(a, b)):
                    heapq.heappush(queue, (d, child))
        return out


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long vectors as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(q: np.ndarray, x: np.ndarray, ids: list[list[int]], n: int) -> list[list[tuple[float, int]]]:
    """Of each query the n nearest (distance, id), ties by id. Products of matrices leave few rows, whose distances are then taken exactly."""
    out = []
    scale = float((x * x).sum(1).max(initial=0))
    for at in range(0, len(q), step := max(1, CELLS // max(1, len(x)))):
        part = q[at : at + step]
        d2 = squares(part, x)
        cut = np.partition(d2, n - 1, axis=1)[:, n - 1] if len(x) > n else np.full(len(part), np.inf)
        cut = cut + 1e-9 * (scale + (part * part).sum(1) + 1e-300)
        for i in range(len(part)):
            near = np.flatnonzero(d2[i] <= cut[i])
            exact = np.sqrt(((x[near] - part[i]) ** 2).sum(1))
            found = sorted((d, v) for d, j in zip(exact.tolist(), near.tolist()) for v in ids[j])
            out.append(found[:n])
    return out


def clean(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): the rows that take part, v in doubles."""
    v = F.col("v")
    rows = table.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    rows = rows.where(F.size("v") == (size[0]["size"] if size else 0))
    return rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero


def vector_key(v: str) -> Column:
    return F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit("vector"), v).alias("b"))


def entries(rows: DataFrame, n: int) -> DataFrame:
    """(key, v, ids): each different vector with the least n ids that have it. Each task keeps n rows of a vector before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    keyed = rows.select("id", "v", vector_key("v").alias("key"))
    few = keyed.withColumn("nth", nth).where(F.col("nth") <= n)
    return few.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("id")).alias("ids"))


class Index:
    """The tree, the stored entries (a, b, v, ids, leaf), and the blocks of each leaf."""

    def __init__(self, rows: DataFrame, n: int, leaf_rows: int = LEAF_ROWS, most_leaves: int = MOST_LEAVES, sample_bytes: int = SAMPLE_BYTES):
        spark = common.text_batches(rows.sparkSession)
        distinct = common.materialise(entries(rows, n), "vectors")
        self.rows, head = distinct.count(), distinct.select(F.size("v")).head(1)
        self.width = head[0][0] if head else 0
        leaves = max(1, min(most_leaves, self.rows // leaf_rows))
        size = min(self.rows, leaves * SAMPLE_PER_LEAF, sample_bytes // (8 * max(1, self.width)))
        sample = common.least_by_hash(distinct.select(F.col("key").cast("string").alias("k"), "v"), size, "k").select("v").toArrow() if size else None
        self.tree = Tree(matrix(sample["v"]) if size else np.zeros((0, 0)), max(1, size // leaves))
        self.shared = spark.sparkContext.broadcast(self.tree)
        shared, names = self.shared, ["a", "b", "v", "ids", "leaf"]

        def descend(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.leaf(matrix(batch.column(2))), pa.int64())], names)

        kinds = f"a long, b long, v array<double>, ids {distinct.schema['ids'].dataType.simpleString()}, leaf long"
        self.entries = common.materialise(distinct.select("key.a", "key.b", "v", "ids").mapInArrow(descend, kinds), "leaves")
        self.blocks = blocks_of({r[0]: r[1] for r in self.entries.groupBy("leaf").count().collect()})  # a row per leaf of the tree


def blocks_of(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """leaf: (its first block, how many it is cut into). Small leaves are put together in the tree's order."""
    out: dict[int, tuple[int, int]] = {}
    block = filled = 0
    for leaf, n in sorted(sizes.items()):
        if filled and filled + n > BLOCK_ROWS:
            block, filled = block + 1, 0
        out[leaf] = (block, max(1, -(-n // BLOCK_ROWS)))
        block, filled = (block, filled + n) if n <= BLOCK_ROWS else (block + out[leaf][1], 0)
    return out


def truth(probes: np.ndarray, index: Index, n: int) -> list[list[int]]:
    """By brute force over all entries: of each probe the leaves of its n nearest ids."""
    shared = index.entries.sparkSession.sparkContext.broadcast(probes)

    kind = index.entries.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        best: list[list] = [[] for _ in shared.value]
        for batch in batches:
            if batch.num_rows:
                marked = [[(i, k) for i in ids] for ids, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                best = [sorted(a + b)[:n] for a, b in zip(best, nearest(shared.value, matrix(batch.column(0)), marked, n))]
        found = [(p, d, i, k) for p, own in enumerate(best) for d, (i, k) in own]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["probe", "d", "id", "leaf"])

    found = index.entries.select("v", "ids", "leaf").mapInArrow(run, f"probe long, d double, id {kind}, leaf long")
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("probe").orderBy("d", "id"))).where(F.col("nth") <= n)
    out: list[list[int]] = [[] for _ in probes]
    for r in best.collect():  # n rows a probe
        out[r.probe].append(r.leaf)
    return out


def calibrate(index: Index, probes: np.ndarray, n: int, recall: float) -> tuple[int, float]:
    """(leaves to visit, recall on the probes)."""
    tree = index.tree
    places = []
    for q, leaves in zip(probes, truth(probes, index, n)):
        place = {leaf: i for i, leaf in enumerate(tree.visits(q, tree.leaves))}
        places += [place[leaf] for leaf in leaves]
    visits, places = 1, np.array(places)
    while visits < tree.leaves and (places < visits).mean() < recall:
        visits = min(tree.leaves, visits + max(1, visits // 8))
    return visits, float((places < visits).mean()) if len(places) else 1.0


def search(index: Index, queries: DataFrame, visits: int, n: int) -> DataFrame:
    """(key, found): of each query vector the n nearest (d, id) in the leaves that it visits. queries: key, v, stored."""
    spark, shared = queries.sparkSession, index.shared
    blocks = spark.sparkContext.broadcast(index.blocks)

    def visit(batches):
        for batch in batches:
            if batch.num_rows:
                row, block, leaves = [], [], []
                for r, q in enumerate(matrix(batch.column(2))):
                    own: dict[int, list[int]] = {}
                    for leaf in shared.value.visits(q, visits):
                        first, n = blocks.value.get(leaf, (0, 0))  # leaves that hold nothing have no block
                        for k in range(first, first + n):
                            own.setdefault(k, []).append(leaf)
                    row += [r] * len(own)
                    block += own.keys()
                    leaves += own.values()
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array(block, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))], ["a", "b", "v", "block", "leaves"])

    asked = queries.select("key.a", "key.b", "v").mapInArrow(visit, "a long, b long, v array<double>, block long, leaves array<long>")
    asked = common.materialise(asked, "visits")
    slots = common.materialise(asked.groupBy("block").agg(F.ceil(F.count("*") / SLOT_ROWS).cast("int").alias("slots")), "slots")
    slots = F.broadcast(slots) if common.small_enough(slots, 16) else slots
    homes = spark.createDataFrame([(leaf, first, n) for leaf, (first, n) in index.blocks.items()], "leaf long, first long, n int")  # a row per leaf of the tree
    at = F.pmod(F.xxhash64("a", "b"), F.col("n"))
    held = index.entries.join(F.broadcast(homes), "leaf").withColumn("block", F.col("first") + at)
    left = asked.join(slots, "block").select("block", F.pmod(F.xxhash64("a", "b"), F.col("slots")).cast("int").alias("slot"), "a", "b", "v", "leaves")
    right = held.join(slots, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "leaf", "v", "ids")
    kind = index.entries.schema["ids"].dataType.elementType.simpleString()

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        best: list[list] = [[] for _ in range(left.num_rows)]
        if left.num_rows and right.num_rows:
            q, x, leaf, ids = matrix(left["v"]), matrix(right["v"]), right["leaf"].to_numpy(), right["ids"].to_pylist()
            asks: dict[int, list[int]] = {}
            for r, leaves in enumerate(left["leaves"].to_pylist()):
                for k in leaves:
                    asks.setdefault(k, []).append(r)
            for k, mine in asks.items():
                rows = np.flatnonzero(leaf == k)
                for r, own in zip(mine, nearest(q[mine], x[rows], [ids[i] for i in rows], n)):
                    best[r] = sorted(best[r] + own)[:n]
        found = [(r, d, i) for r, own in enumerate(best) for d, i in own]
        take, d, ids = zip(*found) if found else ((), (), ())
        take = pa.array(take, pa.int64())
        return pa.table([left["a"].take(take), left["b"].take(take), pa.array(d, pa.float64()), pa.array(ids, right["ids"].type.value_type)], ["a", "b", "d", "id"])

    met = left.groupBy("block", "slot").cogroup(right.groupBy("block", "slot"))
    rows = met.applyInArrow(meet, f"a long, b long, d double, id {kind}").select(F.struct("a", "b").alias("key"), "d", "id")
    best = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("d", "id"))).where(F.col("nth") <= n)
    return best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("found"))


def neighbours(table: DataFrame, queries: DataFrame | None = None, n: int = NEAREST, recall: float = RECALL, id_column: str = "vec_id", vector_column: str = "embedding", probes: int = PROBES, **tree: int) -> DataFrame:
    """(query_id, rank, id, score): the n nearest rows of the table to each row of queries (rows of the table; all of them if None)."""
    since = common.mark()
    rows = clean(table, id_column, vector_column)
    index = Index(rows, n + 1, **tree)
    asked = clean(queries, id_column, vector_column) if queries is not None else rows
    asked = common.materialise(asked.where(F.size("v") == index.width).select("id", vector_key("v").alias("key"), "v"), "queries")
    vectors = common.materialise(asked.groupBy("key").agg(F.first("v").alias("v")), "query_vectors")
    sample = common.least_by_hash(vectors.select(F.col("key").cast("string").alias("k"), "v"), probes, "k").select("v").toArrow()
    if not len(sample):
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    visits, _ = calibrate(index, matrix(sample["v"]), n, recall)
    found = common.materialise(search(index, vectors, visits, n + 1), "found")
    common.release(since, asked, found)
    others = F.slice(F.filter(F.col("found"), lambda x: x["id"] != F.col("id")), 1, n)
    each = asked.select("id", "key").distinct().join(found, "key").select(F.col("id").alias("query_id"), F.posexplode(others).alias("place", "x"))
    return each.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.d").alias("score"))
