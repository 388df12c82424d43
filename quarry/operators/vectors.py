"""Exact vector search over a stated set of queries, reranking, and averages of vectors.

Few products of queries and rows are made at once: the queries are broadcast in blocks behind a count, and each task keeps its own best k before the
shuffle by way of the window's group limit. Where there are many, whole cells are skipped. Rows are stored by the nearest of some centres, with their
angle to it; a cell's radius is its largest angle. No row of a cell has a higher cosine with a query than that of the angle between query and centre
less the radius. A query first meets the groups of the nearest cells that hold k rows; its k-th score there is a bound, and of the others only groups
with a cell that can beat it are met as well. Cells that lie near each other form a group, of which there is a bounded number: where nothing can be
skipped, a query is sent to each group, not to each cell. The result is that of all products, also in its ties.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import arrays as A
from ..session import written

#: Queries that are held on every executor at a time, and products of queries and rows from which on cells are used.
QUERY_BLOCK, PLAIN_PRODUCTS = 4096, 10_000_000
#: Rows of a cell, cells at most, sampled rows for a centre, and rounds in which centres settle.
CELL_ROWS, MOST_CELLS, SAMPLED, SETTLE = 256, 2048, 32, 5
#: Groups of cells at most, to each of which a query is sent at most once in a pass.
MOST_GROUPS = 128
#: Rows and queries of a group that meet in one task, numbers of a matrix at a time, and visits of queries in one batch.
BLOCK_ROWS, SLOT_ROWS, SCORES, VISITS = 8192, 4096, 1 << 21, 4096


def _scored(corpus: DataFrame, queries: DataFrame, vector: str) -> DataFrame:
    c = corpus.withColumn("_norm", A.norm(F.col(vector)))
    q = queries.withColumn("_qnorm", A.norm(F.col("query_vector")))
    both = c.join(F.broadcast(q), how="cross")
    return both.withColumn("score", F.try_divide(A.dot(F.col(vector), F.col("query_vector")), F.col("_norm") * F.col("_qnorm"))).drop("_norm", "_qnorm", vector, "query_vector")


def top_k(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of the corpus of highest cosine for each query (query_id, query_vector), ranked, then by key. Rows and queries without a
    direction have no score and come last."""
    n = queries.count()
    if n * corpus.count() > PLAIN_PRODUCTS:
        return pruned(corpus, queries, k, key, vector)
    blocks = max(1, -(-n // block))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = best(_scored(corpus, part, vector), k, key)
        out = found if out is None else out.unionByName(found)
    return out


def best(scored: DataFrame, k: int, key: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


class Cells:
    """Centres of unit length, and of each cell its radius, its number of rows and its group."""

    def __init__(self, sample: np.ndarray, cells: int):
        x = _unit(sample)
        self.centres = x[:: max(1, len(x) // cells)][:cells]
        for _ in range(SETTLE):
            own = (x @ self.centres.T).argmax(1)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, x)
            size = np.sqrt((sums * sums).sum(1))
            self.centres = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], self.centres)
        leads = self.centres[:: -(-len(self.centres) // MOST_GROUPS)]
        self.group = (self.centres @ leads.T).argmax(1)
        self.radius, self.rows = np.zeros(len(self.centres)), np.zeros(len(self.centres), dtype=np.int64)

    def groups(self, cells: np.ndarray) -> np.ndarray:
        return np.unique(self.group[cells])

    def step(self, width: int) -> int:
        """So many vectors of that width at a time that their matrices, with the centres too, stay small."""
        return max(1, SCORES // max(len(self.centres), width))

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(_unit(x) @ self.centres.T, -1, 1))

    def near(self, angles: np.ndarray, k: int) -> np.ndarray:
        """The cells nearest to a query that hold k rows together."""
        order = np.argsort(angles, kind="stable")
        return order[: np.searchsorted(np.cumsum(self.rows[order]), k) + 1]

    def may_beat(self, angles: np.ndarray, score: float) -> np.ndarray:
        """The cells that may hold a row of that cosine or a higher one."""
        bound = np.cos(np.maximum(0, angles - self.radius - 1e-7))
        return np.flatnonzero((self.rows > 0) & (bound >= score - 1e-9))


def pruned(corpus: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """top_k() by cells."""
    norm = A.norm(F.col(vector))
    whole = corpus.where(F.coalesce(norm > 0, F.lit(False)))
    turned = F.coalesce(A.norm(F.col("query_vector")) > 0, F.lit(False))
    rows = whole.count()
    payload = [c for c in corpus.columns if c != vector]
    if rows < k:  # rows without a direction fill up: there are fewer than k others
        rest = corpus.where(~F.coalesce(norm > 0, F.lit(False))).orderBy(key).limit(k)
        few = whole.unionByName(rest)
        return best(_scored(few, queries, vector), k, key).select(*payload, "query_id", "score", "rank")
    cells, shared = min(MOST_CELLS, max(1, rows // CELL_ROWS)), None
    keyed = whole.withColumn("_h", F.xxhash64(key, vector))
    share = cells * SAMPLED * 2 / rows
    sample = (keyed.where(F.col("_h") % 1_000_003 < share * 2_000_006 - 1_000_003) if share < 1 else keyed).orderBy("_h").limit(cells * SAMPLED).select(vector).toArrow()
    found = Cells(_matrix(sample[vector]) if len(sample) else _matrix(whole.limit(1).select(vector).toArrow()[vector]), cells)
    shared = corpus.sparkSession.sparkContext.broadcast(found)
    schema = T_.StructType([*[corpus.schema[c] for c in payload], corpus.schema[vector], T_.StructField("_cell", T_.IntegerType()), T_.StructField("_group", T_.IntegerType()), T_.StructField("_angle", T_.DoubleType())])

    def place(batches):
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                batch = whole.slice(at, shared.value.step(1))
                a = shared.value.angles(_matrix(batch.column(batch.num_columns - 1)))
                own = a.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(shared.value.group[own], pa.int32()), pa.array(a[np.arange(len(own)), own])], schema.names)
                at += batch.num_rows

    stored = written(whole.select(*payload, vector).mapInArrow(place, schema), "cells")
    for r in stored.groupBy("_cell").agg(F.max("_angle").alias("r"), F.count("*").alias("n")).collect():  # a row per cell
        found.radius[r[0]], found.rows[r[0]] = r.r, r.n
    asked = written(queries.where(turned).select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")), "queries")
    first = written(met(stored, asked.withColumn("_bound", F.lit(None).cast("double")), found, k, key, vector, payload), "near")
    bound = first.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("_bound"))
    more = met(stored, asked.join(bound, "query_id"), found, k, key, vector, payload)
    out = best(first.drop("rank").unionByName(more.drop("rank")), k, key)
    lost = queries.where(~turned).select("query_id").withColumn("score", F.lit(None).cast("double"))
    least = corpus.select(*payload).orderBy(key).limit(k)  # without a score the key alone counts
    return out.unionByName(best(lost.join(F.broadcast(least), how="cross"), k, key))


def visited(whole: pa.RecordBatch, cells: Cells, k: int, names: list[str]):
    """(query_id, query_vector, _group) of each query (query_id, query_vector, _bound), VISITS rows at most at a time."""
    at = 0
    while at < whole.num_rows:
        batch = whole.slice(at, max(1, VISITS // MOST_GROUPS))
        row, group = [], []
        for r, (angles, bound) in enumerate(zip(cells.angles(_matrix(batch.column(1))), batch.column(2).to_pylist())):
            near = cells.groups(cells.near(angles, k))
            mine = near if bound is None else np.setdiff1d(cells.groups(cells.may_beat(angles, bound)), near)
            row += [r] * len(mine)
            group += mine.tolist()
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(group, pa.int32())], names)
        at += batch.num_rows


def met(stored: DataFrame, asked: DataFrame, cells: Cells, k: int, key: str, vector: str, payload: list[str]) -> DataFrame:
    """The best k of each query (query_id, query_vector, _bound) in the groups of its nearest cells or, with a bound, in the other groups with a cell
    that may beat it. Visits go out in batches of bounded size, whatever their number."""
    spark = stored.sparkSession
    shared = spark.sparkContext.broadcast(cells)
    kind = asked.schema["query_id"].dataType
    visit_t = T_.StructType([asked.schema["query_id"], asked.schema["query_vector"], T_.StructField("_group", T_.IntegerType())])

    def visit(batches):
        for batch in batches:
            yield from visited(batch, shared.value, k, visit_t.names)

    visits = written(asked.select("query_id", "query_vector", "_bound").mapInArrow(visit, visit_t), "visits")
    sizes = np.bincount(cells.group, weights=cells.rows).astype(int)
    counts = {r[0]: r[1] for r in visits.groupBy("_group").count().collect()}  # a row per group
    sides = spark.createDataFrame([(g, max(1, -(-int(sizes[g]) // BLOCK_ROWS)), max(1, -(-n // SLOT_ROWS))) for g, n in counts.items()], "_group int, _blocks int, _slots int")

    def part(of: str, *by: str) -> Column:
        return F.pmod(F.xxhash64(*by), F.col(of)).cast("int")

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    left = visits.join(F.broadcast(sides), "_group").select("_group", every("_blocks").alias("_b"), part("_slots", "query_id").alias("_s"), "query_id", "query_vector")
    right = stored.join(F.broadcast(sides), "_group").select("_group", part("_blocks", key).alias("_b"), every("_slots").alias("_s"), *payload, vector)
    schema = T_.StructType([*[stored.schema[c] for c in payload], T_.StructField("query_id", kind), T_.StructField("score", T_.DoubleType())])

    def meet(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        query, row, scores = [], [], []
        if left.num_rows and right.num_rows:
            q, x = _unit(_matrix(left["query_vector"])), _matrix(right[vector])
            size, keys = np.sqrt((x * x).sum(1)), right[key].to_pylist()
            for at in range(0, len(q), step := max(1, SCORES // len(x))):
                near = (q[at : at + step] @ x.T) / size
                cut = np.partition(near, -k, axis=1)[:, -k] - 1e-9 if len(x) > k else np.full(len(near), -2.0)
                for i in range(len(near)):
                    mine = np.flatnonzero(near[i] >= cut[i])
                    exact = (x[mine] * q[at + i]).sum(1) / size[mine]
                    for score, _, j in sorted(((-s, keys[j], j) for s, j in zip(exact.tolist(), mine.tolist())), key=lambda t: (t[0], t[1] is not None, t[1]))[:k]:
                        query.append(at + i), row.append(j), scores.append(-score)
        take = pa.array(row, pa.int64())
        return pa.table([*(right[c].take(take) for c in payload), left["query_id"].take(pa.array(query, pa.int64())), pa.array(scores, pa.float64())], names=schema.names)

    found = left.groupBy("_group", "_b", "_s").cogroup(right.groupBy("_group", "_b", "_s")).applyInArrow(meet, schema)
    return best(found, k, key)


def nearest_to(corpus: DataFrame, ids: list, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """top_k for stored rows; a row is among its own results."""
    queries = corpus.where(F.col(key).isin(ids)).select(F.col(key).alias("query_id"), F.col(vector).alias("query_vector"))
    return top_k(corpus, queries, k, key, vector)


def federated(parts: dict[str, DataFrame], queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best k over several collections, each of which gives its own best k."""
    out = None
    for name, corpus in parts.items():
        found = top_k(corpus, queries, k, key, vector).withColumn("collection", F.lit(name))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key, "collection"))
    return out.withColumn("rank", nth).where(F.col("rank") <= k)


def rerank(results: DataFrame, equal: dict[str, str] | None = None, time: str | None = None, at: float | None = None, tolerance: float | None = None) -> DataFrame:
    """Keeps results whose time is unknown or within the tolerance, and whose named columns equal the given values as strings."""
    if time and at is not None and tolerance is not None:
        results = results.where(F.col(time).isNull() | (F.abs(F.col(time) - at) <= tolerance))
    for c, v in (equal or {}).items():
        results = results.where(F.col(c).cast("string") == v)
    return results


def best_per_id(results: DataFrame, key: str = "vec_id") -> DataFrame:
    """Candidates of several query variants as one list: the highest score of each id."""
    return results.groupBy("query_id", key).agg(F.max("score").alias("score"))


def gaussian(*parts: Column) -> Column:
    """A normal variate that the parts fix, the same in any engine: the Box-Muller transform of two numbers from their MD5."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    u, v = (((F.conv(F.substring(digest, at, 8), 16, 10).cast("double")) + 0.5) / float(1 << 32) for at in (1, 9))
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def expanded(queries: DataFrame, n: int, scale: float = 0.0, seed: int = 7) -> DataFrame:
    """Each query and n variants with Gaussian noise of the scale; variant 0 is the query. The noise follows from seed, query, variant and
    place, so that it does not depend on how the table is partitioned."""
    noise = lambda i: F.when(F.col("variant") > 0, scale * gaussian(F.lit(seed), F.col("query_id"), F.col("variant"), i)).otherwise(0.0)
    noisy = F.transform("query_vector", lambda x, i: x.cast("double") + noise(i))
    return queries.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn("query_vector", noisy)


def mean_vector(df: DataFrame, by: tuple[str, ...], vector: str = "embedding") -> DataFrame:
    """(place, value) rows of the mean vector of each group."""
    return df.select(*by, F.posexplode(vector).alias("place", "x")).groupBy(*by, "place").agg(F.avg(F.col("x").cast("double")).alias("value"))


def explained(observed: DataFrame, predicted: DataFrame, key: str, tolerance: float = 0.01) -> DataFrame:
    """Shares of observed peaks and intensity with a predicted peak within the tolerance. Both: key, mz, i. The range join is an equi-join
    on cells as wide as the tolerance, with each prediction in its own and the two next cells."""
    cell = F.floor(F.col("mz") / tolerance)
    near = predicted.select(key, F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"), F.col("mz").alias("_p"))
    seen = observed.withColumn("_cell", cell).withColumn("_peak", F.struct("mz", "i"))
    hits = seen.join(near, [key, "_cell"]).where(F.abs(F.col("mz") - F.col("_p")) <= tolerance).select(key, "_peak").distinct().withColumn("_hit", F.lit(1))
    out = seen.join(hits, [key, "_peak"], "left")
    return out.groupBy(key).agg(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")).alias("peaks_explained"), F.try_divide(F.sum(F.col("i") * F.coalesce("_hit", F.lit(0))), F.sum("i")).alias("intensity_explained"))


def as_spectrum(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A vector seen as a spectrum: places from 1 as masses, absolute values as intensities."""
    mzs = F.transform(vector, lambda x, i: (i + 1).cast("double"))
    return df.select(key, mzs.alias("mzs"), F.transform(vector, lambda x: F.abs(x.cast("double"))).alias("intensities"))


