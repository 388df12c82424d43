"""Vector search by cells against all products: ties, copies, hot cells, rows and queries without a direction."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import vectors as V
from quarry.operators.vectors import Cells


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.label, None if r.score is None else round(r.score, 9)) for r in df.collect())


def both(monkeypatch, table, queries, k):
    plain = rows_of(V.top_k(table, queries, k))
    monkeypatch.setattr(V, "PLAIN_PRODUCTS", 0), monkeypatch.setattr(V, "CELL_ROWS", 20)
    out = rows_of(V.top_k(table, queries, k))
    monkeypatch.undo()
    return plain, out


def table_of(spark, x):
    return spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(5)


def asked(table, n):
    return table.where(F.col("vec_id") % n == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def test_cells_give_the_result_of_all_products(spark, monkeypatch):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 8)) * 4
    x = (centres[r.integers(0, 12, 900)] + r.normal(size=(900, 8))).astype(np.float32)
    x[100:400] = x[7]  # a hot cell of copies: ties go by key
    x[500] = 0
    table = table_of(spark, x.tolist())
    plain, out = both(monkeypatch, table, asked(table, 20), 10)
    assert plain == out and len({q for q, *_ in out}) == 45
    monkeypatch.setattr(V, "BLOCK_ROWS", 40), monkeypatch.setattr(V, "SLOT_ROWS", 7), monkeypatch.setattr(V, "SCORES", 300)
    assert both(monkeypatch, table, asked(table, 20), 3)[1] == sorted(x for x in plain if x[1] <= 3)


def test_few_rows_and_none(spark, monkeypatch):
    table = table_of(spark, [[1.0, 0.0], [0.0, 0.0], [0.5, 0.5]])
    plain, out = both(monkeypatch, table, asked(table, 1), 5)
    assert plain == out and len(out) == 9
    assert both(monkeypatch, table.limit(0), asked(table, 1), 2)[1] == [] == both(monkeypatch, table, asked(table, 1).limit(0), 2)[1]


def test_whole_cells_are_skipped_and_never_wrongly():
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 6)) * 6
    x = centres[r.integers(0, 30, 3000)] + r.normal(size=(3000, 6)) * 0.5
    cells = Cells(x[:600], 40)
    a = cells.angles(x)
    own = a.argmin(1)
    for c in range(len(cells.centres)):
        cells.rows[c] = (own == c).sum()
        cells.radius[c] = a[own == c, c].max(initial=0)
    unit, share = x / np.linalg.norm(x, axis=1)[:, None], []
    for q in range(0, 3000, 100):
        score = np.sort(unit @ unit[q])[-10]
        allowed = set(cells.may_beat(a[q], score).tolist())
        assert {own[i] for i in np.flatnonzero(unit @ unit[q] >= score)} <= allowed
        assert cells.rows[cells.near(a[q], 10)].sum() >= 10
        share.append(cells.rows[list(allowed)].sum() / 3000)
    assert np.mean(share) < 0.2


def test_visits_are_few_and_go_out_in_bounded_batches():
    """Uniform vectors, of which no cell can be skipped: each query is sent once to each group, and no batch grows with the cells."""
    x = np.random.default_rng(3).normal(size=(3000, 16))
    cells = Cells(x, 600)
    cells.rows[:], cells.radius[:] = 5, 1.0
    asked = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(list(x[:500]), pa.list_(pa.float64())), pa.nulls(500, pa.float64())], ["query_id", "query_vector", "_bound"])
    first = list(V.visited(asked, cells, 10, ["query_id", "query_vector", "_group"]))
    more = list(V.visited(asked.set_column(2, "_bound", pa.array([-1.0] * 500)), cells, 10, ["query_id", "query_vector", "_group"]))
    assert max(b.num_rows for b in first + more) <= V.VISITS
    met = [(q, g) for b in first + more for q, g in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
    assert len(met) == len(set(met)) == 500 * len(set(cells.group.tolist())) <= 500 * V.MOST_GROUPS
