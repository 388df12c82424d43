"""Queries against their SQL on keys and values that the small tables don't have."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.functions import arrays as A
from quarry.functions import text as T
from quarry.plans import catalog

from . import oracle


def held(spark, name, folder):
    oracle.check(catalog.QUERIES[name](spark, str(folder)), catalog.ORACLE[name], str(folder))


def test_sizes_of_large_keys(spark, tmp_path):
    pq.write_table(pa.table({"p_partkey": [1, 31, 32, 1023, 1024, 32767, 32768, 100_000, 1_048_576, 1_200_000]}), tmp_path / "part.parquet")
    held(spark, "human_sizes", tmp_path)
    sizes = spark.range(1).select(*[T.human_size(F.lit(1 << p)).alias(str(p)) for p in (9, 10, 30, 40, 50)]).first()
    assert list(sizes) == ["512.0 B", "1.0 KB", "1.0 GB", "1.0 TB", "1024.0 TB"]


@pytest.mark.parametrize("name", ["quality_report", "shard_faults", "shard_statistics", "spectrum_attrition", "spectrum_canonicalize", "spectrum_reject_summary", "spectrum_strict"])
def test_spectra_of_large_ids(spark, tmp_path, name):
    small = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    parts = [small.set_column(0, "vec_id", pa.array([i + shift for i in small["vec_id"].to_pylist()], pa.int64())) for shift in (0, 9_800, 5_000_000_000)]
    pq.write_table(pa.concat_tables(parts), tmp_path / "embeddings.parquet")
    held(spark, name, tmp_path)


def test_rounding_is_that_of_the_sql_in_every_bit(spark, tmp_path):
    ties = [(k + 0.5) / 1e6 for k in range(0, 400_000, 97)]
    x = [*ties, *(-t for t in ties), *np.nextafter(ties, 1).tolist(), 0.0, -0.0, -2.1e-7, 3e-7, 1e300, -1e300, math.inf, -math.inf, math.nan, 4503599627.370497]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(A.nearest(F.col("x"), 6)).collect()]
    want = [r[0] for r in duckdb.connect().execute("SELECT round(unnest(?::DOUBLE[]), 6)", [x]).fetchall()]
    assert list(map(repr, got)) == list(map(repr, want))
    pq.write_table(pa.table({"vec_id": [0], "embedding": pa.array([[1.0, -2e-7, 0.0, 3e-7]], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    unit = catalog.QUERIES["vector_l2norm"](spark, str(tmp_path)).first().unit
    assert list(map(repr, unit)) == list(map(repr, duckdb.connect().execute(catalog.ORACLE["vector_l2norm"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet'")).fetchone()[1]))


def test_word_patterns_find_what_the_plain_alternation_finds(spark):
    """A pattern that looks at a character once, and the same hits on texts with each word, cut words and words after other letters."""
    lists = (T.MEASURABLE, T.ACTIONABLE, T.FLUFF, T.UNSAFE, T.KNOWN_FACTS, T.TESTABLE, *T.METHOD_GROUPS, ("a", "ab", "b.c", "x|y", "-z"))
    words = sorted({w for ws in lists for w in ws})
    texts = [*words, *(w[:-1] for w in words), *(w[1:] for w in words), *(f"zq{w.upper()}9" for w in words), "", "bxc", "x", "a-", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = df.select("i", "t", *[T.contains_any(F.col("t"), ws).alias(f"w{n}") for n, ws in enumerate(lists)]).collect()
    assert all(r[f"w{n}"] == any(w in (r.t or "").lower() for w in ws) for r in got for n, ws in enumerate(lists))
    assert T.any_of(T.TESTABLE).startswith("(?=[wsphit])") and T.any_of(("ab", "a", "ac")) == "(?=[a])a"
