"""Exact deduplication and upserts by aggregates over hashes; no operator here keeps a set of keys in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row per key: the first in order. The least row is picked by an aggregate, so map tasks reduce hot keys first."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return best.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The ids that stay when equal texts are reduced to the one of least id, with the size of each group."""
    return df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest")).agg(F.min(key).alias(key), F.count("*").alias("copies")).select(key, "copies")


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dedup_report(df: DataFrame, text: str = "text") -> DataFrame:
    """rows, distinct texts, rows that are copies, and their share."""
    groups = df.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest")).agg(F.count("*").alias("n"))
    out = groups.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_texts"), F.count_if(F.col("n") > 1).alias("groups"))
    return out.select("total", "distinct_texts", "groups", (F.col("total") - F.col("distinct_texts")).alias("duplicates"), F.round((F.col("total") - F.col("distinct_texts")) / F.col("total"), 6).alias("duplicate_rate"))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Insert or replace by key: rows of new take the place of rows of old."""
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"))


def update_from(old: DataFrame, new: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], flag: str = "regenerated") -> DataFrame:
    """Replaces the named columns where new has the key, and marks the rows that were replaced."""
    fresh = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    out = old.join(fresh, list(keys), "left")
    before = F.col(flag) if flag in old.columns else F.lit(False)
    out = out.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns} | {flag: before | F.coalesce("_hit", F.lit(False))})
    return out.drop("_hit", *[f"_new_{c}" for c in columns])


def missing_keys(expected: DataFrame, found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Expected keys that found lacks."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among those done: resuming a job."""
    return df.join(done.select(key), key, "left_anti")


def latest(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The last row of each key by order, by an aggregate."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def changed(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ between two tables: key, old, new (null where one lacks it)."""
    both = a.select(key, F.col(value).alias("old")).join(b.select(key, F.col(value).alias("new")), key, "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def compare(a: DataFrame, b: DataFrame, key: str, value: str, absolute: float = 1e-8, relative: float = 1e-5) -> DataFrame:
    """key, expected, actual and whether they agree within the tolerances; a key that one lacks does not."""
    both = a.select(key, F.col(value).alias("expected")).join(b.select(key, F.col(value).alias("actual")), key, "full")
    near = F.abs(F.col("expected") - F.col("actual")) <= absolute + relative * F.abs("expected")
    return both.withColumn("agrees", F.coalesce(near, F.lit(False)))


def content_hash(df: DataFrame) -> DataFrame:
    """An order-free fingerprint of a table: rows and the sum of the rows' hashes."""
    return df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("fingerprint"))


def occurrence(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Numbers the rows of each key from 1."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
