"""Fingerprints of tables as multisets: order-free, duplicates count, and rows can be added and taken away.

A row's hash is the MD5 of its columns' texts; its two halves are numbers of 64 bits. A table's fingerprint is the number of its rows and the sums of
the halves modulo two primes. Sums of parts add up, so shards are hashed apart and together at once, and an old fingerprint follows a change without a
pass over the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

# The largest primes below 2^61 and 2^62.
PRIMES = ((1 << 61) - 1, (1 << 62) - 57)
_NULL, _BETWEEN = "\x00", "\x1f"


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The MD5 of the columns in the order of their names; nested values as JSON."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        nested = kinds[c].startswith(("array", "map", "struct"))
        return F.coalesce(F.to_json(F.col(c)) if nested else F.col(c).cast("string"), F.lit(_NULL))

    return F.md5(F.concat_ws(_BETWEEN, *[text(c) for c in sorted(columns or df.columns)]))


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")


def _modulo(total: Column, prime: int) -> Column:
    return F.pmod(total, F.lit(prime).cast("decimal(38,0)")).cast("long")


def fingerprint(df: DataFrame, by: tuple[str, ...] = (), columns: list[str] | None = None) -> DataFrame:
    """(by, n, a, b): one aggregate; an empty table without groups has zeros."""
    rows = df.select(*by, row_hash(df, columns).alias("_h"))
    sums = [F.coalesce(_modulo(F.sum(_half(F.col("_h"), at)), p), F.lit(0).cast("long")).alias(name) for name, at, p in zip("ab", (1, 17), PRIMES)]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def combined(*parts: tuple[DataFrame, int], by: tuple[str, ...] = ()) -> DataFrame:
    """The fingerprint of tables put together (1) and taken away (-1)."""
    whole = None
    for part, sign in parts:
        rows = part.select(*by, *[(F.col(c).cast("decimal(38,0)") * sign).alias(c) for c in ("n", "a", "b")])
        whole = rows if whole is None else whole.unionByName(rows)
    return whole.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), *[_modulo(F.sum(c), p).alias(c) for c, p in zip("ab", PRIMES)])


def compared(first: DataFrame, second: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, n_first, n_second, same) for each shard of two fingerprints; a shard that one lacks has no rows there and differs."""
    x = first.select(*by, F.col("n").alias("n_first"), F.struct("n", "a", "b").alias("_x"))
    y = second.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("n").alias("n_second"), F.struct("n", "a", "b").alias("_y"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = x.join(y, same, "full").withColumns({c: F.when(F.col("_x").isNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in by})
    zero = F.lit(0).cast("long")
    return out.select(*by, F.coalesce("n_first", zero).alias("n_first"), F.coalesce("n_second", zero).alias("n_second"), F.coalesce(F.col("_x") == F.col("_y"), F.lit(False)).alias("same"))


def run_twice(job: Callable[[], DataFrame], by: tuple[str, ...]) -> DataFrame:
    """compared() of two runs of a job, each written before it is hashed: shards whose rows differ name what is not deterministic."""
    first, second = (fingerprint(written(job(), f"run{i}"), by) for i in (1, 2))
    return compared(first, second, by)
