"""Numbers and running sums over a whole table without one task that sees all rows.

Rows are put into buckets that follow the wanted order. Totals of the buckets, a small table, give each bucket its offset; windows then
run inside the buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a hash that name a bucket: 4,096 of them; and the rows that a bucket should have at most where the table is larger.
HASH_DIGITS, BUCKET_ROWS = 3, 4_000_000


def hash_order(*columns: str, seed: str | int = "") -> Column:
    """A fixed-width hex key whose order is a seeded shuffle, the same in any engine and at any parallelism."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def joined_by(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """An inner join on columns in which nulls are equal, as in groups; right's columns of these names go."""
    other, same = right.withColumnsRenamed({c: f"_by_{c}" for c in by}), F.lit(True)
    for c in by:
        same = same & left[c].eqNullSafe(other[f"_by_{c}"])
    return left.join(other, same).drop(*[f"_by_{c}" for c in by])


def running(df: DataFrame, bucket: Column, order: list[Column], values: dict[str, Column], within: tuple[str, ...] = ()) -> DataFrame:
    """Adds to each row, for each name, the sum of the values of all rows up to it. bucket: grows with order; within: groups that are
    summed apart."""
    df = df.withColumn("_bucket", bucket)
    for name, value in values.items():
        df = df.withColumn(f"_v_{name}", value)
    totals = df.groupBy(*within, "_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*(within or (F.lit(0),))).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*within, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values])
    inside = Window.partitionBy(*within, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = joined_by(df, starts, (*within, "_bucket"))
    for name in values:
        out = out.withColumn(name, F.sum(f"_v_{name}").over(inside) + F.col(f"_s_{name}"))
    return out.drop("_bucket", *[f"_{k}_{n}" for n in values for k in "vs"])


def hash_digits(rows: int) -> int:
    """So many hex digits that buckets of a uniform key keep to BUCKET_ROWS; five, a million buckets, at most."""
    digits = HASH_DIGITS
    while digits < 5 and rows > BUCKET_ROWS * 16**digits:
        digits += 1
    return digits


def numbered(df: DataFrame, key: str, out: str = "position", within: tuple[str, ...] = (), ties: tuple[str, ...] = (), rows: int | None = None, upto: int | None = None) -> DataFrame:
    """Numbers rows from 1 in the order of a hex key column. rows: the table's, if they are known and many. upto: rows that are needed; later
    buckets are left out before the rows are dealt."""
    bucket = F.substring(key, 1, hash_digits(rows or 0))
    if upto is not None:
        counts = df.groupBy(bucket.alias("_cut")).agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1))
        need = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < upto).agg(F.max("_cut")).first()[0]  # a row per bucket
        df = df.where(bucket <= F.lit(need)) if need is not None else df
    return running(df, bucket, [F.col(key), *[F.col(t) for t in ties]], {out: F.lit(1).cast("long")}, within)


def range_edges(df: DataFrame, column: str, buckets: int = 64) -> list[float]:
    """At most buckets - 1 inner edges of about equal shares: a bounded result on the driver. Large tables get more, 1,024 at most."""
    rows = df.count()
    buckets = max(buckets, min(1024, -(-rows // BUCKET_ROWS)))
    cuts = df.select(F.percentile_approx(F.col(column).cast("double"), [i / buckets for i in range(1, buckets)], max(1000, 4 * buckets))).first()[0]
    return sorted(set(cuts or []))


def range_bucket(column: Column, edges: list[float]) -> Column:
    """The number of edges below or at a value, by a search that halves the edges at each step. Null is in the first bucket."""
    value = column.cast("double")

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(float(edges[mid])), search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(edges))
