"""Quantile sketches of logarithmic buckets: counts that add up over batches, keys and tasks, with a bounded relative error.

A positive value x is in bucket ceil(log x / log g), g = (1 + error) / (1 - error), and stands for the bucket's middle 2 g^i / (g + 1), which is
off by `error` times its size at most. Negative values have mirrored buckets; zero has its own. A sketch is a table (keys, sign, bucket, n): merging is a
sum, and the buckets of a key grow with the logarithm of the range of its values, not with their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = 0.01


def growth(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> tuple[Column, Column]:
    """(sign, bucket) of a number; both null for null and NaN."""
    x = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    number = F.ceil(F.log(F.abs(F.nullif(x, F.lit(0.0)))) / math.log(growth(error))).cast("int")
    return F.signum(x).cast("int"), F.when(x == 0, F.lit(0)).otherwise(number)


def sketch(df: DataFrame, value: str, by: tuple[str, ...] = (), error: float = ERROR) -> DataFrame:
    """(by, sign, bucket, n): also of a stream, in complete or update mode. Nulls and NaN have no bucket."""
    sign, number = bucket(F.col(value), error)
    return df.select(*by, sign.alias("sign"), number.alias("bucket")).where("bucket IS NOT NULL").groupBy(*by, "sign", "bucket").agg(F.count("*").alias("n"))


def merged(*parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One sketch of several, over other keys if by leaves some out."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def middle(sign: Column, number: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket."""
    g = growth(error)
    return F.when(sign == 0, F.lit(0.0)).otherwise(sign * 2 * F.pow(F.lit(g), number) / (g + 1))


def quantiles(sketched: DataFrame, places: dict[str, float], by: tuple[str, ...] = (), error: float = ERROR) -> DataFrame:
    """(by, n, and a column per place): the middle of the bucket that holds the value at floor(q (n - 1)) of the sorted values. Windows run over the
    buckets of a key, whose number is bounded by the range of values."""
    order = [F.col("sign"), F.col("sign") * F.col("bucket")]
    whole = Window.partitionBy(*(by or (F.lit(0),)))
    upto = F.sum("n").over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = sketched.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(whole)).withColumn("_v", middle(F.col("sign"), F.col("bucket"), error))
    at = [F.min_by("_v", F.when(F.col("_upto") > F.floor(F.lit(float(q)) * (F.col("_all") - 1)), F.col("_upto"))).alias(name) for name, q in places.items()]
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), *at)
