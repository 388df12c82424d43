"""Column statistics, histograms, and drift between samples. Everything is an aggregate or a bucketed running sum."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .ordering import joined_by, range_bucket, range_edges, running


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: non-null count, least, greatest and sum (null for columns that are not numbers)."""
    kinds = dict(df.dtypes)
    numeric = {c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")}

    def of(c: str) -> Column:
        least, most, total = (F.min(c), F.max(c), F.sum(c)) if c in numeric else (F.lit(None), F.lit(None), F.lit(None))
        return F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), least.cast("double").alias("min"), most.cast("double").alias("max"), total.cast("double").alias("sum"))

    return df.agg(F.array(*map(of, columns)).alias("rows")).select(F.inline("rows"))


def reductions(df: DataFrame, column: str) -> DataFrame:
    """mean, population std, min, max, and the values at places n/2, 0.95 n and 0.99 n of the sorted column (from 0); zeros if empty.
    Values are counted, then placed by bucketed running counts."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    head = written(values.agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")), "head")
    by = written(values.groupBy("v").agg(F.count("*").alias("c")), "counts")
    upto = running(by, range_bucket(F.col("v"), range_edges(by, "v")), [F.col("v")], {"upto": F.col("c")})
    places = head.select("n", F.floor(F.col("n") / 2).alias("i50"), *[F.least(F.floor(F.col("n") * q), F.col("n") - 1).alias(f"i{int(q * 100)}") for q in (0.95, 0.99)])
    at = upto.join(F.broadcast(places), how="cross").agg(*[F.min(F.when(F.col("upto") > F.col(f"i{p}"), F.col("v"))).alias(f"p{p}") for p in (50, 95, 99)])
    both = head.join(at, how="cross")  # a row each
    zero = F.lit(0.0)
    return both.select("n", *[F.coalesce(c, zero).alias(c) for c in ("mean", "std", "min", "max", "p50", "p95", "p99")])


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, low, high, n for all bins of equal width; the last is closed; a constant column has one bin."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    ends = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    which = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(bins - 1))).cast("int")
    counts = values.join(F.broadcast(ends), how="cross").groupBy(which.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.where("lo IS NOT NULL").withColumn("bin", F.explode(F.sequence(F.lit(0), F.when(F.col("hi") == F.col("lo"), 0).otherwise(bins - 1))))
    low = F.col("lo") + F.col("bin") * step
    high = F.when(F.col("hi") == F.col("lo"), F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * step)
    return every.join(counts, "bin", "left").select("bin", low.alias("low"), high.alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def quantiles(df: DataFrame, column: str, places: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """A row per group with the linearly interpolated quantiles, by name. Values are counted, then placed by bucketed running counts, so that
    no task holds the values of a group. Nulls are left out; a table without values has no row for a group, and nulls without groups."""
    counts = written(df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_x")).agg(F.count("*").alias("_c")), "counts")
    ran = running(counts, range_bucket(F.col("_x"), range_edges(counts, "_x")), [F.col("_x")], {"_upto": F.col("_c")}, by)
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    ran = joined_by(ran, sizes, by) if by else ran.join(F.broadcast(sizes), how="cross")

    def at(place: Column) -> Column:
        return F.min(F.when(F.col("_upto") > place, F.col("_x")))

    ends, out = [], []
    for i, (name, q) in enumerate(places.items()):
        spot = (F.col("_n") - 1) * F.lit(float(q))
        ends += [at(F.floor(spot)).alias(f"_l{i}"), at(F.ceil(spot)).alias(f"_h{i}"), F.max(spot - F.floor(spot)).alias(f"_f{i}")]
        out.append((F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}")).alias(name))
    return ran.groupBy(*by).agg(*ends).select(*by, *out)


def describe(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, sample std, min, interpolated quartiles, max."""
    v = F.col(column).cast("double")
    head = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    parts = quantiles(df, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    out = joined_by(head, parts, by) if by else head.join(parts, how="cross")  # a row each
    return out.select(*by, "n", "mean", "std", "min", "q1", "median", "q3", "max")


def shares(df: DataFrame, columns: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """Counts of values and their share of all, or of their group."""
    counts = df.groupBy(*within, *columns).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*(within or (F.lit(0),)))))


def null_and_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: share of nulls, and whether all values (null being one) differ."""

    def of(c: str) -> Column:
        distinct = F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
        return F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("null_rate"), (distinct == F.count("*")).alias("is_unique"))

    return df.agg(F.array(*map(of, columns)).alias("rows")).select(F.inline("rows"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: the share of rows that have a value."""
    parts = [F.struct(F.lit(c).alias("column"), F.try_divide(F.count(c), F.count("*")).alias("completeness")) for c in columns]
    return df.agg(F.array(*parts).alias("rows")).select(F.inline("rows"))


def ks_statistic(reference: DataFrame, current: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The largest gap between two empirical distributions, with both sizes. Values are counted first; the distributions are bucketed
    running sums over the distinct values."""
    both = reference.select(*by, F.col(column).cast("double").alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(current.select(*by, F.col(column).cast("double").alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = written(both.where("v IS NOT NULL").groupBy(*by, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "counts")
    ran = running(counts, range_bucket(F.col("v"), range_edges(counts, "v")), [F.col("v")], {"ca": F.col("a"), "cb": F.col("b")}, by)
    sizes = counts.groupBy(*by).agg(F.sum("a").alias("n_reference"), F.sum("b").alias("n_current"))
    ran = joined_by(ran, sizes, by) if by else ran.join(F.broadcast(sizes), how="cross")
    gap = F.abs(F.try_divide(F.col("ca"), F.col("n_reference")) - F.try_divide(F.col("cb"), F.col("n_current")))
    return ran.groupBy(*by).agg(F.max(gap).alias("ks"), F.first("n_reference").alias("n_reference"), F.first("n_current").alias("n_current"))


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """ks_p_value() as a column."""
    en = F.sqrt(n * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * d
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * F.pow(k * x, F.lit(2.0))))
    p = 2 * F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(d <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def ks_test(reference: DataFrame, current: DataFrame, column: str, by: tuple[str, ...] = (), limit: float = 0.05) -> DataFrame:
    """ks_statistic()'s row with its p-value and whether that is below the limit."""
    out = ks_statistic(reference, current, column, by)
    return out.withColumn("p_value", ks_p(F.col("ks"), F.col("n_reference"), F.col("n_current"))).withColumn("drift", F.col("p_value") < limit)


def chi_square_p(x: Column, dof: Column) -> Column:
    """chi_square_p_value() as a column, for results of a few rows."""

    def run(xs: pd.Series, dofs: pd.Series) -> pd.Series:
        return pd.Series([chi_square_p_value(a, int(b)) if a == a and b == b else None for a, b in zip(xs, dofs)], dtype="float64")

    return F.pandas_udf(run, "double")(x, dof)


def ks_p_value(d: float, n: int, m: int) -> float:
    """The asymptotic p-value of a KS statistic."""
    if d <= 0:
        return 1.0
    en = math.sqrt(n * m / (n + m))
    x = (en + 0.12 + 0.11 / en) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * x) ** 2) for k in range(1, 101))))


def chi_square_p_value(x: float, df: int) -> float:
    """The upper tail of the chi-square distribution, by the incomplete gamma function's series or continued fraction."""
    if x <= 0 or df <= 0:
        return 1.0
    a, z = df / 2, x / 2
    lead = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-14:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * lead)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return min(1.0, h * lead)


def psi_equal_width(reference: DataFrame, current: DataFrame, column: str, buckets: int = 10) -> DataFrame:
    """Population stability index over equal-width buckets of the reference's range; values outside count in the outer buckets, and each
    bucket gets one more."""
    ends = reference.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))

    def counted(df: DataFrame, name: str) -> DataFrame:
        v = F.col(column).cast("double")
        step = (F.col("hi") - F.col("lo")) / buckets
        which = F.when(step == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.floor((v - F.col("lo")) / step), F.lit(buckets - 1)))).cast("int")
        return df.where(F.col(column).isNotNull()).join(F.broadcast(ends), how="cross").groupBy(which.alias("bucket")).agg(F.count("*").alias(name))

    return psi(counted(reference, "e"), counted(current, "a"), reference.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")), F.lit(1.0))


def psi(expected: DataFrame, actual: DataFrame, every: DataFrame, added: Column) -> DataFrame:
    counts = every.join(expected, "bucket", "left").join(actual, "bucket", "left").select("bucket", (F.coalesce("e", F.lit(0)) + added).alias("e"), (F.coalesce("a", F.lit(0)) + added).alias("a"))
    whole = Window.partitionBy(F.lit(0))  # a row per bucket
    parts = counts.select((F.col("e") / F.sum("e").over(whole)).alias("pe"), (F.col("a") / F.sum("a").over(whole)).alias("pa"))
    return parts.agg(F.sum((F.col("pa") - F.col("pe")) * F.log(F.col("pa") / F.col("pe"))).alias("psi"))


def psi_deciles(reference: DataFrame, current: DataFrame, column: str, buckets: int = 10, floor: float = 1e-4) -> DataFrame:
    """The index over the reference's quantile buckets. Values outside the reference's range fall out of the counts but stay in the sizes;
    empty buckets have the floor for a count. The last bucket is closed."""
    edges = list(quantiles(reference, column, {f"e{i}": i / buckets for i in range(buckets + 1)}).first() or ())  # buckets + 1 numbers
    if not edges or edges[0] is None:
        return reference.sparkSession.createDataFrame([(None,)], "psi double")

    def counted(df: DataFrame, name: str) -> DataFrame:
        v = F.col(column).cast("double")
        which = F.least(F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= v)), F.lit(buckets)) - 1
        inside = (v >= edges[0]) & (v <= edges[-1])
        return df.where(F.col(column).isNotNull()).groupBy(F.when(inside, which).otherwise(-1).alias("bucket")).agg(F.count("*").alias(name))

    whole = Window.partitionBy(F.lit(0))  # a row per bucket
    e = counted(reference, "e").withColumn("te", F.sum("e").over(whole))
    a = counted(current, "a").withColumn("ta", F.sum("a").over(whole))
    every = reference.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    sizes = e.agg(F.max("te").alias("ne")).join(a.agg(F.max("ta").alias("na")), how="cross")
    counts = every.join(e, "bucket", "left").join(a, "bucket", "left").join(sizes, how="cross")
    pe, pa = (F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(floor)).otherwise(F.col(n)) / F.col(t) for n, t in (("e", "ne"), ("a", "na")))
    return counts.agg(F.sum((pa - pe) * F.log(pa / pe)).alias("psi"))


def categorical_alignment(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """All values of both with their counts, zero where one lacks it."""
    a, b = (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias(n)) for df, n in ((reference, "n_reference"), (current, "n_current")))
    return a.join(b, "value", "full").select("value", F.coalesce("n_reference", F.lit(0)).alias("n_reference"), F.coalesce("n_current", F.lit(0)).alias("n_current"))


def categorical_drift(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """chi2 of the current counts against the reference's shares, degrees of freedom, and the values that the reference lacks (with any,
    the test makes no statement and chi2 is null)."""
    both, whole = categorical_alignment(reference, current, column), Window.partitionBy(F.lit(0))
    expected = F.col("n_reference") / F.sum("n_reference").over(whole) * F.sum("n_current").over(whole)
    out = both.withColumn("expected", expected).agg(F.sum(F.try_divide((F.col("n_current") - F.col("expected")) * (F.col("n_current") - F.col("expected")), F.col("expected"))).alias("x"), (F.count("*") - 1).alias("dof"), F.count_if(F.col("n_reference") == 0).alias("new_categories"))
    return out.select(F.when(F.col("new_categories") == 0, F.col("x")).alias("chi2"), "dof", "new_categories")


def divergences(reference: DataFrame, current: DataFrame, column: str, smoothing: float = 1.0) -> DataFrame:
    """Kullback-Leibler divergences both ways and the Jensen-Shannon divergence of smoothed value shares, in nats."""
    both, whole = categorical_alignment(reference, current, column), Window.partitionBy(F.lit(0))
    p, q = ((F.col(n) + smoothing) / F.sum(F.col(n) + smoothing).over(whole) for n in ("n_reference", "n_current"))
    both = both.select(p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)

    def kl(a: str, b: str) -> Column:
        return F.sum(F.col(a) * F.log(F.col(a) / F.col(b)))

    return both.agg(kl("p", "q").alias("kl_pq"), kl("q", "p").alias("kl_qp"), ((kl("p", "m") + kl("q", "m")) / 2).alias("js"))


def windowed_drift(df: DataFrame, column: str, order: str, size: int, first: bool = False) -> DataFrame:
    """KS of each run of `size` rows in order against the whole table, or against the first run alone (which then has no row), with both
    sizes. order: an integer that counts rows. A run meets the reference at its own values: between two of them its share stays, so that
    the gap is largest at one or just before the other."""
    windows = df.withColumn("window", F.floor(F.col(order) / size).cast("long"))
    counts = written(windows.where(F.col(column).isNotNull()).groupBy("window", F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c")), "counts")
    theirs = F.when(F.col("window") == 0, F.col("c")).otherwise(0) if first else F.col("c")
    whole = written(counts.groupBy("v").agg(F.sum(theirs).alias("w")), "counts")
    edges = range_edges(whole, "v")
    whole = running(whole, range_bucket(F.col("v"), edges), [F.col("v")], {"upto": F.col("w")})
    total = counts.agg(F.sum(theirs).alias("n_reference"))
    counts = counts.where("window > 0") if first else counts
    own = running(counts, range_bucket(F.col("v"), edges), [F.col("v")], {"own": F.col("c")}, ("window",))
    sizes = counts.groupBy("window").agg(F.sum("c").alias("n"))
    joined = own.join(whole.select("v", "upto", "w"), "v").join(sizes, "window").join(F.broadcast(total), how="cross")  # one row
    here = F.abs(F.col("own") / F.col("n") - F.col("upto") / F.col("n_reference"))
    before = F.abs((F.col("own") - F.col("c")) / F.col("n") - (F.col("upto") - F.col("w")) / F.col("n_reference"))
    return joined.groupBy("window").agg(F.greatest(F.max(here), F.max(before)).alias("ks"), F.max("n").alias("n"), F.max("n_reference").alias("n_reference"))


def contract(report: DataFrame, rules: dict[str, str]) -> DataFrame:
    """report: one row. The names of the rules (SQL conditions) that it fails, and whether there is none."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return report.withColumn("failures", failed).withColumn("passed", F.size("failures") == 0)
