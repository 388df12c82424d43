"""Array expressions: spectra (masses and intensities) and vectors, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once per row. An expression inside a lambda is computed again for each element, so what is the same
    for all of a row's elements must come in by a name."""
    return F.transform(F.array(value), use)[0]


def finite(a: Column) -> Column:
    """No null, NaN (the greatest of all values) or infinity; an empty array is finite."""
    ends = (F.array_min(a).cast("double") > float("-inf")) & (F.array_max(a).cast("double") < float("inf"))
    return ~F.exists(a, lambda x: x.isNull()) & F.coalesce(ends, F.size(a) == 0)


def peaks(mzs: Column, intensities: Column) -> Column:
    """An array of (mz, i) pairs as doubles."""
    return F.zip_with(mzs, intensities, lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("double").alias("i")))


def canonicalise(df: DataFrame, mzs: str = "mzs", intensities: str = "intensities", precursor: str = "precursor_mz", min_peaks: int = 1, max_precursor: float = 10_000.0, max_peaks: int | None = None, drop_zero: bool = False) -> DataFrame:
    """df with status (ok or the first reason to reject) and canon: (mz, i) sorted by mass, intensities divided by their largest.
    drop_zero and max_peaks give the stricter mode: peaks without intensity go before the least number of peaks is asked for, and only
    the strongest stay."""
    m, i, p = F.col(mzs), F.col(intensities), F.col(precursor).cast("double")
    pairs = peaks(m, i)
    kept = F.filter(pairs, lambda x: x["i"] > 0) if drop_zero else pairs
    if max_peaks is not None:
        first = F.slice(F.sort_array(F.transform(kept, lambda x: F.struct((-x["i"]).alias("s"), x["mz"].alias("mz"), x["i"].alias("i")))), 1, max_peaks)
        kept = F.transform(first, lambda x: F.struct(x["mz"].alias("mz"), x["i"].alias("i")))
    if drop_zero:
        most = bound(kept, lambda k: F.array_max(F.transform(k, lambda x: x["i"])))
    else:
        most = F.array_max(i).cast("double")
    status = (
        F.when(m.isNull() | i.isNull() | (F.size(m) != F.size(i)), "shape_mismatch")
        .when(F.size(m) == 0, "empty")
        .when(~finite(m) | ~finite(i), "non_finite")
        .when(F.array_min(m) <= 0, "non_positive_mz")
        .when(p.isNull() | F.isnan(p) | (p <= 0) | (p >= max_precursor), "bad_precursor")
        .when(F.size(kept if drop_zero else m) < min_peaks, "too_few_peaks")
        .when(most <= 0, "no_intensity")
        .otherwise("ok")
    )
    both = F.struct(F.sort_array(kept).alias("p"), most.alias("top"))
    scaled = bound(both, lambda b: F.transform(b["p"], lambda x: F.struct(x["mz"].alias("mz"), (x["i"] / b["top"]).alias("i"))))
    return df.withColumn("status", status).withColumn("canon", F.when(F.col("status") == "ok", scaled))


def strongest(mzs: Column, intensities: Column, k: int) -> Column:
    """The k strongest peaks, then by mass."""
    return F.slice(F.sort_array(F.transform(peaks(mzs, intensities), lambda x: F.struct((-x["i"]).alias("neg"), x["mz"].alias("mz"), x["i"].alias("i")))), 1, k)


def entropy(intensities: Column) -> Column:
    """-sum p ln(p + 1e-10) over the shares of the intensities; 0 without any."""

    def of(b: Column) -> Column:
        share = lambda x: x.cast("double") / b["s"]
        return F.when(b["s"] > 0, -F.aggregate(b["v"], F.lit(0.0), lambda a, x: a + share(x) * F.log(share(x) + 1e-10))).otherwise(0.0)

    return bound(F.struct(intensities.alias("v"), total(intensities).alias("s")), of)


def normalised(intensities: Column) -> Column:
    """Divided by the largest; unchanged if that is not positive."""
    top = F.array_max(intensities).cast("double")
    both = F.struct(intensities.alias("v"), F.when(top > 0, top).otherwise(1.0).alias("top"))
    return bound(both, lambda b: F.transform(b["v"], lambda x: x.cast("double") / b["top"]))


def binned(df: DataFrame, key: str, mzs: str, intensities: str, low: float = 0.0, high: float = 2000.0, width: float = 0.1) -> DataFrame:
    """Summed intensity per key and bin of the mass grid, as sparse rows; masses outside go to the outer bins."""
    last = int(round((high - low) / width)) - 1
    p = df.select(key, F.explode(peaks(F.col(mzs), F.col(intensities))).alias("p"))
    bin_ = F.greatest(F.lit(0), F.least(F.floor((F.col("p.mz") - low) / width), F.lit(last))).cast("int")
    return p.groupBy(key, bin_.alias("bin")).agg(F.sum("p.i").alias("intensity"))


def fitted(values: Column, n: int) -> Column:
    """Cut or padded with zeros to n."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), n)), 1, n)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column) -> Column:
    return bound(F.struct(a.alias("v"), (norm(a) + 1e-8).alias("n")), lambda b: F.transform(b["v"], lambda x: x.cast("double") / b["n"]))


def nearest(x: Column, places: int) -> Column:
    """x rounded to decimal places as C and SQL engines on it do: the binary product with the power of ten, halves away from zero, and the sign
    of a zero kept. F.round takes the shortest decimal form instead and knows no negative zero. Numbers without a fraction stay."""
    scaled = F.abs(x) * 10.0**places
    low = F.floor(scaled).cast("double")
    return F.when(scaled >= 2.0**52, x).otherwise(F.signum(x) * (low + F.when(scaled - low >= 0.5, 1.0).otherwise(0.0)) / 10.0**places)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))
