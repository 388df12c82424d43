"""Spectra as tables: shard statistics, quantiles of peaks, semantic drift by window, and measures of predicted structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from . import statistics as S

# Numbers of the known adducts and instruments; 0 is any other.
ADDUCTS = {"[M+H]+": 1, "[M+Na]+": 2, "[M-H]-": 3}
INSTRUMENTS = {"Orbitrap": 1, "QTOF": 2, "FTICR": 3}


def category_id(value: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), F.lit(0))


def shard_statistics(df: DataFrame, shard: str, mzs: str = "mzs", intensities: str = "intensities", precursor: str = "precursor_mz", fields: tuple[str, ...] = ()) -> DataFrame:
    """Per shard: rows, numbers of peaks (min, max, mean), ranges of masses and intensities, precursor measures, and the share of rows that
    have each field. Empty spectra count as no peaks and widen no range."""
    peaks = F.size(mzs)
    return df.groupBy(shard).agg(
        F.count("*").alias("n"), F.min(peaks).alias("min_peaks"), F.max(peaks).alias("max_peaks"), F.avg(peaks).alias("mean_peaks"),
        F.min(F.array_min(mzs)).alias("min_mz"), F.max(F.array_max(mzs)).alias("max_mz"), F.min(F.array_min(intensities)).alias("min_intensity"), F.max(F.array_max(intensities)).alias("max_intensity"),
        F.min(precursor).alias("min_precursor"), F.max(precursor).alias("max_precursor"), F.avg(precursor).alias("mean_precursor"),
        *[F.try_divide(F.count(c), F.count("*")).alias(f"{c}_completeness") for c in fields],
    )


def shard_value_counts(df: DataFrame, shard: str, fields: tuple[str, ...]) -> DataFrame:
    """(shard, field, value, n): how often each charge, adduct or other label occurs in a shard. Nulls are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
    return df.select(shard, F.inline(pairs)).where("value IS NOT NULL").groupBy(shard, "field", "value").agg(F.count("*").alias("n"))


def peak_counts(df: DataFrame, by: tuple[str, ...], mzs: str = "mzs") -> DataFrame:
    """The median number of peaks, by counted values."""
    return S.quantiles(df.select(*by, F.size(mzs).alias("_n")), "_n", {"median_peaks": 0.5}, by)


def intensity_quantiles(df: DataFrame, by: tuple[str, ...] = (), intensities: str = "intensities") -> DataFrame:
    """Interpolated quantiles of all peaks' intensities. The exploded values are counted and placed in buckets; none is collected."""
    values = df.select(*by, F.explode(F.col(intensities).cast("array<double>")).alias("_v"))
    return S.quantiles(values, "_v", {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}, by)


def complexity(df: DataFrame, mzs: str = "mzs") -> DataFrame:
    """Mean and greatest number of peaks with a positive mass."""
    valid = F.size(F.filter(mzs, lambda m: m > 0))
    return df.agg(F.avg(valid).alias("avg_peaks"), F.max(valid).alias("max_peaks"), F.count("*").alias("n"))


def low_entropy(intensities: Column, threshold: float = 0.5, least: int = 10) -> Column:
    """Whether ten peaks or more have an entropy below the threshold."""
    return (F.size(intensities) >= least) & (A.entropy(intensities) < threshold)


def filter_low_entropy(df: DataFrame, most: int, threshold: float = 0.5, mzs: str = "mzs", intensities: str = "intensities") -> DataFrame:
    """Spectra of low entropy keep their `most` strongest peaks, in the order of mass; others keep all. low_entropy tells which is which."""
    m, i = F.col(mzs), F.col(intensities)
    few = F.sort_array(F.transform(A.strongest(m, i, most), lambda p: F.struct(p["mz"].alias("mz"), p["i"].alias("i"))))
    out = df.withColumn("low_entropy", low_entropy(i, threshold)).withColumn("_p", F.when(F.col("low_entropy"), few).otherwise(A.peaks(m, i)))
    return out.withColumns({mzs: F.transform("_p", lambda p: p["mz"]), intensities: F.transform("_p", lambda p: p["i"])}).drop("_p")


def semantic_drift(df: DataFrame, order: str, size: int, peaks: str, precursor: str, intensities: str, categories: tuple[str, ...], p_limit: float = 0.01, gap_limit: float = 0.1) -> DataFrame:
    """Per run of `size` rows in order, against the first run: KS statistics and p-values of peak counts and precursors, the largest gap of
    the intensity quartiles, chi-square of each category, and the reasons for drift. order: an integer that counts rows. A category that
    the first run lacks counts as drift."""
    w = df.withColumn("window", F.floor(F.col(order) / size).cast("long"))
    out = None
    for name, value in (("peaks", F.col(peaks)), ("precursor", F.col(precursor))):
        both = S.windowed_drift(df.select(F.col(order), value.cast("double").alias("v")), "v", order, size, first=True)
        part = both.select("window", F.col("ks").alias(f"{name}_ks"), S.ks_p(F.col("ks"), F.col("n_reference"), F.col("n")).alias(f"{name}_p"))
        out = part if out is None else out.join(part, "window")
    q = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    exploded = w.select("window", F.explode(F.col(intensities).cast("array<double>")).alias("v"))
    all_q = S.quantiles(exploded, "v", q, ("window",))
    base = all_q.where("window = 0").select(*[F.col(c).alias(f"b_{c}") for c in q])
    gap = all_q.where("window > 0").join(F.broadcast(base), how="cross").select("window", F.greatest(*[F.abs(F.col(c) - F.col(f"b_{c}")) for c in q]).alias("intensity_gap"))
    out = out.join(gap, "window")
    reasons = [F.when(F.col("peaks_p") < p_limit, "peak counts"), F.when(F.col("precursor_p") < p_limit, "precursor masses"), F.when(F.col("intensity_gap") > gap_limit, "intensity quantiles")]
    for c in categories:
        out = out.join(category_drift(w, c), "window")
        reasons.append(F.when(F.coalesce(F.col(f"{c}_p") < p_limit, F.lit(True)), c))
    return out.withColumn("reasons", F.array_compact(F.array(*reasons))).withColumn("drift", F.size("reasons") > 0)


def category_drift(w: DataFrame, column: str) -> DataFrame:
    """(window, chi2, p) of each later window's counts against the first one's shares; null where the first lacks a value. With e the expected
    counts, which add up to a window's rows, the sum of (n - e)^2 / e is that of n^2 / e less the rows: values that a window lacks need no row."""
    counts = w.where(F.col(column).isNotNull()).groupBy("window", F.col(column).alias("v")).agg(F.count("*").alias("n"))
    base = counts.where("window = 0").select("v", F.col("n").alias("b"))
    whole = base.agg(F.sum("b").alias("base"), (F.count("*") - 1).alias("dof"))
    cells = counts.where("window > 0").join(base, "v", "left")
    by = cells.groupBy("window").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n") / F.col("b")).alias("x"), F.count_if(F.col("b").isNull()).alias("new"))
    out = by.join(F.broadcast(whole), how="cross")  # one row
    known, x = F.col("new") == 0, F.greatest(F.col("x") * F.col("base") / F.col("size") - F.col("size"), F.lit(0.0))
    return out.select("window", F.when(known, x).alias(f"{column}_chi2"), F.when(known, S.chi_square_p(x, F.col("dof"))).alias(f"{column}_p"))


def exact_at_k(truth: Column, ranked: Column, k: int) -> Column:
    """Whether the truth is among the first k predictions."""
    return F.coalesce(F.array_contains(F.slice(ranked, 1, k), truth), F.lit(False))


def coverage(truth: Column, low: Column, high: Column) -> Column:
    """The share of true values inside their prediction interval, bounds included."""
    return F.avg(F.coalesce(((truth >= low) & (truth <= high)).cast("double"), F.lit(0.0)))


def mass_error_ppm(predicted: Column, true: Column) -> Column:
    return F.try_divide((predicted - true), true) * 1e6


def reduction_factor(before: Column, after: Column) -> Column:
    """Candidates before a filter to those after it; null where none is left."""
    return F.try_divide(before.cast("double"), after)
