"""Tumbling drift on a stream against the batch operator, for any split into files, and over a restart."""

import math

from pyspark.sql import functions as F

from quarry.operators import spectra as P
from quarry.streaming import stateful as S
from quarry.streaming import tumbling as T

SIZE = 40
COLUMNS = ["window", "peaks_ks", "peaks_p", "mass_ks", "mass_p", "gap", "adduct_chi2", "adduct_p", "drift"]


def spectra(spark, n=330):
    k = F.col("id")
    adduct = F.when((k > 250) & (k % 9 == 0), "new").otherwise(F.concat(F.lit("a"), (k * 7 % 3).cast("string")))
    return spark.range(n).select("id", (k % 17 + F.when(k > 200, 5).otherwise(0)).alias("peaks"), (k * 31 % 23 + 0.5).alias("mass"), F.array(k % 5 + 0.0, k % 7 + 0.5, F.when(k > 100, k % 3 + 9.0)).alias("ints"), adduct.alias("adduct"))


def near(got, want):
    assert len(got) == len(want) and got
    for a, b in zip(sorted(got), sorted(want)):
        assert all(x == y or x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a, b)), (a, b)


def batch_rows(df, n):
    out = P.semantic_drift(df, "id", SIZE, "peaks", "mass", "ints", ("adduct",)).where(F.col("window") < n // SIZE)
    return [tuple(r) for r in out.select("window", "peaks_ks", "peaks_p", F.col("precursor_ks"), "precursor_p", "intensity_gap", "adduct_chi2", "adduct_p", "drift").collect()]


def stream_rows(spark, folder):
    rows = S.stream_of(spark, str(folder), "t", files_per_batch=1).withColumn("key", F.lit("all"))
    return T.tumbling_drift(rows, "key", "id", SIZE, ("peaks", "mass"), "ints", ("adduct",))


def write(df, folder, cuts):
    """A file per range of ids, in order of time."""
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        df.where((F.col("id") >= a) & (F.col("id") < b)).coalesce(1).write.mode("append").parquet(f"{folder}/t.parquet")


def test_same_rows_for_any_split_into_files(spark, tmp_path):
    df = spectra(spark)
    want = batch_rows(df, 330)
    assert {r[0] for r in want} == set(range(1, 8)) and any(r[-1] for r in want) and not all(r[-1] for r in want) and any(r[-2] is None for r in want)
    for n, cuts in enumerate(([0, 330], [0, 39, 41, 119, 300, 330])):
        write(df, tmp_path / str(n), cuts)
        with T.rocks_state(spark):
            got = S.drained(stream_rows(spark, tmp_path / str(n))).select(*COLUMNS).collect()
        near([tuple(r) for r in got], want)


def test_restart_from_the_checkpoint(spark, tmp_path):
    """A query that ends in the middle of a window goes on where it stood."""
    df, out = spectra(spark), []
    want = batch_rows(df, 330)
    for cuts in ([0, 30, 101], [101, 190, 330]):
        write(df, tmp_path / "in", cuts)
        with T.rocks_state(spark):
            query = stream_rows(spark, tmp_path / "in").writeStream.foreachBatch(lambda b, _: out.extend(b.select(*COLUMNS).collect())).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    near([tuple(r) for r in out], want)
