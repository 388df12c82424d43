"""Stateful streams against batch results, over several batches."""

from pyspark.sql import functions as F

from quarry.operators import operations as O
from quarry.streaming import stateful as S


def in_files(spark, df, folder, n=3):
    df.repartition(n).write.parquet(f"{folder}/t.parquet")
    return S.stream_of(spark, str(folder), "t", files_per_batch=1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_windows_and_totals(spark, tmp_path):
    events = spark.range(300).select("id", F.timestamp_seconds(F.col("id") * 37).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    stream = in_files(spark, events, tmp_path)
    assert rows_of(S.drained(S.window_counts(stream, "ts", 600, ("k",), "v"), "complete")) == rows_of(S.window_counts(events, "ts", 600, ("k",), "v"))
    assert rows_of(S.drained(S.metric_totals(stream, ("k",), "v"), "complete")) == rows_of(S.metric_totals(events, ("k",), "v"))


def test_first_seen_across_batches(spark, tmp_path):
    events = spark.range(90).select((F.col("id") % 7).alias("k"))
    assert rows_of(S.drained(S.first_seen(in_files(spark, events, tmp_path), ("k",)))) == [(i,) for i in range(7)]


def test_limit_in_one_batch_equals_the_ordered_fold(spark, tmp_path):
    hits = spark.range(200).select((F.col("id") % 4).alias("k"), (F.col("id") * 3 % 101).cast("double").alias("t"), F.col("id").alias("i"))
    got = S.drained(S.limited(in_files(spark, hits, tmp_path, 1), "k", "t", "i", 10.0, 2))
    assert rows_of(got.select("k", "i", "allowed")) == rows_of(O.sliding_log_limit(hits, "k", "t", "i", 10, 2).select("k", "i", "allowed"))


def test_limit_keeps_its_log_between_batches(spark, tmp_path):
    for n, times in enumerate([[0.0, 1.0, 2.0], [11.0, 11.5, 11.6]]):
        spark.createDataFrame([("a", t, int(t * 10)) for t in times], "k string, t double, i long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    stream = S.stream_of(spark, str(tmp_path), "t", files_per_batch=1)
    got = {r.i: r.allowed for r in S.drained(S.limited(stream, "k", "t", "i", 10.0, 2)).collect()}
    assert got[0] and got[10] and not got[20]
    assert got[110] and got[115] and not got[116]


def test_drift_of_the_last_values(spark, tmp_path):
    values = spark.range(400).select(F.lit("f").alias("feature"), (F.col("id") % 5 + 11).cast("double").alias("value"))
    got = S.drained(S.drift_windows(in_files(spark, values, tmp_path, 2), "feature", "value", {"f": [1.0, 2.0, 3.0, 4.0, 5.0]}, size=150)).collect()
    assert [r.n for r in got] == [150, 150] and all(r.distance == 1.0 for r in got)
    assert S.ks_distance([1, 2, 3], [1, 2, 3]) == 0.0


def test_empty_stream(spark, tmp_path):
    empty = spark.createDataFrame([], "k long, v double")
    assert S.drained(S.metric_totals(in_files(spark, empty, tmp_path, 1), ("k",), "v"), "complete").count() == 0
