"""The sharded sink: rotation by bytes, commits that show all or nothing, failing and repeated tasks."""

import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.sources import shards, sink


def files_below(path):
    return sorted(f"{d}/{f}" for d, _, names in os.walk(path) for f in names if not f.startswith("."))


def test_shards_end_with_the_row_that_reaches_the_limit(spark, tmp_path):
    df = spark.range(4000).select("id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.array("id", "id").alias("v")).repartition(3, "id").sortWithinPartitions("id")
    rows = sink.save_shards(df, f"{tmp_path}/s", 20_000, "d", "r1").orderBy("shard_index").collect()
    assert [r.shard_index for r in rows] == list(range(len(rows))) and len(rows) > 9 and sum(r.num_samples for r in rows) == 4000
    small = 0
    for r in rows:
        assert r.row_bytes < 20_000 + 200
        small += r.row_bytes < 20_000
        table = pq.read_table(f"{tmp_path}/s/data/{r.file}")
        assert table.num_rows == r.num_samples and os.path.getsize(f"{tmp_path}/s/data/{r.file}") == r.bytes
    assert small <= 3  # the last shard of each task
    assert sorted(map(tuple, sink.load_shards(spark, f"{tmp_path}/s").collect())) == sorted(map(tuple, df.collect()))
    assert shards.verify(spark, f"{tmp_path}/s").collect() == [] and not os.path.exists(f"{tmp_path}/s/_staging")


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    """The last rows of one task fail, after it has written whole shards and other tasks have ended."""
    broken = F.when(F.col("id") == 1999, F.raise_error(F.lit("broken row"))).otherwise(F.col("id"))
    df = spark.range(2000).repartitionByRange(4, "id").sortWithinPartitions("id").select(broken.alias("id"), F.repeat(F.lit("y"), 40).alias("t"))
    with pytest.raises(Exception, match="broken row"):
        sink.save_shards(df, f"{tmp_path}/s", 1000)
    assert files_below(f"{tmp_path}/s") == []
    sink.save_shards(spark.range(10), f"{tmp_path}/s", run_id="one")
    before = files_below(f"{tmp_path}/s")
    with pytest.raises(Exception, match="broken row"):
        sink.save_shards(df.select(F.col("id").cast("long").alias("id")), f"{tmp_path}/s", 1000, run_id="two", mode="overwrite")
    assert files_below(f"{tmp_path}/s") == before and shards.verify(spark, f"{tmp_path}/s").collect() == []


def test_files_of_attempts_that_did_not_succeed_stay_out(spark, tmp_path):
    """A task attempt that wrote and died, and one that succeeded: only the latter's message reaches the commit."""
    writer = sink.ShardWriter({"path": str(tmp_path / "s")}, spark.range(1).schema, False)
    os.makedirs(writer.staging)
    pq.write_table(spark.range(3).toArrow(), f"{writer.staging}/0-7-0.parquet")
    pq.write_table(spark.range(3).toArrow(), f"{writer.staging}/0-8-0.parquet")
    writer.commit([sink.Shards(0, [("0-8-0.parquet", 3, 1, 24, "x")]), None])
    assert len(files_below(tmp_path / "s" / "data")) == 1 and sink.load_shards(spark, f"{tmp_path}/s").count() == 3 and not os.path.exists(writer.staging)


def test_append_overwrite_and_crash_before_the_manifest(spark, tmp_path):
    sink.save_shards(spark.range(5), f"{tmp_path}/s", run_id="a")
    rows = sink.save_shards(spark.range(5, 12), f"{tmp_path}/s", run_id="b").collect()
    assert {(r.run_id, r.shard_index) for r in rows} >= {("a", 0)} and len({r.shard_index for r in rows}) == len(rows)
    assert sink.load_shards(spark, f"{tmp_path}/s").count() == 12
    pq.write_table(spark.range(3).toArrow(), f"{tmp_path}/s/data/part-99999-dead.parquet")  # moved, but never published
    assert sink.load_shards(spark, f"{tmp_path}/s").count() == 12
    assert [r.problem for r in shards.verify(spark, f"{tmp_path}/s").collect()] == ["unlisted"]
    sink.save_shards(spark.range(2), f"{tmp_path}/s", run_id="c", mode="overwrite")
    assert sink.load_shards(spark, f"{tmp_path}/s").count() == 2
    assert [json.loads(x)["run_id"] for f in files_below(tmp_path / "s" / "manifest") for x in open(f)] and len(files_below(tmp_path / "s" / "manifest")) == 1
