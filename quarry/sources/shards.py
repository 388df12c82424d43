"""Sharded datasets: a sink with manifest and checksums, rebalancing, verification, versions by content."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sink import SCHEMA_VERSION, save_shards, system_of

#: Bytes of a file that a checksum takes at a time, and rows whose size as JSON gives the mean size of a row.
PIECE_BYTES, SIZED_ROWS = 1 << 20, 10_000


def row_bytes(df: DataFrame) -> Column:
    """An estimate of a row's size: the length of its JSON."""
    return F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))


def sha256_of_files(spark: SparkSession, path: str, pattern: str = "*.parquet", keep_path: bool = False) -> DataFrame:
    """(file, bytes, sha256) of the files below a path. Executors read each file as a stream of small pieces, through the file system library
    of Arrow for its path's scheme, so that no file is ever a cell of a table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    listed = files.select("path", F.col("length").alias("bytes"))

    def run(batches):
        for batch in batches:
            digests = []
            for name in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                system, inner = system_of(name)
                with system.open_input_stream(inner) as stream:
                    while piece := stream.read(PIECE_BYTES):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "bytes", "sha256"])

    out = listed.mapInArrow(run, "path string, bytes long, sha256 string")
    more = [F.col("path").alias("full")] if keep_path else []
    return out.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256", *more)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of every data file below a path, read by the executors."""
    return sha256_of_files(spark, path)


def write_shards(df: DataFrame, path: str, key: str, shard_bytes: int = 1 << 30, dataset: str = "dataset", run_id: str = "run", rules: dict[str, Column] | None = None, quarantine: str | None = None) -> DataFrame:
    """Writes one row per key (the first by all columns) in shards that a task ends when their rows reach shard_bytes, and a manifest, which is
    published last: see sink.py. Null keys raise. rules are conditions that a row must meet: rows that fail one go, with the first such rule's name as `fault`, to the quarantine folder, or raise
    without one. Returns the manifest: dataset, run_id, shard_index, file, num_samples, bytes, sha256, schema_version."""
    from ..operators.contracts import quarantined

    spark = df.sparkSession
    rows = df
    if rules:
        judged = quarantined(df, rules)
        if quarantine:
            judged.where("fault IS NOT NULL").write.mode("append").parquet(quarantine)
            rows = judged.where("fault IS NULL").drop("fault")
        else:
            told = F.raise_error(F.concat(F.lit("a row fails "), F.col("fault")))
            rows = judged.withColumn(key, F.when(F.col("fault").isNotNull(), told).otherwise(F.col(key))).drop("fault")
    checked = rows.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit(f"{key} is null"))).otherwise(F.col(key)))
    once = checked.groupBy(key).agg(F.min(F.struct(*[c for c in df.columns if c != key])).alias("_r")).select(key, "_r.*").select(*df.columns)
    mean = df.limit(SIZED_ROWS).agg(F.avg(row_bytes(df))).first()[0] or 0.0
    tasks = max(1, math.ceil(mean * rows.select(key).distinct().count() / shard_bytes))
    return save_shards(once.repartitionByRange(tasks, key).sortWithinPartitions(key), path, shard_bytes, dataset, run_id)


def describe(spark: SparkSession, path: str, dataset: str = "dataset", run_id: str = "run") -> DataFrame:
    """The manifest of what lies below path/data."""
    counts = spark.read.parquet(f"{path}/data").groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(F.count("*").alias("num_samples"))
    rows = checksums(spark, f"{path}/data").join(counts, "file", "left").na.fill(0, ["num_samples"])
    index = F.regexp_extract("file", r"part-(\d+)", 1).cast("int")
    return rows.select(F.lit(dataset).alias("dataset"), F.lit(run_id).alias("run_id"), index.alias("shard_index"), "file", "num_samples", "bytes", "sha256", F.lit(SCHEMA_VERSION).alias("schema_version"))


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Shards whose file is missing, unlisted or has another checksum than the manifest says: (file, problem)."""
    listed = spark.read.json(f"{path}/manifest").select("file", F.col("sha256").alias("want"))
    found = checksums(spark, f"{path}/data").select("file", F.col("sha256").alias("have"))
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "checksum")
    return listed.join(found, "file", "full").select("file", problem.alias("problem")).where("problem IS NOT NULL")


def rebalance(spark: SparkSession, path: str, out: str, key: str, shard_bytes: int) -> int:
    """Writes the shards anew in files of about shard_bytes, as measured on disk; returns how many were asked for."""
    total = checksums(spark, f"{path}/data").agg(F.sum("bytes")).first()[0] or 0
    n = max(1, math.ceil(total / shard_bytes))
    spark.read.parquet(f"{path}/data").repartitionByRange(n, key).sortWithinPartitions(key).write.option("compression", "zstd").parquet(f"{out}/data")
    describe(spark, out).write.mode("overwrite").json(f"{out}/manifest")
    return n


def dataset_hash(manifest: DataFrame) -> DataFrame:
    """One hash of all shards, whatever their order: the manifest has a row per file, not per record."""
    return manifest.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256")), ""), 256).alias("dataset_hash"))


def copy_tree(spark: SparkSession, source: str, target: str) -> None:
    """A snapshot copy by the file systems of the two paths."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)


def runs(manifests: DataFrame, run_id: str | None = None) -> DataFrame:
    """Shards and samples per run, largest first."""
    rows = manifests if run_id is None else manifests.where(F.col("run_id") == run_id)
    return rows.groupBy("dataset", "run_id").agg(F.count("*").alias("shards"), F.sum("num_samples").alias("samples"), F.sum("bytes").alias("bytes")).orderBy(F.desc("samples"), "run_id")
