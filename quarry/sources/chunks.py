"""A store by content: files in chunks whose borders follow the content, each kept once under its SHA-256, and versions as hash trees.

A chunk ends where a rolling hash of the last 64 bytes has its top bits zero, between a least and a most size; so an edit changes the chunks around it,
and the others stay where they are in the store. Executors read each file as a stream, cut and hash it, and put the chunks that the store lacks into
it; no byte of a file goes through the driver. A chunk is written under another name and renamed when it is whole; a version is written after all of its
chunks. So a commit that is interrupted leaves at most chunks that no version asks for.

A file's root is the hash of its chunks' hashes, in groups of `FAN`, up to one; a version's root is that of a tree of its files' roots by the digits of
the hash of their paths.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sink import system_of

#: Least, mean (a power of two) and most bytes of a chunk, bytes read at a time, and hashes in a node of the tree.
LEAST, MEAN, MOST, PIECE, FAN = 64 << 10, 256 << 10, 1 << 20, 4 << 20, 1024
WINDOW = 64
#: Tasks that the files of a commit are dealt to, at most.
TASKS = 10_000
VERSION_SCHEMA = "name string, version string, path string, size long, root string, metadata string, parent string"
CHUNK_SCHEMA = "path string, seq long, bytes long, sha256 string"

_GEAR = np.random.default_rng(41).integers(0, (1 << 64) - 1, 256, dtype=np.uint64, endpoint=True)


def rolling(data: np.ndarray) -> np.ndarray:
    """For each byte the sum of the gear values of the 64 bytes up to it, each shifted by its distance: by doubling the window six times."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        more = h.copy()
        more[width:] += h[:-width] << np.uint64(width)
        h, width = more, 2 * width
    return h


def cuts(stream, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> Iterator[bytes]:
    """The chunks of a stream. Where one ends depends on the bytes from its beginning on alone."""
    bound, held, marks, done = np.uint64((1 << 64) // mean), b"", np.zeros(0, dtype=np.int64), False
    while not done:
        piece = stream.read(PIECE)
        done = not piece
        known = len(held)
        held += piece
        if piece:
            back = max(0, known - WINDOW + 1)
            h = rolling(np.frombuffer(held, dtype=np.uint8)[back:])[known - back :]
            marks = np.concatenate([marks, known + 1 + np.flatnonzero(h < bound)])
        at = 0
        while len(held) - at >= most or (done and at < len(held)):
            spot = np.searchsorted(marks, at + least)
            end = min(int(marks[spot]) if spot < len(marks) else len(held), at + most, len(held))
            yield held[at:end]
            at = end
        held, marks = held[at:], marks[marks > at] - at


def store_chunk(system: pa_fs.FileSystem, store: str, data: bytes) -> str:
    """Puts a chunk into the store unless it is there; returns its hash."""
    name = hashlib.sha256(data).hexdigest()
    target = f"{store}/blobs/{name}"
    if system.get_file_info(target).type == pa_fs.FileType.NotFound:
        system.create_dir(f"{store}/blobs", recursive=True)
        system.create_dir(f"{store}/partial", recursive=True)
        part = f"{store}/partial/{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(data)
        system.move(part, target)
    return name


def chunked(spark: SparkSession, source: str, store: str, sizes: tuple[int, int, int]) -> DataFrame:
    """(path, seq, bytes, sha256) of the chunks of all files below source, which are in the store then. An empty file has one empty chunk."""
    base = str(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source).toUri().getPath()).rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source).inputFiles()  # Spark's own index; its scan leaves out empty files
    names = [(unquote(x), unquote(x).partition(f"{base}/")[2]) for x in listed]
    files = spark.createDataFrame(names, "path string, name string").repartition(max(1, min(len(names), TASKS)))

    def run(batches):
        for batch in batches:
            for full, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                to, root = system_of(store)
                system, inner = system_of(full)
                with system.open_input_stream(inner) as stream:
                    found = [(len(c), store_chunk(to, root, c)) for c in cuts(stream, *sizes)] or [(0, store_chunk(to, root, b""))]
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found])], ["path", "seq", "bytes", "sha256"])

    return files.mapInArrow(run, CHUNK_SCHEMA)


def roots(chunks: DataFrame) -> DataFrame:
    """(path, size, root): the hash tree of each file, a level of groups at a time."""
    level, most = chunks.select("path", "seq", F.col("sha256").alias("h")), chunks.agg(F.max("seq")).first()[0] or 0
    first = True
    while first or most:
        own = F.array_sort(F.collect_list(F.struct("seq", "h")))  # FAN at most
        level = level.groupBy("path", F.floor(F.col("seq") / FAN).alias("up")).agg(F.sha2(F.array_join(F.transform(own, lambda x: x["h"]), ""), 256).alias("h"))
        level = level.select("path", F.col("up").alias("seq"), "h")
        most, first = most // FAN, False
    sizes = chunks.groupBy("path").agg(F.sum("bytes").alias("size"))
    return sizes.join(level.select("path", F.col("h").alias("root")), "path")


def tree(files: DataFrame) -> DataFrame:
    """(prefix, h) of the nodes of a version's tree: files by four, then two, then no digits of the hash of their path."""
    level = files.select(F.sha2("path", 256).alias("k"), F.sha2(F.concat_ws(":", "path", F.col("size").cast("string"), "root"), 256).alias("h"))
    out = None
    for digits in (4, 2, 0):
        own = F.array_sort(F.collect_list(F.struct("k", "h")))
        level = level.groupBy(F.substring("k", 1, digits).alias("k2")).agg(F.sha2(F.array_join(F.transform(own, lambda x: x["h"]), ""), 256).alias("h")).select(F.col("k2").alias("k"), "h")
        out = level if out is None else out.unionByName(level)
    return out.select(F.col("k").alias("prefix"), "h")


def commit(spark: SparkSession, name: str, source: str, store: str, metadata: dict | None = None, parent: str | None = None, sizes: tuple[int, int, int] = (LEAST, MEAN, MOST)) -> str:
    """Puts the files below source into the store and writes the version: a row per file, and a row per chunk. Returns its id, the hash of name,
    metadata, parent and the root of its tree; equal files give an equal id."""
    about = json.dumps({"name": name, "metadata": metadata or {}, "parent": parent}, sort_keys=True)
    staged = f"{store}/staged/{uuid.uuid4().hex}"
    chunked(spark, source, store, sizes).write.parquet(staged)
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(staged)
    files = roots(chunks)
    top = tree(files).where("prefix = ''").first()
    version = hashlib.sha256((about + (top.h if top else "")).encode()).hexdigest()
    folder = f"{store}/versions/{name}/{version}"
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    out = files.select(F.lit(name).alias("name"), F.lit(version).alias("version"), "path", "size", "root", F.lit(json.dumps(metadata or {}, sort_keys=True)).alias("metadata"), F.lit(parent).cast("string").alias("parent"))
    out.write.mode("overwrite").json(f"{folder}/files")
    system, root = system_of(staged)
    system.delete_dir(root)
    return version


def version_files(spark: SparkSession, name: str, version: str, store: str) -> DataFrame:
    return spark.read.schema(VERSION_SCHEMA).json(f"{store}/versions/{name}/{version}/files")


def changes(spark: SparkSession, name: str, old: str, new: str, store: str) -> DataFrame:
    """(path, change): added, removed or changed files between two versions. Only files below differing nodes of the trees are compared."""
    a, b = (version_files(spark, name, v, store) for v in (old, new))
    nodes = [tree(x).where("length(prefix) = 4").select("prefix", F.col("h").alias(f"h{i}")) for i, x in enumerate((a, b))]
    apart = nodes[0].join(nodes[1], "prefix", "full").where("NOT (h0 <=> h1)").select("prefix")
    sides = [x.withColumn("prefix", F.substring(F.sha2("path", 256), 1, 4)).join(apart, "prefix", "left_semi").select("path", F.col("root").alias(f"r{i}")) for i, x in enumerate((a, b))]
    kind = F.when(F.col("r0").isNull(), "added").when(F.col("r1").isNull(), "removed").when(F.col("r0") != F.col("r1"), "changed")
    return sides[0].join(sides[1], "path", "full").select("path", kind.alias("change")).where("change IS NOT NULL")


def checkout(spark: SparkSession, name: str, version: str, store: str, target: str) -> int:
    """Puts the files of a version together below target, by the executors; a file has its name when it is whole and its chunks have their
    hashes. Returns their number."""
    files = version_files(spark, name, version, store).select("path", "size")
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(f"{store}/versions/{name}/{version}/chunks")
    lists = chunks.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sha256"))), lambda x: x["sha256"]).alias("parts"))

    def run(batches):
        for batch in batches:
            for path, size, parts in zip(*(c.to_pylist() for c in batch.columns)):
                system, root = system_of(store)
                to, out = system_of(f"{target}/{path}")
                to.create_dir(out.rpartition("/")[0], recursive=True)
                part, n = f"{out}.{uuid.uuid4().hex}.partial", 0
                with to.open_output_stream(part) as stream:
                    for sha in parts:
                        with system.open_input_stream(f"{root}/blobs/{sha}") as blob:
                            data = blob.read()
                        if hashlib.sha256(data).hexdigest() != sha:
                            raise ValueError(f"chunk {sha} of {path} is damaged")
                        stream.write(data)
                        n += len(data)
                if n != size:
                    raise ValueError(f"{path} has {n} bytes, not {size}")
                to.move(part, out)
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["path"])

    return files.join(lists, "path").select("path", "size", "parts").mapInArrow(run, "path string").count()
