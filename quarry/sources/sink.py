"""A sharded Parquet sink with a two-phase commit, as a Spark data source.

Tasks write their rows in files of a staging folder of the job and begin a new one when the rows in it have reached `shard_bytes` (as Arrow holds
them): a shard is over the limit by less than a row, and only a task's last one is smaller. Each file's SHA-256 is taken from the bytes as they are
written. What a task hands to the driver is a line per file. Only the driver makes the staging folder, so that tasks of a job that was aborted, which may
live on for a while, find none. The driver's commit moves the files of the tasks that succeeded to their names and
then publishes the manifest, by one rename: until then no reader of the manifest sees anything. An aborted job leaves no file; what failed
attempts of tasks have written goes with the staging folder.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pa_fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "quarry_shards"
MANIFEST_SCHEMA = "dataset string, run_id string, shard_index int, file string, num_samples long, bytes long, row_bytes long, sha256 string, schema_version int"
SCHEMA_VERSION = 1


def system_of(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path as Spark writes it, without escapes, and the path on it."""
    if re.match(r"file:/|/", path):
        return pa_fs.LocalFileSystem(), re.sub(r"^(file:)?/+", "/", path)
    scheme, _, rest = path.partition("://")
    return pa_fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@')}")


class Hashed:
    """An output stream that takes the digest of what goes through."""

    def __init__(self, stream):
        self.stream, self.digest, self.size, self.closed = stream, hashlib.sha256(), 0, False

    def write(self, data) -> int:
        data = memoryview(data)
        self.digest.update(data)
        self.size += len(data)
        self.stream.write(data)
        return len(data)

    def flush(self) -> None:
        self.stream.flush()

    def tell(self) -> int:
        return self.size

    def writable(self) -> bool:
        return True

    def readable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False

    def close(self) -> None:
        self.closed = True
        self.stream.close()


@dataclass
class Shards(WriterCommitMessage):
    """(staged file, rows, bytes on disk, bytes of its rows, sha256) of a task's files."""

    part: int = 0
    files: list = field(default_factory=list)


def fits(batch: pa.RecordBatch, at: int, room: int) -> int:
    """The number of rows from `at` on that reach `room` bytes, or all that are left."""
    low, high = 1, batch.num_rows - at
    if high < 1 or batch.slice(at, high).nbytes < room:
        return high
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if batch.slice(at, mid).nbytes >= room else (mid + 1, high)
    return low


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.shard_bytes = options["path"].rstrip("/"), int(options.get("shard_bytes", 1 << 30))
        self.dataset, self.run_id, self.overwrite = options.get("dataset", "dataset"), options.get("run_id", "run"), overwrite
        self.job = uuid.uuid4().hex
        self.staging = f"{self.path}/_staging/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shards:
        system, staging = system_of(self.staging)
        context = TaskContext.get()
        part, files, writer, held = context.partitionId(), [], None, 0

        def close() -> None:
            nonlocal writer, held
            writer.close()
            out.close()
            files.append((name, rows, out.size, held, out.digest.hexdigest()))
            writer, held = None, 0

        for batch in iterator:
            at = 0
            while at < batch.num_rows:
                if writer is None:
                    name, rows = f"{part}-{context.taskAttemptId()}-{len(files)}.parquet", 0
                    out = Hashed(system.open_output_stream(f"{staging}/{name}"))
                    writer = pq.ParquetWriter(pa.PythonFile(out, mode="w"), batch.schema, compression="zstd")
                n = fits(batch, at, self.shard_bytes - held)
                piece = batch.slice(at, n)
                writer.write_batch(piece)
                rows, held, at = rows + n, held + piece.nbytes, at + n
                if held >= self.shard_bytes:
                    close()
        if writer is not None:
            close()
        return Shards(part, files)

    def commit(self, messages: list) -> None:
        system, root = system_of(self.path)
        _, staging = system_of(self.staging)
        before = published(system, root) if self.overwrite else []
        for folder in ("data", "manifest"):
            system.create_dir(f"{root}/{folder}", recursive=True)
        lines, first = [], 0 if self.overwrite else 1 + max([x["shard_index"] for x in published(system, root)], default=-1)
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.part):
            for name, rows, size, held, digest in m.files:
                file = f"part-{first + len(lines):05d}-{self.job}.parquet"
                system.move(f"{staging}/{name}", f"{root}/data/{file}")
                lines.append({"dataset": self.dataset, "run_id": self.run_id, "shard_index": first + len(lines), "file": file, "num_samples": rows, "bytes": size, "row_bytes": held, "sha256": digest, "schema_version": SCHEMA_VERSION})
        with system.open_output_stream(f"{root}/_staging/{self.job}.json") as out:
            out.write("".join(json.dumps(x) + "\n" for x in lines).encode())
        old = [x for x in system.get_file_info(pa_fs.FileSelector(f"{root}/manifest")) if x.is_file] if self.overwrite else []
        system.move(f"{root}/_staging/{self.job}.json", f"{root}/manifest/{self.job}.json")
        for x in old:
            system.delete_file(x.path)
        for x in before:
            system.delete_file(f"{root}/data/{x['file']}")
        self.clear(system, root)

    def abort(self, messages: list) -> None:
        system, root = system_of(self.path)
        self.clear(system, root)

    def clear(self, system: pa_fs.FileSystem, root: str) -> None:
        """Takes this job's staging away, and the folder itself when no other job uses it."""
        mine = f"{root}/_staging/{self.job}"
        for left in range(9, -1, -1):
            try:
                if system.get_file_info(mine).type == pa_fs.FileType.Directory:
                    system.delete_dir(mine)
                break
            except OSError:  # a task that is being stopped has opened a file meanwhile
                if not left:
                    raise
                time.sleep(0.2)
        top = f"{root}/_staging"
        if system.get_file_info(top).type == pa_fs.FileType.Directory and not system.get_file_info(pa_fs.FileSelector(top)):
            system.delete_dir(top)


def published(system: pa_fs.FileSystem, root: str) -> list[dict]:
    """The lines of the manifests below a path."""
    if system.get_file_info(f"{root}/manifest").type != pa_fs.FileType.Directory:
        return []
    out = []
    for x in system.get_file_info(pa_fs.FileSelector(f"{root}/manifest")):
        if x.is_file and x.base_name.endswith(".json"):
            with system.open_input_stream(x.path) as stream:
                out += [json.loads(line) for line in stream.read().decode().splitlines()]
    return out


class ShardSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        writer = ShardWriter(dict(self.options), schema, overwrite)
        system, staging = system_of(writer.staging)
        system.create_dir(staging, recursive=True)
        return writer


def save_shards(df: DataFrame, path: str, shard_bytes: int = 1 << 30, dataset: str = "dataset", run_id: str = "run", mode: str = "append") -> DataFrame:
    """Writes df's partitions as shards, in their order of rows, and returns the manifest. mode: append or overwrite."""
    spark = df.sparkSession
    spark.dataSource.register(ShardSink)
    df.write.format(NAME).mode(mode).option("path", path).option("shard_bytes", str(shard_bytes)).option("dataset", dataset).option("run_id", run_id).save()
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest")


def load_shards(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the shards that the manifest lists, and of no other file."""
    files = [r.file for r in spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest").select("file").collect()]  # a name per shard
    return spark.read.parquet(*[f"{path}/data/{f}" for f in files])
