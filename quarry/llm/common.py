"""Shared helpers: tables, checkpointed intermediates, Arrow slices, size-checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at a time.
SLICE_BYTES = 1 << 20
#: Rows and bytes in an Arrow batch for operators that take whole texts.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 2000, 4 << 20
#: A side is broadcast only if its counted rows times their width stay below this.
BROADCAST_BYTES = 64 << 20

_PATHS: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession) -> SparkSession:
    """Bounds the rows and bytes of an Arrow batch, so that a batch of long texts fits in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))
    return spark


def give_back() -> None:
    """Hands free memory back to the system: Python workers live on for later tasks, of other stages too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only in local mode, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet under the checkpoint folder and reads it back: lineage is cut, a lost executor costs nothing. The files go
    when release() drops them, and at the latest when the process ends."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/quarry/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _PATHS:
        atexit.unregister(release)
        atexit.register(release)
    _PATHS.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def mark() -> int:
    """The number of intermediates written so far, for release()."""
    return len(_PATHS)


def release(since: int = 0, *kept: DataFrame) -> None:
    """Deletes the intermediates written since a mark, but for the kept ones. Nothing that is still to be computed may rest on the others."""
    stay = {df._quarry_path for df in kept}
    gone = [x for x in _PATHS[since:] if x[1] not in stay]
    _PATHS[since:] = [x for x in _PATHS[since:] if x[1] in stay]
    for spark, name in gone:
        if spark.sparkContext._jsc is None:  # the session has ended: its folder is its owner's
            continue
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df, counted, may be broadcast. df should be cheap to count, as a materialised table is."""
    return df.count() * row_bytes <= limit


def utf8(batch_column) -> tuple:
    """(byte offsets as numpy int64, the UTF-8 buffer as bytes) of a string column; nulls are empty."""
    import numpy as np

    col = batch_column.combine_chunks() if isinstance(batch_column, pa.ChunkedArray) else batch_column
    col = col.cast(pa.large_string()).fill_null("")
    n, start = len(col), col.offset
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[start : start + n + 1]
    data = col.buffers()[2]
    data = memoryview(data)[off[0] : off[-1]].tobytes() if data is not None and n else b""
    return off - off[0], data


def slices(batches, column: str = "text", budget: int = SLICE_BYTES):
    """Record batches cut to at most budget bytes of the column each (one row at least)."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
        at = 0
        while at < len(col):
            end = int(np.searchsorted(off, off[at] + budget, side="right")) - 1
            end = min(len(col), max(end, at + 1))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def texts(batch, column: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def held_out(doc_id: int | None) -> bool:
    """The fold rule: crc32 of the id as text, modulo 4, is 2. A null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def fold() -> Column:
    """held_out() as a column over doc_id."""
    return (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4) == 2


#: The place of a 64-bit hash in the range of all of them, from 0 to 1.
def _place(h: Column) -> Column:
    return h.cast("double") / float(1 << 64) + 0.5


def _margin(n: int) -> float:
    """So many rows are expected below the cut that fewer than n are next to impossible."""
    return n + 10 * n**0.5 + 50


def least_per_group(df: DataFrame, by: str, key: Column, n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The n rows of each group of least key (a 64-bit hash), with it as h. A cut that follows from the groups' counts leaves little more
    than n rows of each, wherever they lie, so that the ranking of a large group is no large task. The groups should be few."""
    counts = df.groupBy(by).agg(F.count("*").alias("__rows"))
    near = df.withColumn("h", key).join(F.broadcast(counts), by).where(_place(F.col("h")) * F.col("__rows") <= _margin(n)).drop("__rows")
    order = ", ".join(f"`{c}`" for c in ("h", *ties))
    return near.withColumn("__nth", F.expr(f"row_number() OVER (PARTITION BY `{by}` ORDER BY {order})")).where(F.col("__nth") <= n).drop("__nth")


def least_by_hash(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """n rows of least hash of the columns, with the hash as h. Only what a cut by the row count leaves, little more than n rows, is sorted."""
    keyed = df.withColumn("h", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    rows = keyed.count()
    return keyed.where(_place(F.col("h")) * rows <= _margin(n)).orderBy("h", *columns).limit(n)
