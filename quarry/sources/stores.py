"""Stores on files: embeddings, versions by content, evaluation reports, listings, exports and streams of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import arrays as A
from .chunks import checkout, commit  # noqa: F401  versions by content
from .shards import sha256_of_files


SUFFIXES = {"jsonl": "json", "parquet": "parquet"}


def batches(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "json", files_at_once: int = 1) -> DataFrame:
    """A stream of the files of a folder, so many at a time; CSV files have a header."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(folder)


def write_lines(df: DataFrame, path: str, shards: int, key: str) -> DataFrame:
    """JSON lines in so many shards by range of the key, and (file, bytes, sha256) of what was written."""
    df.repartitionByRange(shards, key).sortWithinPartitions(key).write.json(path)
    return sha256_of_files(df.sparkSession, path, "*.json")


def save_embeddings(df: DataFrame, path: str, key: str = "spectrum_id", vector: str = "embedding", metadata: str | None = None, normalise: bool = True, kind: str = "parquet") -> None:
    """spectrum_id, embedding (of length one, if asked for) and metadata (a map of texts; none: empty). kind: parquet or jsonl."""
    values = A.l2(F.col(vector)) if normalise else F.transform(vector, lambda x: x.cast("double"))
    empty = F.create_map().cast("map<string,string>")
    about = F.coalesce(F.col(metadata), empty) if metadata else empty
    df.select(F.col(key).cast("string").alias("spectrum_id"), values.alias("embedding"), about.alias("metadata")).write.format(SUFFIXES[kind]).save(path)


def load_embeddings(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema("spectrum_id string, embedding array<double>, metadata map<string,string>").format(SUFFIXES[kind]).load(path)


def spectra_with_metadata(df: DataFrame, payload: tuple[str, ...] = ("sample_id", "mzs", "ints", "precursor_mz")) -> DataFrame:
    """The payload columns, and all others as one struct."""
    rest = [c for c in df.columns if c not in payload]
    about = F.struct(*rest) if rest else F.lit(None).cast("struct<none:string>")
    return df.select(*[c for c in payload if c in df.columns], about.alias("metadata"))


def export_json(df: DataFrame, path: str) -> None:
    """Vectors and their ids as JSON lines."""
    df.write.json(path)


def evaluation_reports(spark: SparkSession, folder: str, prefix: str = "eval_report_") -> DataFrame:
    """A row per report with its run id and its metrics as columns; files that are no object with metrics are left out."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", f"{prefix}*.json").text(folder).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    metrics = raw.select(F.regexp_extract("file", rf"^{prefix}(.*)\.json$", 1).alias("run_id"), F.get_json_object("value", "$.metrics").alias("m")).where("m IS NOT NULL")
    return metrics.select("run_id", F.explode(F.from_json("m", "map<string,string>")).alias("metric", "value")).groupBy("run_id").pivot("metric").agg(F.first("value"))


def resolved_columns(columns: list[str]) -> tuple[str, str]:
    """The text column (sentence, else the first) and the label column (label, else the last) of a training table."""
    if not columns:
        return "text", "label"
    return ("sentence" if "sentence" in columns else columns[0]), ("label" if "label" in columns else columns[-1])


def labelled(df: DataFrame, limit: int | None = None) -> DataFrame:
    """The text and the labels of a training table by the rule of resolved_columns(), so many rows at most."""
    text, label = resolved_columns(df.columns)
    out = df.select(F.col(text).alias("text"), F.col(label).alias("labels"))
    return out.limit(limit) if limit and limit > 0 else out


def listing(spark: SparkSession, folder: str, suffix: str | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    """(path, file, bytes, modified) of the files below a folder, newest first, a page at a time. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}" if suffix else "*").load(folder)
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return out.orderBy(F.desc("modified"), "path").offset(skip).limit(limit)


def older_than(files: DataFrame, days: int, now: Column | None = None) -> DataFrame:
    """Of listing()'s rows those past their retention."""
    return files.where(F.col("modified") < (F.current_timestamp() if now is None else now) - F.make_interval(days=F.lit(days)))


def crash_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """A row per dump with its fields and its file."""
    return spark.read.option("multiLine", True).option("pathGlobFilter", "*.json").json(folder).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def distilled_rows(df: DataFrame, probabilities: str, target: str) -> DataFrame:
    """teacher_probs and target, ready for a JSON sink."""
    return df.select(F.transform(probabilities, lambda x: x.cast("double")).alias("teacher_probs"), F.col(target).cast("int").alias("target"))


def manifests(spark: SparkSession, folder: str, run_id: str | None = None) -> DataFrame:
    """The rows of the manifests below a folder whose run id, or whose file name, is or holds the given one, newest run first."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder).withColumn("manifest", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    if run_id is not None:
        rows = rows.where((F.col("run_id") == run_id) | F.col("manifest").contains(run_id))
    return rows.orderBy(F.desc("run_id"), "shard_index")


def sample_of(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """The sample of an id, from the first shard, by name, that holds it. The filter reaches the scan."""
    found = spark.read.parquet(path).where(F.col(key) == value).withColumn("_file", F.col("_metadata.file_path"))
    return found.orderBy("_file").limit(1).drop("_file")


def loader(df: DataFrame, split: str, batch: int, drop_last: bool = False, seed: int = 42) -> DataFrame:
    """Rows with the number of their batch: the training split is shuffled by a seeded hash, others keep the order of `id`. drop_last leaves
    out a last batch that is not full."""
    from ..operators.ordering import hash_order, numbered

    key = hash_order("id", seed=seed) if split == "train" else F.lpad(F.hex(F.col("id").cast("long")), 16, "0")
    out = numbered(df.withColumn("_key", key), "_key", "_n", ties=("id",)).withColumn("batch", F.floor((F.col("_n") - 1) / batch).cast("long"))
    if drop_last:
        out = out.where(F.col("batch") < df.count() // batch)
    return out.drop("_key", "_n")
