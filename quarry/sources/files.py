"""Readers and sinks by format, with provenance, and unions of file families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv", "txt": "text"}


def format_of(path: str) -> str:
    """The format by the suffix of a path; unknown suffixes raise."""
    suffix = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unknown format: {path}")
    return FORMATS[suffix]


def read(spark: SparkSession, path: str, schema: StructType | str | None = None, columns: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """The file or folder as a DataFrame. Blank JSON lines are skipped; broken ones raise unless the schema has _corrupt_record."""
    kind = kind or format_of(path)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        reader = reader.option("header", True)
        reader = reader if schema is not None else reader.option("inferSchema", True)
    if kind == "json":
        has_room = schema is not None and "_corrupt_record" in (schema if isinstance(schema, str) else schema.fieldNames())
        reader = reader.option("mode", "PERMISSIVE" if has_room else "FAILFAST")
    out = reader.format(kind).load(path)
    return out.select(*columns) if columns else out


def with_source(df: DataFrame, out: str = "__source_path") -> DataFrame:
    """Adds the path of the file that each row came from; for DataFrames that read files."""
    return df.withColumn(out, F.col("_metadata.file_path"))


def union_of(spark: SparkSession, folder: str, prefix: str, kind: str = "parquet") -> DataFrame:
    """All rows of the files prefix* in a folder; columns that a file lacks are null."""
    reader = spark.read.format(kind).option("pathGlobFilter", f"{prefix}*.{kind}")
    return (reader.option("mergeSchema", True) if kind == "parquet" else reader).load(folder)


def write_parquet(df: DataFrame, path: str, compression: str = "zstd", rows_per_file: int | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).option("compression", compression)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A JSON object per line; nulls are written, other characters than ASCII stay."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def convert(spark: SparkSession, folder: str, out: str, kind: str = "csv", schema: StructType | str | None = None) -> DataFrame:
    """All files of one format in a folder to Parquet; returns (file, rows) counts of what was written."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("inferSchema", True)
    df = reader.option("header", True).option("pathGlobFilter", f"*.{kind}").format(FORMATS[kind]).load(folder)
    write_parquet(with_source(df, "source_file"), out)
    return spark.read.parquet(out).groupBy(F.element_at(F.split("source_file", "/"), -1).alias("file")).agg(F.count("*").alias("rows"))


def prompts(df: DataFrame) -> DataFrame:
    """prompt, else question, trimmed; rows without either go."""
    columns = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("prompt", "question") if c in df.columns]
    return df.select(F.coalesce(*columns).alias("prompt")).where("prompt IS NOT NULL")


def flat_metrics(spark: SparkSession, folder: str, suffix: str = "_metrics.json", order: str | None = None) -> DataFrame:
    """A row per metrics file with every numeric-looking column as a double, least file name first or by a column."""
    df = spark.read.option("multiLine", True).option("pathGlobFilter", f"*{suffix}").json(folder)
    cast = [F.expr(f"try_cast(`{n}` AS double)").alias(n) if t in ("bigint", "int", "double", "float") else F.col(n) for n, t in df.dtypes]
    out = df.select(*cast, F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"))
    return out.orderBy(F.desc(order), "file") if order else out.orderBy("file")


def ion_text(df: DataFrame, key: str = "spectrum_id", mzs: str = "mzs", intensities: str = "intensities") -> DataFrame:
    """Each spectrum as one text block of ion lines, ready for a text sink."""
    lines = F.transform(F.arrays_zip(F.col(mzs).alias("m"), F.col(intensities).alias("i")), lambda p: F.concat_ws(" ", p["m"].cast("string"), p["i"].cast("string")))
    return df.select(F.concat_ws("\n", F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), F.col(key).cast("string")), F.array_join(lines, "\n"), F.lit("END IONS"), F.lit("")).alias("value"))
