"""Session defaults of the library."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the operators rely on or profit from; a cluster's own settings of sizes and partitions are left alone.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def session(app: str = "quarry", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def tables(spark: SparkSession, path: str, *names: str) -> list:
    """The named parquet tables below a folder."""
    return [spark.read.parquet(f"{path}/{name}.parquet") for name in names]


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share; a local one only in local mode, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/quarry"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: the plan is a scan, and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
