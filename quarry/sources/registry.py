"""Named datasets and metrics: builders by name, with splits, and aggregates by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Builder = Callable[[SparkSession, dict, str], DataFrame]


class Datasets:
    """Builders of DataFrames by name; build() makes a dataset's split and passes it through the given steps."""

    def __init__(self):
        self._builders: dict[str, Builder] = {}

    def register(self, name: str, builder: Builder) -> None:
        if name in self._builders:
            raise ValueError(f"{name} is registered already")
        self._builders[name] = builder

    def names(self) -> list[str]:
        return sorted(self._builders)

    def build(self, spark: SparkSession, name: str, config: dict | None = None, split: str = "train", steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> DataFrame:
        if name not in self._builders:
            raise KeyError(f"unknown dataset {name}; known: {', '.join(self.names())}")
        df = self._builders[name](spark, config or {}, split)
        for step in steps:
            df = df.transform(step)
        return df

    def views(self, spark: SparkSession, configs: dict[str, dict]) -> list[str]:
        """Registers the named datasets as temporary views, so that SQL can query them."""
        for name, config in configs.items():
            self.build(spark, name, config).createOrReplaceTempView(name)
        return sorted(configs)


class Metrics:
    """Aggregate columns by name over (truth, prediction)."""

    def __init__(self):
        self._metrics: dict[str, Callable[[Column, Column], Column]] = {
            "accuracy": lambda y, p: F.avg((y == p).cast("double")),
            "rmse": lambda y, p: F.sqrt(F.avg(F.pow(y - p, F.lit(2)))),
            "mae": lambda y, p: F.avg(F.abs(y - p)),
        }

    def register(self, name: str, metric: Callable[[Column, Column], Column]) -> None:
        self._metrics[name] = metric

    def evaluate(self, df: DataFrame, truth: str, predicted: str, names: list[str], by: tuple[str, ...] = ()) -> DataFrame:
        """All named metrics in one aggregation."""
        return df.groupBy(*by).agg(*[self._metrics[n](F.col(truth), F.col(predicted)).alias(n) for n in names])


def synthetic_classification(spark: SparkSession, rows: int, features: int = 4, seed: int = 42) -> DataFrame:
    """Normal features and a label that is 1 where their sum is positive; made by the executors."""
    df = spark.range(rows).select("id", *[F.randn(seed + i).alias(f"feature_{i}") for i in range(features)])
    return df.withColumn("label", (sum((F.col(f"feature_{i}") for i in range(features)), F.lit(0.0)) > 0).cast("int"))
