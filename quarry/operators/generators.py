"""Synthetic datasets from the keys of a table: every row follows from its key and the seed alone, whatever task makes it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import philox as P

# The weights of the linear data and the size of its noise.
WEIGHTS, NOISE = (0.4, -0.2, 0.1, 0.5), 0.1


def drawn(keys: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """key, _z0, _z1, ...: so many standard normal numbers for a key, four by four: streams 0, 1, ... of its counter."""
    streams = -(-count // 4)
    words = P.philox_rows(keys.select(key), key, streams, seed)
    z = [n for s in range(streams) for n in P.normals([F.col(f"_w{s}_{i}") for i in range(4)])]
    return words.select(key, *[n.alias(f"_z{i}") for i, n in enumerate(z[:count])])


def classification(keys: DataFrame, key: str, features: int = 4, classes: int = 2, seed: int = 42) -> DataFrame:
    """key, feature_0.. (standard normal), and a label that does not depend on them: the place of the largest of `classes` normal numbers."""
    rows = drawn(keys, key, features + classes, seed)
    votes = F.array(*[F.col(f"_z{features + i}") for i in range(classes)])
    return rows.select(key, *[F.col(f"_z{i}").alias(f"feature_{i}") for i in range(features)], (F.array_position(votes, F.array_max(votes)) - 1).cast("int").alias("label"))


def linear(keys: DataFrame, key: str, weights: tuple[float, ...] = WEIGHTS, noise: float = NOISE, seed: int = 42) -> DataFrame:
    """key, feature_0.. (standard normal), and a label: whether their weighted sum, with noise, is above the mean of all rows'."""
    n = len(weights)
    rows = drawn(keys, key, n + 1, seed)
    logit = F.col(f"_z{n}") * noise
    for i, w in enumerate(weights):
        logit = logit + F.col(f"_z{i}") * w
    rows = rows.withColumn("_logit", logit)
    mean = rows.agg(F.avg("_logit").alias("_mean"))
    return rows.join(F.broadcast(mean), how="cross").select(key, *[F.col(f"_z{i}").alias(f"feature_{i}") for i in range(n)], (F.col("_logit") > F.col("_mean")).cast("int").alias("label"))  # one row


def corpus(keys: DataFrame, key: str, prompts: tuple[dict[str, str], ...], seed: int | None = None) -> DataFrame:
    """key, sample_id, and the fields of a base prompt: in turn by the key or, with a seed, drawn."""
    n = len(prompts)
    keys = keys.select(key) if seed is None else P.philox_rows(keys.select(key), key, 1, seed)
    place = F.pmod(F.col(key), F.lit(n)) if seed is None else F.col("_w0_0") % n
    base = F.element_at(F.array(*[F.struct(*[F.lit(v).alias(f) for f, v in p.items()]) for p in prompts]), (place + 1).cast("int"))
    return keys.select(key, F.concat(F.lit("sample_"), F.lpad(F.col(key).cast("string"), 6, "0")).alias("sample_id"), base.alias("_p")).select(key, "sample_id", "_p.*")
