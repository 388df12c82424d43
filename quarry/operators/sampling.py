"""Deterministic sampling, splitting, mixing and packing. Order is that of seeded hashes, so that a result does not depend on how the
table is partitioned; exact sizes come from bucketed numbering, never from one sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import hash_order, numbered, running


#: From so many rows on, first_n() numbers rows in buckets; below, each task keeps that many and one merges them.
TOP_IN_ONE_TASK = 10_000


def first_n(df: DataFrame, key: Column, n: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """The n rows of least key, a hex one. Many rows are not brought to one task: the buckets of the key that can hold them follow from the
    buckets' counts, and only their rows are numbered."""
    keyed = df.withColumn("_key", key)
    if n <= TOP_IN_ONE_TASK:
        return keyed.orderBy("_key", *ties).limit(n).drop("_key")
    return numbered(keyed, "_key", "_nth", ties=ties, upto=n).where(F.col("_nth") <= n).drop("_key", "_nth")


def shuffled(df: DataFrame, columns: tuple[str, ...], seed: int = 42, out: str = "position", rows: int | None = None) -> DataFrame:
    """All rows numbered in the order of a seeded shuffle. rows: their number, if it is known; then buckets keep to a size."""
    return numbered(df.withColumn("_key", hash_order(*columns, seed=seed)), "_key", out, ties=columns, rows=rows).drop("_key")


def split_sizes(n: int, weights: dict[str, float], mode: str = "round") -> dict[str, int]:
    """Sizes of the parts. round: rounded half away from zero, the rest to the last; floor_first: all but the last rounded down;
    floor_last: all but the first rounded down."""
    names = list(weights)
    if mode == "floor_last":
        sizes = {k: int(n * weights[k] + 1e-9) for k in names[1:]}
        return {names[0]: n - sum(sizes.values())} | sizes
    step = (lambda x: int(x + 0.5)) if mode == "round" else (lambda x: int(x + 1e-9))
    sizes, left = {}, n
    for k in names[:-1]:
        sizes[k] = min(left, step(n * weights[k]))
        left -= sizes[k]
    return sizes | {names[-1]: left}


def split(df: DataFrame, columns: tuple[str, ...], weights: dict[str, float], mode: str = "round", seed: int = 42) -> DataFrame:
    """df with the part of each row: disjoint parts of exact sizes in a seeded shuffle."""
    rows = df.count()
    sizes, upto, cases = split_sizes(rows, weights, mode), 0, None
    out = shuffled(df, columns, seed, "_pos", rows)
    for name, size in sizes.items():
        upto += size
        cases = F.when(F.col("_pos") <= upto, name) if cases is None else cases.when(F.col("_pos") <= upto, name)
    return out.withColumn("split", cases).drop("_pos")


def stratified(df: DataFrame, strata: tuple[str, ...], columns: tuple[str, ...], quota: int | Column, cap: int | None = None, seed: int | str = "") -> DataFrame:
    """Up to quota rows of each stratum in hash order, then up to cap of them."""
    key = hash_order(*columns, seed=seed)
    out = df.withColumn("_key", key)
    out = out.withColumn("_nth", F.row_number().over(Window.partitionBy(*strata).orderBy("_key", *columns))).where(F.col("_nth") <= quota).drop("_nth")
    return (out.orderBy("_key", *columns).limit(cap) if cap is not None else out).drop("_key")


def quotas(total: int, ratios: dict[str, float]) -> dict[str, int]:
    """Shares of a total, rounded half to even, at least one each."""
    return {k: max(1, round(total * r)) for k, r in ratios.items()}


def mix(parts: dict[str, tuple[DataFrame, float]], total: int, columns: tuple[str, ...], seed: int | str = "") -> DataFrame:
    """The union of the parts' first rows in hash order, as many as their ratios ask for and they have, named in `part`."""
    out = None
    for name, n in quotas(total, {k: r for k, (_, r) in parts.items()}).items():
        some = first_n(parts[name][0], hash_order(*columns, seed=seed), n, columns).withColumn("part", F.lit(name))
        out = some if out is None else out.unionByName(some, allowMissingColumns=True)
    return out


def weighted_choice(df: DataFrame, columns: tuple[str, ...], weights: dict[str, float], seed: int | str = "", out: str = "dataset") -> DataFrame:
    """Each row draws a name by weight, from its hash."""
    total, upto, cases = sum(weights.values()), 0.0, None
    draw = F.conv(F.substring(hash_order(*columns, seed=seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    for name, w in weights.items():
        upto += w / total
        cases = F.when(F.lit(upto) > draw, name) if cases is None else cases.when(F.lit(upto) > draw, name)
    return df.withColumn(out, F.coalesce(cases, F.lit(list(weights)[-1])))


def pack(df: DataFrame, tokens: Column, context: int, key: Column, ties: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """Lays texts end to end and cuts the stream into contexts: pack_id of a text's first and last token, and its offset in the first.
    key: a hex order key."""
    out = running(df.withColumn("_key", key).withColumn("_tokens", tokens), F.substring("_key", 1, 3), [F.col("_key"), *map(F.col, ties)], {"_end": F.col("_tokens").cast("long")}, within)
    start = F.col("_end") - F.col("_tokens")
    out = out.withColumn("first_pack", F.floor(start / context).cast("long")).withColumn("offset", (start % context).cast("long"))
    last = F.floor(F.greatest(F.col("_end") - 1, start) / context).cast("long")
    return out.withColumn("last_pack", last).withColumn("tokens", F.col("_tokens").cast("long")).drop("_key", "_tokens", "_end")


def tiled(df: DataFrame, n: int, order: tuple[str, ...]) -> DataFrame:
    """n rows by repeating df in order: repeat numbers come from exploding a sequence, not from a join."""
    have = df.count()
    times = -(-n // have) if have else 0
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(max(0, times - 1))))).orderBy("repeat", *order).limit(n)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
