"""Streams: windows, running totals, deduplication, limits and drift over Structured Streaming."""

from __future__ import annotations

import heapq
import itertools
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


def stream_of(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a table (name.parquet, a file or a folder) below a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    reader = reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader
    return reader.parquet(f"{folder}/{name}.parquet*")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns its rows, from Parquet in the shared folder: all batches in append mode, the last
    one in complete mode. A batch that is run again replaces its own folder, so that none counts twice."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number:09d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(f"{root}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def window_counts(events: DataFrame, ts: str, seconds: int, by: tuple[str, ...], value: str, late: str | None = None) -> DataFrame:
    """Rows and sum per window and key. late: how far behind rows may come (a watermark, which also bounds the state)."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, f"{seconds} seconds"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def first_seen(events: DataFrame, keys: tuple[str, ...], ts: str | None = None, late: str | None = None) -> DataFrame:
    """The first row of each key. With ts and late the state forgets keys older than the watermark."""
    if ts and late:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def metric_totals(events: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """Running rows, sum, least and greatest value by key: experiment arms, counters and gauges."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def observed(stream: DataFrame, name: str, value: str) -> DataFrame:
    """The stream with rows, mean and maximum of each batch reported to listeners."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean"), F.max(value).alias("max"))


#: Hits of a key that are sorted in memory at a time, and rows in a part that is handed on.
RUN_ROWS, PART_ROWS = 1_000_000, 10_000


def in_order(parts: Iterator[pd.DataFrame], second: str, ident: str, run_rows: int) -> Iterator[tuple[float, int | None]]:
    """(second, ident) of all parts in order, unknown ones last: runs of run_rows are sorted, and put on disk if there are several."""
    kind = np.dtype([("t", "f8"), ("none", "?"), ("i", "i8")])
    with tempfile.TemporaryDirectory() as folder:
        runs, held, n = [], [], 0

        def run() -> np.ndarray:
            rows = np.concatenate(held) if held else np.empty(0, kind)
            return rows[np.lexsort((rows["i"], rows["none"], rows["t"]))]

        for part in parts:
            rows = np.empty(len(part), kind)
            rows["t"], rows["none"], rows["i"] = part[second], part[ident].isna(), part[ident].fillna(0)
            held.append(rows)
            n += len(rows)
            if n >= run_rows:
                np.save(f"{folder}/{len(runs)}.npy", run())
                runs.append(np.load(f"{folder}/{len(runs)}.npy", mmap_mode="r"))
                held, n = [], 0
        runs.append(run())

        def read(rows: np.ndarray) -> Iterator[tuple[float, bool, int]]:
            for at in range(0, len(rows), PART_ROWS):
                yield from rows[at : at + PART_ROWS].tolist()

        for t, none, i in heapq.merge(*map(read, runs), key=lambda x: (x[0] != x[0], x[0] if x[0] == x[0] else 0.0, *x[1:])):
            yield t, None if none else i


def limited(hits: DataFrame, key: str, second: str, ident: str, seconds: float, most: int, run_rows: int = RUN_ROWS) -> DataFrame:
    """(key, ident, allowed) by a sliding log: a hit is allowed if fewer than `most` allowed ones lie within the last seconds. A key's
    state is the times of its last allowed hits, `most` at most; the hits of a batch are taken in the order of time and ident. A key may
    have any number of hits in a batch: beyond run_rows they are sorted by disk, and results are handed on in parts."""
    return _limited(hits, (key,), second, ident, lambda group: (most, seconds), run_rows)


def limited_by_tier(hits: DataFrame, key: str, tier: str, second: str, ident: str, limits: dict[str, tuple[int, float] | None], other: tuple[int, float], run_rows: int = RUN_ROWS) -> DataFrame:
    """(key, tier, ident, allowed): limited() for each key and tier, with the (most, seconds) of the tier; None is exempt, and tiers that are not
    listed have `other`. Exempt hits need no state."""
    exempt = F.coalesce(F.col(tier).isin([t for t, x in limits.items() if x is None]), F.lit(False))
    free = hits.where(exempt).select(key, tier, F.col(ident).cast("long").alias(ident), F.lit(True).alias("allowed"))
    return free.unionByName(_limited(hits.where(~exempt), (key, tier), second, ident, lambda group: limits.get(group[1], other), run_rows))


def _limited(hits: DataFrame, keys: tuple[str, ...], second: str, ident: str, limit: Callable[[tuple], tuple[int, float]], run_rows: int) -> DataFrame:
    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log, (most, seconds) = deque(state.get[0] if state.exists else ()), limit(group)
        rows = in_order(parts, second, ident, run_rows)
        while part := list(itertools.islice(rows, PART_ROWS)):
            allowed = []
            for t, _ in part:
                while log and not log[0] > t - seconds:  # a time after all others is the latest: the log is in order
                    log.popleft()
                allowed.append(len(log) < most)
                if allowed[-1]:
                    log.append(t)
            yield pd.DataFrame({k: [x] * len(part) for k, x in zip(keys, group)} | {ident: pd.array([i for _, i in part], "Int64"), "allowed": allowed})
        state.update((sorted(log),))

    source = hits.select(*keys, F.col(second).cast("double").alias(second), F.col(ident).cast("long").alias(ident))
    kinds = "".join(f"{k} {dict(source.dtypes)[k]}, " for k in keys)
    return source.groupBy(*keys).applyInPandasWithState(step, f"{kinds}{ident} long, allowed boolean", "log array<double>", "append", GroupStateTimeout.NoTimeout)


def silent(beats: DataFrame, worker: str, timeout_ms: int) -> DataFrame:
    """(worker, beats) for each worker that has sent nothing for timeout_ms of processing time; a worker that comes back counts anew."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({worker: [group[0]], "beats": [n]})
            return
        n = (state.get[0] if state.exists else 0) + sum(map(len, parts))
        state.update((n,))
        state.setTimeoutDuration(timeout_ms)

    kind = dict(beats.dtypes)[worker]
    return beats.select(worker).groupBy(worker).applyInPandasWithState(step, f"{worker} {kind}, beats long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ks_distance(a: list[float], b: list[float]) -> float:
    """The greatest gap of two empirical distributions."""
    import numpy as np

    x, y = np.sort(np.asarray(a, dtype=float)), np.sort(np.asarray(b, dtype=float))
    at = np.concatenate([x, y])
    return float(np.abs(np.searchsorted(x, at, side="right") / len(x) - np.searchsorted(y, at, side="right") / len(y)).max())


def drift_windows(values: DataFrame, feature: str, value: str, reference: dict[str, list[float]], size: int = 1000, least: int = 50) -> DataFrame:
    """(feature, n, distance) after each batch: the last `size` values of a feature against its reference sample, from `least` values on."""

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = deque(state.get[0] if state.exists else (), size)
        for part in parts:
            last.extend(part[value].astype(float).tolist())
        kept = list(last)
        state.update((kept,))
        ref = reference.get(group[0])
        if ref and len(kept) >= least:
            yield pd.DataFrame({feature: [group[0]], "n": [len(kept)], "distance": [ks_distance(ref, kept)]})

    source = values.select(F.col(feature).cast("string").alias(feature), F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    return source.groupBy(feature).applyInPandasWithState(step, f"{feature} string, n long, distance double", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def routed(alerts: DataFrame, routes: dict[str, Callable[[DataFrame], None]], level: str = "level") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands the rows of each level to its sink; levels without a route are left out."""

    def send(batch: DataFrame, number: int) -> None:
        for name, sink in routes.items():
            sink(batch.where(F.col(level) == name))

    return send
