"""Drift over tumbling windows of a stream: a window closes when it holds so many rows, wherever batches begin and end."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..operators.statistics import chi_square_p_value, ks_p_value
from .stateful import ks_distance

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
QUARTILES = (0.25, 0.5, 0.75)


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which list states need; the session's own setting comes back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Drift(StatefulProcessor):
    """Of a key: the rows of its open window, as a list; the number of the open window and of its rows; and of its first window the sorted
    numbers, the quartiles of the arrays' values and the counts of the categories. The rows of a batch are taken in the order of a column."""

    def __init__(self, key: str, order: str, numbers: tuple[str, ...], arrays: str | None, categories: tuple[str, ...], size: int, p_limit: float, gap_limit: float):
        self.key, self.order, self.numbers, self.arrays, self.categories = key, order, numbers, arrays, categories
        self.size, self.p_limit, self.gap_limit = size, p_limit, gap_limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = [StructField(c, DoubleType()) for c in self.numbers] + ([StructField(self.arrays, ArrayType(DoubleType()))] if self.arrays else [])
        row = StructType(values + [StructField(c, StringType()) for c in self.categories] + [StructField("_", LongType())])
        self.open = handle.getListState("open", row)
        self.place = handle.getValueState("place", "window long, rows long")
        numbers = ", ".join(f"n{i} array<double>" for i in range(len(self.numbers)))
        counts = "".join(f", v{i} array<string>, c{i} array<long>" for i in range(len(self.categories)))
        self.first = handle.getValueState("first", f"{numbers}, q array<double>{counts}")

    def columns(self) -> list[str]:
        return [*self.numbers, *([self.arrays] if self.arrays else []), *self.categories]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        window, held = self.place.get() if self.place.exists() else (0, 0)
        at = 0
        while held + len(batch) - at >= self.size:
            part = batch.iloc[at : at + self.size - held]
            if held:
                part = pd.concat([pd.DataFrame(list(self.open.get()), columns=[*self.columns(), "_"]), part])
                self.open.clear()
            at, held = at + self.size - held, 0
            if window == 0:
                self.first.update(self.summary(part))
            else:
                yield self.compared(key[0], window, part)
            window += 1
        rest = batch.iloc[at:]
        if len(rest):
            self.open.appendList([(*self.plain(r), 0) for r in rest[self.columns()].itertuples(index=False)])
        self.place.update((window, held + len(rest)))

    def plain(self, row: tuple) -> Iterator:
        for name, x in zip(self.columns(), row):
            if name == self.arrays:
                yield [float(v) for v in x if v is not None] if x is not None else []
            elif name in self.numbers:
                yield float(x)
            else:
                yield None if x is None or x != x else str(x)

    def values(self, part: pd.DataFrame) -> np.ndarray:
        own = [np.asarray(x, dtype=float) for x in part[self.arrays] if x is not None] if self.arrays else []
        own = np.concatenate(own) if own else np.zeros(0)
        return own[~np.isnan(own)]

    def quartiles(self, part: pd.DataFrame) -> list[float]:
        own = self.values(part)
        return np.quantile(own, QUARTILES).tolist() if len(own) else []

    def of(self, part: pd.DataFrame, column: str) -> Counter:
        return Counter(str(x) for x in part[column] if x is not None and x == x)

    def summary(self, part: pd.DataFrame) -> tuple:
        out: list = [np.sort(part[c].dropna().astype(float)).tolist() for c in self.numbers]
        out.append(self.quartiles(part))
        for c in self.categories:
            counts = sorted(self.of(part, c).items())
            out += [[v for v, _ in counts], [n for _, n in counts]]
        return tuple(out)

    def compared(self, key, window: int, part: pd.DataFrame) -> pd.DataFrame:
        first, row, reasons = self.first.get(), {self.key: key, "window": window}, []
        for c, reference in zip(self.numbers, first):
            own = part[c].dropna().astype(float).tolist()
            d = ks_distance(list(reference), own) if own and len(reference) else None
            p = None if d is None else ks_p_value(d, len(reference), len(own))
            row |= {f"{c}_ks": d, f"{c}_p": p}
            reasons += [c] if p is not None and p < self.p_limit else []
        base, q = list(first[len(self.numbers)]), self.quartiles(part)
        if self.arrays:
            row["gap"] = max(abs(a - b) for a, b in zip(base, q)) if base and q else None
            reasons += [self.arrays] if row["gap"] is not None and row["gap"] > self.gap_limit else []
        for i, c in enumerate(self.categories):
            seen, counts = first[len(self.numbers) + 1 + 2 * i :][:2]
            theirs, own = dict(zip(seen, counts)), self.of(part, c)
            x = p = None
            if own and theirs and not own.keys() - theirs.keys():
                n, m = sum(own.values()), sum(theirs.values())
                x = sum((own[v] - k / m * n) ** 2 / (k / m * n) for v, k in theirs.items())
                p = chi_square_p_value(x, len(theirs) - 1)
            row |= {f"{c}_chi2": x, f"{c}_p": p}
            reasons += [c] if own and (p is None or p < self.p_limit) else []
        return pd.DataFrame([row | {"reasons": reasons, "drift": bool(reasons)}]).astype({k: "float64" for k in row if k not in (self.key, "window")})

    def schema(self, kind: str) -> str:
        numbers = "".join(f", `{c}_ks` double, `{c}_p` double" for c in self.numbers)
        counts = "".join(f", `{c}_chi2` double, `{c}_p` double" for c in self.categories)
        return f"`{self.key}` {kind}, window long{numbers}{', gap double' if self.arrays else ''}{counts}, reasons array<string>, drift boolean"

    def close(self) -> None:
        pass


def tumbling_drift(rows: DataFrame, key: str, order: str, size: int, numbers: tuple[str, ...], arrays: str | None = None, categories: tuple[str, ...] = (), p_limit: float = 0.01, gap_limit: float = 0.1) -> DataFrame:
    """Of a stream, per key and full window after the first: KS statistic and p-value of each number column against the first window, the largest
    gap of the quartiles of the arrays' values, chi-square of each category, the columns that tell of drift, and whether one does. A category
    that the first window lacks counts as drift. A window of a key is `size` rows as they arrive, those of one batch by `order`; the state is the
    open window and a summary of the first. Start the query inside rocks_state()."""
    processor = Drift(key, order, numbers, arrays, categories, size, p_limit, gap_limit)
    kept = [F.col(key), F.col(order), *[F.col(c).cast("double").alias(c) for c in numbers]]
    kept += [F.col(arrays).cast("array<double>").alias(arrays)] if arrays else []
    source = rows.select(*kept, *[F.col(c).cast("string").alias(c) for c in categories])
    kind = source.schema[key].dataType.simpleString()
    return source.groupBy(key).transformWithStateInPandas(processor, processor.schema(kind), "append", "None")
