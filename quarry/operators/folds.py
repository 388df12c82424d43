"""Ordered folds whose carried state crosses blocks, so that the rows of one key are spread over tasks.

Rows are dealt by ranges of key and order into blocks, which are written once. Every block is first folded from the initial state, all at the same time. A
block's true first state is what the block before it ends with, if that ends in the same key. Blocks whose assumed state was another one are folded
again, all at once; their ends may change what follows, and so on until every block has begun with what its neighbour ends with. That is the
ordered fold exactly: the first block is right at once, and a block after right ones is right one round later. Folds that forget, as limits and
cooldowns do, mostly end alike whatever they begin with and settle in two or three rounds; one that forgets nothing takes a round for each block
of its longest key, each of them small. The driver sees a row per block: its ends, never the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from ..session import shared_folder, written

#: Rows of a block: folded by one task, with its columns in memory. Rows that are Python's objects at a time.
BLOCK_ROWS, SLICE_ROWS = 1_000_000, 16_384


def plain(x: object) -> object:
    """A key in a form that compares and goes through JSON; NaN by its name."""
    return "nan" if isinstance(x, float) and x != x else x if isinstance(x, (int, str, bool, type(None))) else str(x)


def folded(df: DataFrame, key: tuple[str, ...], order: tuple[str, ...], inputs: tuple[str, ...], step: Callable, start: object, out: tuple[str, DataType], keep: tuple[str, ...] = (), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, keep, out): step(state, *inputs) -> (state, value) over each key's rows in order, nulls first, beginning with start. States are made of
    numbers, texts and lists. Rows of equal order are taken in the order of keep."""
    spark = df.sparkSession
    blocks = max(1, -(-df.count() // block_rows))
    names = [f"_k{i}" for i in range(len(key))]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip(key, names)], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_x{i}") for i, c in enumerate(inputs)], *[F.col(c).alias(f"_y{i}") for i, c in enumerate(keep)])
    by = [*names, *[f"_o{i}" for i in range(len(order))], *[f"_y{i}" for i in range(len(keep))]]
    dealt = rows.repartitionByRange(blocks, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("_block", F.shiftright("_at", 33)), "blocks")
    values = [StructField(out[0], out[1]), StructField("_end", StructType.fromDDL("first string, last string, state string"))]
    schema = StructType([f for f in dealt.schema if f.name == "_block" or f.name in names or f.name.startswith("_y")] + values)
    kind = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}.get(out[1].simpleString(), pa.string())
    firsts_at = [dealt.columns.index(n) for n in names]
    inputs_at = [dealt.columns.index(f"_x{i}") for i in range(len(inputs))]

    def run(begin: dict[int, str]) -> Callable[[pa.Table], pa.Table]:
        def fold(block: pa.Table) -> pa.Table:
            block = block.sort_by("_at")
            number = block["_block"][0].as_py()
            state, first, last, parts = json.loads(begin.get(number, json.dumps(start))), None, None, []
            for at in range(0, block.num_rows, SLICE_ROWS):
                part, found = block.slice(at, SLICE_ROWS), []
                keys = list(zip(*[map(plain, part.column(i).to_pylist()) for i in firsts_at])) if firsts_at else [()] * part.num_rows
                if not at:
                    first = last = keys[0]
                for k, *x in zip(keys, *[part.column(i).to_pylist() for i in inputs_at]):
                    if k != last:
                        state, last = json.loads(json.dumps(start)), k
                    state, value = step(state, *x)
                    found.append(value)
                parts.append(pa.array(found, kind))
            end = {"first": json.dumps(first), "last": json.dumps(last), "state": json.dumps(state)}
            end_t = pa.struct([(n, pa.string()) for n in ("first", "last", "state")])
            ends = pa.chunked_array([pa.nulls(block.num_rows - 1, end_t), pa.array([end], end_t)])
            columns = [block[f.name] for f in schema[: -len(values)]]
            return pa.table([*columns, pa.chunked_array(parts, kind), ends], names=schema.names)

        return fold

    root, runs, ends, assumed, settled = f"{shared_folder(spark)}/fold-{uuid.uuid4().hex}", 0, {}, {}, {}
    todo: dict[int, str] | None = None
    initial = json.dumps(start)
    while todo is None or todo:
        some = dealt if todo is None else dealt.join(F.broadcast(spark.createDataFrame([(b,) for b in todo], "_block long")), "_block").select(dealt.columns)
        path = f"{root}/run={runs}"
        some.groupBy("_block").applyInArrow(run(todo or {}), schema).write.parquet(path)
        for r in spark.read.schema(schema).parquet(path).where("_end IS NOT NULL").select("_block", "_end").collect():  # a row per block
            ends[r[0]], settled[r[0]] = r[1], runs
        assumed |= todo or {}
        todo, before = {}, None
        for b in sorted(ends):
            right = before.state if before is not None and before.last == ends[b].first else initial
            if assumed.get(b, initial) != right:
                todo[b] = right
            before = ends[b]
        runs += 1
    if not settled:
        return spark.createDataFrame([], StructType([*[df.schema[c] for c in (*key, *keep)], StructField(*out)]))
    last = spark.createDataFrame(list(settled.items()), "_block long, run int")
    all_runs = spark.read.schema(StructType([*schema, StructField("run", IntegerType())])).parquet(root)
    final = all_runs.join(F.broadcast(last), ["_block", "run"])
    return final.select(*[F.col(n).alias(c) for n, c in zip(names, key)], *[F.col(f"_y{i}").alias(c) for i, c in enumerate(keep)], out[0])
