"""Usage, billing, experiments, registries and lineage as queries."""

from __future__ import annotations

import uuid
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from ..session import shared_folder, written
from .folds import BLOCK_ROWS, folded

# Prices by resource, and hourly prices of accelerators.
RATES = {"gpu_hour": 3.00, "token_input": 0.00001, "token_output": 0.00003, "storage_gb_month": 0.05}
GPU_HOURLY = {"rtx_4090": 2.25, "rtx_5090": 2.95, "a100_80gb": 3.75, "h100_80gb": 5.5}


def _keys(batch, n: int) -> list[tuple]:
    """The first n columns by row; NaN, which is not equal to itself, by its name."""
    return list(zip(*[["nan" if isinstance(x, float) and x != x else x for x in c.to_pylist()] for c in batch.columns[:n]]))


def price(resource: Column, quantity: Column, multiplier: Column | None = None) -> Column:
    """Rate times quantity; a job's multiplier counts for accelerator hours only."""
    base = F.try_element_at(F.create_map(*[F.lit(x) for kv in RATES.items() for x in kv]), resource) * quantity
    return base if multiplier is None else F.when(resource == "gpu_hour", base * multiplier).otherwise(base)


def billing_summary(usage: DataFrame, resource: str, quantity: str, cost: Column) -> DataFrame:
    """Usage and cost by resource, with each one's share of the whole."""
    out = usage.groupBy(resource).agg(F.sum(quantity).alias("usage"), F.sum(cost).alias("cost"), F.count("*").alias("n"))
    return out.withColumn("share", F.col("cost") / F.sum("cost").over(Window.partitionBy(F.lit(0))))


def gpu_cost(gpu: Column, nodes: Column, per_node: Column, hours: Column) -> Column:
    rate = F.try_element_at(F.create_map(*[F.lit(x) for kv in GPU_HOURLY.items() for x in kv]), F.replace(gpu, F.lit("-"), F.lit("_")))
    return F.when((hours > 0) & (nodes > 0) & (per_node > 0), F.round(rate * nodes * per_node * hours, 2))


def variant(experiment: Column, user: Column, weights: dict[str, float]) -> Column:
    """The variant by the hash of experiment and user modulo 10,000 against cumulative weights, limits included."""
    draw = T.hash_mod(F.concat_ws(":", experiment, user.cast("string"))) / 10_000.0
    upto, cases = 0.0, None
    for name, w in weights.items():
        upto += w
        cases = F.when(draw <= upto, name) if cases is None else cases.when(draw <= upto, name)
    return F.coalesce(cases, F.lit(list(weights)[-1]))


def experiment_results(events: DataFrame, arm: str, metric: str, value: str, counted: str) -> DataFrame:
    """Sums of each metric by arm, divided by the arm's number of rows of the counted metric."""
    sums = events.groupBy(arm, metric).agg(F.sum(value).alias("total"))
    counts = events.where(F.col(metric) == counted).groupBy(arm).agg(F.count("*").alias("n"))
    return sums.join(counts, arm, "left").withColumn("mean", F.try_divide("total", "n"))


def budget_alerts(costs: DataFrame, project: str, order: tuple[str, ...], cost: str, limit: float, warn: float = 0.8) -> DataFrame:
    """Running spend per project with ok, warning (from 80 percent) or critical (from the limit)."""
    spent = F.sum(cost).over(Window.partitionBy(project).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return costs.withColumn("spent", spent).withColumn("level", F.when(F.col("spent") >= limit, "critical").when(F.col("spent") >= warn * limit, "warning").otherwise("ok"))


def rolling_mean(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str, n: int = 10) -> DataFrame:
    return df.withColumn("rolling_mean", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)))


def ema(df: DataFrame, by: tuple[str, ...], order: str, value: str, alpha: float = 0.95, blocks: int = 64) -> DataFrame:
    """Per group (order, ema) rows of the exponential average e = alpha e + (1 - alpha) x, started at the first value. Quantiles of the
    order, a number or a timestamp, cut the steps of every group into numbered blocks, so that a large group is spread over tasks. A block
    is folded from nothing, row by row; it adds alpha^n of what the blocks before it, chained by group, end with. A null makes the rest of
    its group null."""
    place = F.col(order).cast("double")
    cuts = sorted(set(df.select(place.alias("o")).approxQuantile("o", [i / blocks for i in range(1, blocks)], 1 / (4 * blocks)))) if blocks > 1 else []
    block = F.lit(0)
    for c in cuts:
        block = block + F.coalesce(place > c, F.lit(False)).cast("int")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], block.alias("_b"), F.col(order).alias("o"), F.col(value).cast("double").alias("x"))
    dealt = rows.repartition(*keys, "_b").sortWithinPartitions(*keys, "_b", "o", "x").select(*keys, "_b", F.col("o").cast("long").alias("o"), "x")

    def fold(batches):
        last, n, e = None, 0, 0.0
        for batch in batches:
            nth, ends = [], []
            for key, x in zip(_keys(batch, len(by) + 1), batch.column(len(by) + 2).to_pylist()):
                if key != last:
                    last, n, e = key, 0, 0.0
                n += 1
                e = None if e is None or x is None else alpha * e + (1 - alpha) * x
                nth.append(n), ends.append(e)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64()), pa.array(ends, pa.float64())], [*batch.schema.names, "n", "e"])

    out = dealt.mapInArrow(fold, T_.StructType([*dealt.schema.fields, T_.StructField("n", T_.LongType()), T_.StructField("e", T_.DoubleType())])).withColumn("d", F.pow(F.lit(float(alpha)), "n"))
    # Of each block the first value and the end.
    ends = out.groupBy(*keys, "_b").agg(F.min_by("x", "n").alias("x"), F.max_by("e", "n").alias("e"), F.max_by("d", "n").alias("d"))
    chain = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "x", "e", "d"))).alias("s"))  # `blocks` at most
    start = F.struct(F.col("s")[0]["x"].alias("c"), F.array().cast("array<struct<b:int,c:double>>").alias("out"))

    def link(acc: Column, s: Column) -> Column:
        return F.struct((s["e"] + s["d"] * acc["c"]).alias("c"), F.concat(acc["out"], F.array(F.struct(s["_b"].alias("b"), acc["c"].alias("c")))).alias("out"))

    carry = chain.select(*[F.col(k).alias(f"_c{k}") for k in keys], F.inline(F.aggregate("s", start, link)["out"]))
    same = F.col("_b") == F.col("b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_c{k}"))
    return out.join(carry, same).select(*[F.col(k).alias(c) for k, c in zip(keys, by)], F.col("o").alias(order), (F.col("e") + F.col("d") * F.col("c")).alias("ema"))


def loss_stats(df: DataFrame, by: tuple[str, ...], order: str, value: str, n: int = 10) -> DataFrame:
    """current, mean of the last n, least and greatest value per run."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    ranked = df.withColumn("_nth", nth)
    return ranked.groupBy(*by).agg(F.max_by(value, order).alias("current"), F.avg(F.when(F.col("_nth") <= n, F.col(value))).alias("recent"), F.min(value).alias("min"), F.max(value).alias("max"))


def fixed_window_limit(hits: DataFrame, key: str, ts: str, seconds: int, most: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """hits with window_start, allowed (the first `most` of each key and window) and remaining."""
    start = F.window(ts, f"{seconds} seconds")["start"]
    out = hits.withColumn("window_start", start)
    nth = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(ts, *ties))
    return out.withColumn("nth", nth).withColumn("allowed", F.col("nth") <= most).withColumn("remaining", F.greatest(F.lit(0), F.lit(most) - F.col("nth"))).drop("nth")


def sliding_log_limit(hits: DataFrame, key: str, second: str, ident: str, seconds: int, most: int) -> DataFrame:
    """(key, ident, allowed): a hit is allowed if fewer than `most` allowed ones lie within the last seconds. As rejected hits do not
    count, this is an ordered fold over the hits of a key: they are sorted, by disk if need be, and read in batches, over which the last
    `most` allowed times are carried."""
    rows = hits.select(F.col(key), F.col(second).cast("double").alias("_t"), F.col(ident).cast("long").alias("_i")).repartition(key).sortWithinPartitions(key, "_t", "_i")

    def fold(batches):
        last, log = None, deque()
        for batch in batches:
            allowed = []
            for k, t in zip(_keys(batch, 1), batch.column(1).to_pylist()):
                if k != last:
                    last, log = k, deque()
                while log and (t is None or log[0] is None or not log[0] > t - seconds):
                    log.popleft()
                allowed.append(len(log) < most)
                if allowed[-1]:
                    log.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(allowed, pa.bool_())], [key, ident, "allowed"])

    return rows.mapInArrow(fold, T_.StructType([rows.schema[0], T_.StructField(ident, T_.LongType()), T_.StructField("allowed", T_.BooleanType())]))


def liveness(beats: DataFrame, worker: str, ts: str, now: Column, timeout: int) -> DataFrame:
    """Per worker the last beat, its age in seconds, and whether it is alive."""
    out = beats.groupBy(worker).agg(F.max(ts).alias("last_seen"))
    age = F.unix_timestamp(now) - F.unix_timestamp("last_seen")
    return out.withColumn("age", age.cast("long")).withColumn("alive", F.col("age") < timeout)


def resolve_tags(versions: DataFrame, tags: DataFrame) -> DataFrame:
    """Rows of versions by (name, version) that tags point to."""
    return tags.join(versions, ["name", "version"])


def chains(step: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, end, n) forwards and backwards for the nodes with one edge in and one out, `ends` apart: the first node on their way that is not
    such a one, and the steps to it. A round doubles the ways of all at once; nodes on a ring have no end and no row. step: node, next."""
    into, out = step.groupBy(F.col("next").alias("node")).agg(F.count("*").alias("i"), F.first("node").alias("last")), step.groupBy("node").agg(F.count("*").alias("o"), F.first("next").alias("next"))
    inner = written(into.join(out, "node").where("i = 1 AND o = 1 AND node <> next").join(ends, "node", "left_anti").select("node", "last", "next"), "inner")
    found = []
    for column in ("next", "last"):
        open_ = inner.select(F.col("node").alias("_inner"))
        way = inner.select("node", F.col(column).alias("end"), F.lit(1).cast("long").alias("n"))
        way = written(way.join(open_, F.col("end") == F.col("_inner"), "left").select("node", "end", "n", F.col("_inner").isNotNull().alias("open")), "ways")
        left, before = way.where("open").count(), -1
        while left and left != before:
            further = way.select(F.col("node").alias("end"), F.col("end").alias("_end"), F.col("n").alias("_n"), F.col("open").alias("_open"))
            ahead = way.where("open").join(further, "end").select("node", F.col("_end").alias("end"), (F.col("n") + F.col("_n")).alias("n"), F.col("_open").alias("open"))
            way = written(way.where("NOT open").unionByName(ahead), "ways")
            left, before = way.where("open").count(), left
        found.append(way.where("NOT open").drop("open"))
    return found[0], found[1]


def closure(edges: DataFrame, start: DataFrame, downstream: bool = True, depth: int = 1000) -> DataFrame:
    """(start, node, depth): all nodes reached along edges (source, target), by least depth. Chains of nodes with one edge in and one out are
    walked by path doubling, log2 of their length in rounds, and stand for one edge of that length. A round over what is left joins the last
    improvements only and keeps what is shorter than known, so that rings end: as many rounds as a way has branchings. Each is written to the
    shared folder and read back with all rounds before it as one scan: plans stay of one size however deep the graph is. A graph with longer
    ways than `depth` is an error, not a shorter answer."""
    spark = edges.sparkSession
    a, b = ("source", "target") if downstream else ("target", "source")
    step = written(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node IS NOT NULL AND next IS NOT NULL").distinct(), "edges")
    onward, back = chains(step, start.select("node").distinct())
    inner = onward.select("node")
    jumps = step.join(inner, "node", "left_anti").join(onward.select(F.col("node").alias("next"), "end", "n"), "next", "left")
    jumps = jumps.select("node", F.coalesce("end", "next").alias("_next"), (F.coalesce("n", F.lit(0).cast("long")) + 1).alias("_n"))
    jumps = written(jumps.groupBy("node", "_next").agg(F.min("_n").alias("_n")), "jumps")
    root = f"{shared_folder(spark)}/closure-{uuid.uuid4().hex}"
    kind = start.schema["node"].dataType
    schema = T_.StructType([T_.StructField("start", kind), T_.StructField("node", kind), T_.StructField("depth", T_.LongType())])
    paths: list[str] = []

    def put(rows: DataFrame) -> DataFrame:
        paths.append(f"{root}/{len(paths)}")
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.parquet(paths[-1])
        return spark.read.schema(schema).parquet(paths[-1])

    def known() -> DataFrame:
        return spark.read.schema(schema).parquet(*paths).groupBy("start", "node").agg(F.min("depth").alias("depth"))

    frontier = put(start.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("depth")).distinct())
    while frontier.head(1):
        if len(paths) > depth + 1:
            raise ValueError(f"the graph is deeper than {depth}: give a larger depth")
        found = frontier.join(jumps, "node").groupBy("start", F.col("_next").alias("node")).agg(F.min(F.col("depth") + F.col("_n")).alias("depth"))
        frontier = put(found.join(known().withColumnRenamed("depth", "_known"), ["start", "node"], "left").where("_known IS NULL OR depth < _known"))
    met = written(known(), "met")
    inside = met.join(back.select(F.col("node").alias("_inner"), F.col("end").alias("node"), "n"), "node").select("start", F.col("_inner").alias("node"), (F.col("depth") + F.col("n")).alias("depth"))
    out = written(met.unionByName(inside).select("start", "node", F.col("depth").cast("int").alias("depth")), "closure")
    if (out.agg(F.max("depth")).first()[0] or 0) > depth:
        raise ValueError(f"the graph is deeper than {depth}: give a larger depth")
    return out


def features(long: DataFrame, names: list[str], entity: str = "entity") -> DataFrame:
    """A row per entity with the last value of each named feature; null where it has none."""
    return long.groupBy(entity).pivot("feature", names).agg(F.max_by("value", "updated_at"))


def batch_metrics(rows: DataFrame, batch: str, tokens: str, seconds: str, cost: str) -> DataFrame:
    """Per batch: rows, tokens, cost, rows and tokens per second."""
    out = rows.groupBy(batch).agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"), F.sum(cost).alias("cost"), F.sum(seconds).alias("seconds"))
    return out.withColumn("rows_per_second", F.try_divide("n", "seconds")).withColumn("tokens_per_second", F.try_divide("tokens", "seconds"))


def sampled_rate(events: DataFrame, ts: str, seconds: int) -> DataFrame:
    """Cumulative events at the end of each interval: counts by interval, then a running sum over the intervals."""
    by = events.groupBy(F.window(ts, f"{seconds} seconds")["start"].alias("start")).agg(F.count("*").alias("n"))
    days = by.withColumn("day", F.to_date("start"))
    totals = days.groupBy("day").agg(F.sum("n").alias("d"))
    before = totals.select("day", F.coalesce(F.sum("d").over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("day").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    return days.join(F.broadcast(before), "day").select("start", "n", (inside + F.col("before")).alias("cumulative"))


def desired_replicas(current: Column, load: Column, target: float, least: int, most: int, may_shrink: Column | None = None) -> Column:
    """Above the target in proportion, rounded down; below 70 percent of it one less, where shrinking is allowed; else unchanged."""
    shrink = F.lit(True) if may_shrink is None else may_shrink
    up = F.least(F.lit(most), F.floor(current * load / target))
    return F.when(load > target, up).when((load < target * 0.7) & shrink, F.greatest(F.lit(least), current - 1)).otherwise(current).cast("int")


def batch_advice(gpu_percent: Column, memory: Column, capacity: Column, batch: Column) -> Column:
    """(action, batch_size): double the batch at low use of memory and accelerator, halve it near the memory's end; null fields otherwise."""
    used = memory / capacity
    low, high = (used < 0.5) & (gpu_percent < 80), used > 0.95
    half = F.greatest(F.lit(1), F.floor(batch / 2))
    return F.struct(F.when(low, "increase_batch_size").when(high, "decrease_batch_size").alias("action"), F.when(low, batch * 2).when(high, half).cast("long").alias("batch_size"))


def instance_advice(gpu_percent: Column, cpu_percent: Column) -> Column:
    return F.when(gpu_percent < 30, "downgrade_gpu").when((cpu_percent > 90) & (gpu_percent < 60), "upgrade_cpu")


def within_budget(limits: dict[str, tuple[Column, float | None]]) -> Column:
    """Whether no known value is over its limit; a null value or no limit passes."""
    ok = F.lit(True)
    for value, limit in limits.values():
        if limit is not None:
            ok = ok & F.coalesce(value <= limit, F.lit(True))
    return ok


def reclaims(versions: Column, keep: int | None) -> Column:
    """Whether old versions may go: there are more than are to be kept. Without a number to keep, none go."""
    return F.lit(False) if keep is None else F.coalesce(versions > keep, F.lit(False))


def of_user(usage: DataFrame, user: str, value: object, ts: str, start: str, end: str) -> DataFrame:
    """A user's rows from start on, before end."""
    return usage.where((F.col(user) == value) & (F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


def matching_workers(workers: DataFrame, gpus: int, kind: str | None = None, status: str = "idle") -> DataFrame:
    """Workers that are alive, in the status, and have enough accelerators of the kind."""
    out = workers.where(F.col("alive") & (F.col("status") == status) & (F.col("gpu_count") >= gpus))
    return out if kind is None else out.where(F.col("gpu_type") == kind)


def cost_totals(manifests: DataFrame, total: str = "total") -> DataFrame:
    return manifests.agg(F.count("*").alias("runs"), F.sum(total).alias("total"))


def batch_judgments(rows: DataFrame, batch: str, first: str, second: str, least: float) -> DataFrame:
    """Per batch: rows, mean of both judges, and the share of rows that both accept."""
    both = (F.col(first) >= least) & (F.col(second) >= least)
    return rows.groupBy(batch).agg(F.count("*").alias("n"), F.avg(first).alias("judge_f_mean"), F.avg(second).alias("judge_r_mean"), F.avg(F.coalesce(both, F.lit(False)).cast("double")).alias("pass_rate"))


def tiered_limit(hits: DataFrame, limits: DataFrame, key: str, tier: str, second: str, ident: str, most: int, seconds: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, tier, ident, allowed) by a sliding log for each key and tier. limits: tier, most, seconds; a tier whose most is null is exempt, and
    one that is not listed has `most` and `seconds`. A hit is allowed if fewer than most allowed ones of its key and tier lie within the last
    seconds; hits of one second are taken in the order of ident. The hits of one key are folded in blocks, by many tasks."""
    listed = limits.select(F.col("tier").alias("_tier"), F.col("most").cast("long").alias("_most"), F.col("seconds").cast("double").alias("_seconds"), F.lit(True).alias("_known"))
    both = hits.select(F.col(key), F.col(tier), F.col(second).cast("double").alias("_t"), F.col(ident).cast("long").alias(ident)).join(listed, F.col(tier) == F.col("_tier"), "left")
    exempt = F.col("_known").isNotNull() & F.col("_most").isNull()
    free = both.where(exempt).select(key, tier, ident, F.lit(True).alias("allowed"))
    held = both.where(~exempt).withColumns({"_most": F.coalesce("_most", F.lit(most)), "_seconds": F.coalesce("_seconds", F.lit(float(seconds)))})

    def step(log: list, t: float | None, most: int, seconds: float) -> tuple[list, bool]:
        log = [x for x in log if t is not None and x is not None and x > t - seconds]
        return (log + [t], True) if len(log) < most else (log, False)

    out = folded(held, (key, tier), ("_t",), ("_t", "_most", "_seconds"), step, [], ("allowed", T_.BooleanType()), (ident,), block_rows)
    return free.unionByName(out)


def autoscaled(loads: DataFrame, pool: str, second: str, ident: str, load: str, target: float, least: int, most: int, up_cooldown: float = 60, down_cooldown: float = 300, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(pool, ident, replicas) after each load report of a pool, in the order of second and ident, from `least` on. Nothing changes within
    up_cooldown seconds of the last change. Above the target the replicas grow in proportion, rounded down, to `most`; below 70 percent of it
    one goes, down to `least`, if the last change is more than down_cooldown seconds ago. A null load changes nothing."""

    def step(state: list, t: float | None, value: float | None) -> tuple[list, int]:
        now, last = state
        if t is None or value is None or (last is not None and t - last < up_cooldown):
            return state, now
        want = now
        if value > target:
            want = min(int(now * (value / target)), most)
        elif value < target * 0.7 and (last is None or t - last > down_cooldown):
            want = max(now - 1, least)
        return [want, t if want != now else last], want

    rows = loads.select(pool, F.col(second).cast("double").alias("_t"), F.col(ident).cast("long").alias(ident), F.col(load).cast("double").alias("_load"))
    return folded(rows, (pool,), ("_t",), ("_t", "_load"), step, [least, None], ("replicas", T_.IntegerType()), (ident,), block_rows)
