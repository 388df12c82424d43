"""Sharding by a hierarchical weighted hash tree: region, rack and shard levels, each chosen by weighted hash draws.

At a node every child draws -ln(u) / weight, u being a hash of the key, the node and the child; the smallest draw wins, which
gives each child a share in proportion to its weight. A change of weight moves keys only into or out of the subtree that it
changes. `Topology.grown()` adds a shard as a region of its own, so that no weight inside the old regions changes: the rows that
move all move to the new shard. Runs on DataFrame functions alone.

Law `key`: the id and the shard count decide. Cases: a null id hashes as the text `null`; equal ids share a shard; a null text has
size 16 and the checksum of the empty string; slots of equal rows are dealt among them in turn; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Rows of a shard are numbered in so many buckets side by side, so that no task holds a shard.
SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Topology:
    """shards: (region, rack, shard, weight) of each leaf."""

    shards: tuple[tuple[int, int, int, float], ...]

    @staticmethod
    def laid_out(n: int, racks: int = 2, per_rack: int = 5) -> Topology:
        """n shards of weight 1, filled in order into racks of per_rack shards and regions of so many racks."""
        return Topology(tuple((s // (per_rack * racks), s // per_rack, s, 1.0) for s in range(n)))

    def grown(self, weight: float = 1.0) -> Topology:
        """One shard more, in a region and a rack of its own."""
        region, rack, shard = (max(x[i] for x in self.shards) + 1 for i in range(3))
        return Topology((*self.shards, (region, rack, shard, weight)))

    def tree(self, level: int = 0, parent: tuple = ()) -> Column:
        """The subtree below the path parent: an array of (id, weight, the child's own subtree)."""
        weights: dict[int, float] = {}
        for *path, weight in self.shards:
            if tuple(path[:level]) == parent:
                weights[path[level]] = weights.get(path[level], 0.0) + weight
        below = [F.lit(0) if level == 2 else self.tree(level + 1, (*parent, child)) for child in sorted(weights)]
        return F.array(*[F.struct(F.lit(c).alias("id"), F.lit(w).alias("weight"), b.alias("below")) for (c, w), b in zip(sorted(weights.items()), below)])


LEVELS = ("region", "rack", "shard")


def choose(key: Column, level: str, children: Column) -> Column:
    """The child whose draw is the smallest. A draw is an exponential variate whose rate is the child's weight, fixed by key,
    level and child."""

    def draw(child: Column) -> Column:
        h = F.xxhash64(F.concat_ws("|", key, F.lit(level), child["id"].cast("string")))
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["id"].alias("id"), child["below"].alias("below"))

    return F.array_min(F.transform(children, draw))


def descend(key: Column, topology: Topology) -> Column:
    """The shard of a key, going down one level at a time."""
    node = topology.tree()
    for level in LEVELS:
        at = choose(key, level, node)
        node = at["below"]
    return at["id"]


def number(rows: DataFrame, group: str, out: str = "slot", buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Numbers the rows of each group from 0 without a gap. Equal rows are counted before the shuffle and dealt out after it;
    inside a group the rows go through buckets by hash, whose first numbers come from the buckets' counts."""
    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    counted = materialise(counted.withColumn("__b", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")), "counted")  # read twice
    totals = counted.groupBy(group, "__b").agg(F.sum("__n").alias("__total"))
    before = F.sum("__total").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select(group, "__b", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.sum("__n").over(Window.partitionBy(group, "__b").orderBy(*[F.col(c).asc_nulls_first() for c in columns]).rowsBetween(Window.unboundedPreceding, -1))
    dealt = counted.withColumn("__at", F.coalesce(inside, F.lit(0))).join(starts, [group, "__b"])
    first = F.col("__start") + F.col("__at")
    return dealt.select(*columns, F.explode(F.sequence(first, first + F.col("__n") - 1)).alias(out))


def shard(docs: DataFrame, topology: Topology, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot and grown_shard (the shard with one more shard)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    key = F.coalesce(F.col(id_column).cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_column), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("__key"))
    rows = rows.withColumn("shard", descend(F.col("__key"), topology)).withColumn("grown_shard", descend(F.col("__key"), topology.grown())).drop("__key")
    return number(rows, "shard").select(id_column, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
