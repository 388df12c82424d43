"""Random numbers that follow from a counter and a key: Philox 4x32 with ten rounds, as column expressions.

The same counters give the same numbers on any number of tasks, in any order, and a row can be made again alone. Products of 32-bit numbers are taken
in halves, so that no step leaves the range of a long.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The multipliers and key increments of the generator.
MULTIPLIERS, WEYL, ROUNDS = (0xD2511F53, 0xCD9E8D57), (0x9E3779B9, 0xBB67AE85), 10
LOW = 0xFFFFFFFF


def product(x: Column, by: int) -> tuple[Column, Column]:
    """(high, low) 32 bits of the product of two 32-bit numbers."""
    low = F.lit(by) * x.bitwiseAND(0xFFFF)
    high = F.lit(by) * F.shiftright(x, 16) + F.shiftright(low, 16)
    return F.shiftright(high, 16), F.shiftleft(high.bitwiseAND(0xFFFF), 16).bitwiseOR(low.bitwiseAND(0xFFFF))


def philox(counter: Column, stream: Column | int = 0, seed: int = 0) -> Column:
    """An array of four numbers of 32 bits, for a 64-bit counter and stream and a 64-bit seed."""
    stream, number = (F.lit(stream) if isinstance(stream, int) else stream).cast("long"), counter.cast("long")
    seed &= (1 << 64) - 1
    start = F.array(number.bitwiseAND(LOW), F.shiftrightunsigned(number, 32), stream.bitwiseAND(LOW), F.shiftrightunsigned(stream, 32))

    def turn(c: Column, i: Column) -> Column:
        keys = [(F.lit(k) + i * F.lit(w)).bitwiseAND(LOW) for k, w in zip((seed & LOW, seed >> 32), WEYL)]
        (h0, l0), (h1, l1) = product(c[0], MULTIPLIERS[0]), product(c[2], MULTIPLIERS[1])
        return F.array(h1.bitwiseXOR(c[1]).bitwiseXOR(keys[0]), l1, h0.bitwiseXOR(c[3]).bitwiseXOR(keys[1]), l0)

    rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
    return F.aggregate(rounds, start, turn)


def philox_rows(df: DataFrame, counter: str, streams: int, seed: int = 0, name: str = "_w") -> DataFrame:
    """df with philox() of streams 0, 1, ... as columns {name}{stream}_0 to _3. Every round is a projection of its own that the next one reads by
    name: each product is made once a row, in compiled arithmetic, where an expression inside a lambda is interpreted and made again wherever
    it is named."""
    seed &= (1 << 64) - 1
    number = F.col(counter).cast("long")
    first = []
    for s in range(streams):
        first += [number.bitwiseAND(LOW), F.shiftrightunsigned(number, 32), F.lit(s & LOW).cast("long"), F.lit(s >> 32).cast("long")]
    names = [f"{name}{s}_{i}" for s in range(streams) for i in range(4)]
    df = df.select("*", *[c.alias(n) for c, n in zip(first, names)])
    kept = [F.col(c) for c in df.columns if c not in names]
    for i in range(ROUNDS):
        keys, turned = [(k + i * w) & LOW for k, w in zip((seed & LOW, seed >> 32), WEYL)], []
        for s in range(streams):
            c = [F.col(f"{name}{s}_{j}") for j in range(4)]
            (h0, l0), (h1, l1) = product(c[0], MULTIPLIERS[0]), product(c[2], MULTIPLIERS[1])
            turned += [h1.bitwiseXOR(c[1]).bitwiseXOR(keys[0]), l1, h0.bitwiseXOR(c[3]).bitwiseXOR(keys[1]), l0]
        df = df.select(*kept, *[c.alias(n) for c, n in zip(turned, names)])
    return df


def uniform(word: Column) -> Column:
    """A number in (0, 1) of a 32-bit one."""
    return (word + 0.5) / float(1 << 32)


def normals(words: list[Column]) -> list[Column]:
    """Four standard normal numbers of four words, two by two."""

    def pair(a: int) -> list[Column]:
        size, angle = F.sqrt(-2 * F.log(uniform(words[a]))), 2 * math.pi * uniform(words[a + 1])
        return [size * F.cos(angle), size * F.sin(angle)]

    return [*pair(0), *pair(2)]
