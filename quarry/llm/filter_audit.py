"""Interaction audit of text filters: what each removes, alone and in every order, with exact Shapley values by the multilinear extension.

Five filters fail a document. A: under 50 words; B: fewer than 65 distinct words in 100; C: more than 5 capitals A-Z in 100 characters; D: a
character of `#$%&*|`; E: the text is that of a smaller id, anywhere in the table.

1. Masks. Every document gets the set of filters that it fails as a five-bit mask, by column expressions over its whole text. For E, rows are
   grouped by 128 bits of hashes of the text; groups of copies meet in partial aggregates that keep the least id, and only texts that occur
   more than once are joined back.
2. Counts by part and mask, for all documents and for those with each label: at most 32 numbers a part, however many documents there are.
3. Polynomial. With x_f the chance that filter f is applied, the expected number of removed documents is the multilinear polynomial
   sum over masks m of n_m * (1 - product over f in m of (1 - x_f)); its coefficients by set of variables come from the counts.
4. A filter's Shapley value is the integral of the partial derivative by x_f along the diagonal from 0 to 1: a monomial of k variables, x_f
   among them, gives its coefficient over k, as an exact rational. Times 120, the number of orders, it is a whole number.
5. What survives a prefix of an order is the polynomial at the corner whose coordinates are 1 for the filters applied; what a step removes
   is the difference of two corners. The labelled counts have polynomials of their own.

Cases: null and empty texts are equal and have no words: they fail A alone, and E after the first. Null ids come last: a null id's text fails E if
any row with an id has it; rows of equal id and text do not fail for each other. A null source is the empty string. A document is good or toxic
if any label row with its id says so. An empty table has no parts and gives no rows. Other columns do not matter.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 50, 65, 5, "[#$%&*|]"
_SPACE = r"[ \t\n\x0B\f\r]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MASKS = 1 << len(FILTERS)
#: The counts that have a polynomial.
COUNTS = ("all", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """The failure conditions of a text (null: empty) that the text alone decides."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, _CAPITALS, ""))) > CAPITAL_PERCENT * F.length(text),
        "D": F.regexp_like(text, F.lit(SIGNS)),
    }


def masks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(id, part, mask) of each document; bit i of the mask is the i-th filter."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    own = sum((F.when(failed, 1 << FILTERS.index(f)).otherwise(0) for f, failed in failures(text).items()), F.lit(0))
    node = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("audit"), text).alias("b"))
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), node.alias("node"), own.alias("own"))
    rows = common.materialise(rows, "measured")
    least = F.min(F.struct(F.col("id").isNull().alias("z"), "id"))
    firsts = rows.groupBy("node").agg(least.alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("node").alias("copied"), "first")
    both = rows.join(firsts, F.col("node") == F.col("copied"), "left")
    later = F.col("first").isNotNull() & F.when(F.col("id").isNull(), ~F.col("first.z")).otherwise(F.col("first.id") < F.col("id"))
    return both.select("id", "part", (F.col("own") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def mask_counts(masked: DataFrame, labels: DataFrame, id_column: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, all, good, toxic): arrays of the number of documents by mask."""
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("labelled")).agg(*[F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in ((good, "good"), (toxic, "toxic"))])
    both = masked.join(marks, masked["id"] == marks["labelled"], "left").withColumn("all", F.lit(1))
    counts = both.groupBy("part", "mask").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c) for c in COUNTS])
    entry = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS))))  # 32 at most
    by = counts.groupBy("part").agg(entry.alias("of"))

    def dense(name: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.coalesce(F.try_element_at("of", m)[name], F.lit(0).cast("long"))).alias(name)

    return by.select("part", *[dense(c) for c in COUNTS])


class Removal:
    """The multilinear polynomial of what filters remove: coefficients by set of variables (a bit each)."""

    def __init__(self, counts: list[int]):
        """1 - product over m of (1 - x_f) = sum over the non-empty subsets s of m of (-1)^(|s| + 1) times the monomial of s."""
        self.coefficients = [0] * len(counts)
        for m, n in enumerate(counts):
            s = m
            while s and n:
                self.coefficients[s] += n if s.bit_count() % 2 else -n
                s = (s - 1) & m

    def corner(self, applied: int) -> int:
        """The value where the variables of a set are 1 and the others 0: the documents that these filters remove."""
        return sum(c for s, c in enumerate(self.coefficients) if s & ~applied == 0)

    def shapley(self, f: int) -> Fraction:
        """The integral over t from 0 to 1 of the partial derivative by variable f where all variables are t: t^(k - 1) integrates to 1 / k."""
        return sum((Fraction(c, s.bit_count()) for s, c in enumerate(self.coefficients) if s >> f & 1), Fraction(0))


def report(all_: list[int], good: list[int], toxic: list[int]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders and steps of one part."""
    n, total = len(FILTERS), sum(all_)
    polynomials = [Removal(c) for c in (all_, good, toxic)]
    corners = [[p.corner(s) for s in range(MASKS)] for p in polynomials]
    fails = [corners[0][1 << f] for f in range(n)]
    values = [polynomials[0].shapley(f) * 120 for f in range(n)]
    out = []
    for order in permutations(range(n)):
        name, applied = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            then = applied | 1 << f
            gone, good_lost, toxic_lost = (c[then] - c[applied] for c in corners)
            out.append((name, step, total - corners[0][then], gone, fails[f] - gone, all_[1 << f], good_lost, toxic_lost, int(values[f])))
            applied = then
    return out


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source", label_id: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """A row per part, order and step: the documents kept, removed, redundant, failing this filter only, the labelled ones lost, and 120 times the
    filter's Shapley value."""
    counts = mask_counts(masks(docs, id_column, text_column, part_column), labels, label_id, good, toxic)
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches):
        for batch in batches:
            for part, *by in zip(*(batch.column(i).to_pylist() for i in range(1 + len(COUNTS)))):
                rows = report(*by)
                columns = [pa.array([part] * len(rows), pa.string())]
                columns += [pa.array(c, pa.string() if i == 0 else pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return counts.mapInArrow(run, OUT)
