"""Filter audit: every order played out document by document, Shapley values from their definition, odd inputs."""

import itertools
import random

from quarry.llm import filter_audit as fa
from quarry.llm import queries

from .. import oracle

SMALL = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"


def words(text):
    out = [""]
    for c in text:
        if c in SPACE:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def fails(rows):
    """The filters that each row (id, text, part) fails, from their definitions."""
    out = []
    for i, text, _ in rows:
        t, own = text or "", set()
        w = words(t)
        own |= {"A"} if len(w) < 50 else set()
        own |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        own |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        own |= {"D"} if any(c in "#$%&*|" for c in t) else set()
        if any((u or "") == t and j is not None and (i is None or j < i) for j, u, _ in rows):
            own.add("E")
        out.append(own)
    return out


def brute(rows, good, toxic):
    out, failed = [], fails(rows)
    for part in {p or "" for _, _, p in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        shapley, by = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                redundant = sum(f in x[1] for x in mine) - len(gone)
                by.append((part, order, step, len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in by]
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    texts = ["", None, "word " * 60, "Ab " * 10, " ".join(f"w{i}" for i in range(70)), "é" * 30 + "A", "x y " * 50, "\x0b\f \t"]
    texts += [" ".join(r.choice(("W", "w", "$")) + str(r.randrange(40)) for _ in range(r.randint(1, 90))) for _ in range(12)]
    rows = [(r.choice([None, r.randrange(60)]), r.choice(texts), r.choice(["s1", "s2", None, ""])) for _ in range(120)]
    return rows + rows[:5]


def test_matches_every_order_played_out(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 60, 2)] + [(4, 1, 0), (None, 1, 1)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).selectExpr("*", "1 AS mask", "2 AS part", "3 AS good", "4 AS `all`")
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS part")
        good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
        assert sorted(map(tuple, fa.audit(docs, marks).collect())) == brute(rows, good, toxic)


def test_polynomial_is_the_expected_removal():
    """At a corner it counts what the filters remove; inside, their expectation; its Shapley values add up to all that is removed."""
    r = random.Random(4)
    counts = [r.randrange(20) for _ in range(fa.MASKS)]
    p = fa.Removal(counts)
    for s in range(fa.MASKS):
        assert p.corner(s) == sum(n for m, n in enumerate(counts) if m & s)
    x = [r.random() for _ in range(5)]
    value = sum(c * __import__("math").prod(x[i] for i in range(5) if s >> i & 1) for s, c in enumerate(p.coefficients))
    want = sum(n * (1 - __import__("math").prod(1 - x[i] for i in range(5) if m >> i & 1)) for m, n in enumerate(counts))
    assert abs(value - want) < 1e-9
    shares = [p.shapley(f) for f in range(5)]
    assert sum(shares) == p.corner(31) and all((s * 120).denominator == 1 for s in shares)
    assert shares[2] * 120 == sum(n * 120 // m.bit_count() for m, n in enumerate(counts) if m >> 2 & 1)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(none, labels).collect() == []
    one = fa.audit(spark.createDataFrame([(1, "a $ B", None)], none.schema), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one if r.filter_order == "ABCDE") == 1


def test_query_matches_its_sql(spark):
    oracle.check(queries.op11_filter_audit(spark, SMALL), queries.OP11_SQL, SMALL)
