"""Counter-based random numbers, generated data, fingerprints and built episodes."""

import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import philox as P
from quarry.operators import dialogs as D
from quarry.operators import episodes as E
from quarry.operators import fingerprints as K
from quarry.operators import generators as G


def words(counter, stream, seed):
    """Ten rounds in Python's whole numbers."""
    c, k = [counter & P.LOW, counter >> 32, stream & P.LOW, stream >> 32], [seed & P.LOW, seed >> 32]
    for _ in range(10):
        a, b = P.MULTIPLIERS[0] * c[0], P.MULTIPLIERS[1] * c[2]
        c = [(b >> 32) ^ c[1] ^ k[0], b & P.LOW, (a >> 32) ^ c[3] ^ k[1], a & P.LOW]
        k = [(x + w) & P.LOW for x, w in zip(k, P.WEYL)]
    return c


def test_philox_gives_the_published_numbers(spark):
    """The known answers for all zeros and all ones, and the definition for others."""
    got = spark.range(1).select(P.philox(F.lit(0)).alias("x"), P.philox(F.lit(-1).cast("long"), F.lit(-1).cast("long"), (1 << 64) - 1).alias("y")).first()
    assert [f"{v:08x}" for v in got.x] == ["6627e8d5", "e169c58d", "bc57ac4c", "9b00dbd8"]
    assert [f"{v:08x}" for v in got.y] == ["408f276d", "41c83b0e", "a20bc7c6", "6d5451fd"]
    rows = spark.createDataFrame([(i * 0x123456789AB, i * 77 + (i << 40)) for i in range(40)], "c long, s long").select("c", "s", P.philox(F.col("c"), F.col("s"), 0xDEADBEEF12345678).alias("x")).collect()
    assert all(list(r.x) == words(r.c, r.s, 0xDEADBEEF12345678) for r in rows)


def test_philox_by_rows_names_each_product_once(spark):
    """The same numbers as the definition's, and a plan without interpreted lambdas in which a round is read by the next one's name."""
    rows = spark.createDataFrame([(i * 0x123456789AB - 5,) for i in range(40)], "c long")
    out = P.philox_rows(rows, "c", 2, 0xDEADBEEF12345678)
    for r in out.collect():
        assert list(r[1:]) == words(r.c & ((1 << 64) - 1), 0, 0xDEADBEEF12345678) + words(r.c & ((1 << 64) - 1), 1, 0xDEADBEEF12345678)
    for made in (G.linear(rows, "c"), G.classification(rows, "c")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and len(plan) < 60_000 and plan.count("3528531795") < 200


def test_rows_do_not_depend_on_partitions(spark):
    prompts = ({"prompt_text": "a", "domain": "x"}, {"prompt_text": "b", "domain": "y"}, {"prompt_text": "c", "domain": "z"})
    for make in (lambda k: G.classification(k, "id", 5, 3), lambda k: G.linear(k, "id"), lambda k: G.corpus(k, "id", prompts, seed=1)):
        keys = spark.range(3000)
        one, many = (K.fingerprint(make(keys.repartition(n))).first() for n in (1, 64))
        assert one == many and one.n == 3000


def test_moments(spark):
    x = np.array([list(r) for r in G.classification(spark.range(20_000), "id", 6, 4).drop("id").collect()])
    z, label = x[:, :6], x[:, 6]
    assert np.abs(z.mean(0)).max() < 0.03 and np.abs(z.std(0) - 1).max() < 0.02 and np.abs(np.corrcoef(z.T) - np.eye(6)).max() < 0.03
    assert np.abs((z**3).mean(0)).max() < 0.1 and np.abs((z**4).mean(0) - 3).max() < 0.2
    assert np.abs(np.bincount(label.astype(int), minlength=4) / 20_000 - 0.25).max() < 0.02
    y = np.array([list(r) for r in G.linear(spark.range(20_000), "id").drop("id").collect()])
    assert abs(y[:, 4].mean() - 0.5) < 0.02 and ((y[:, :4] @ G.WEIGHTS > 0) == y[:, 4]).mean() > 0.92
    turns = G.corpus(spark.range(7), "id", ({"p": "a"}, {"p": "b"})).orderBy("id").collect()
    assert [r.p for r in turns] == list("abababa") and turns[3].sample_id == "sample_000003"


def test_fingerprints_are_of_multisets(spark):
    rows = [(1, "a", [1.0]), (2, None, None), (1, "a", [1.0]), (3, "", [])]
    kind = "k int, t string, v array<double>"
    df = spark.createDataFrame(rows, kind)
    of = lambda d: tuple(K.fingerprint(d).first())
    assert of(df) == of(df.repartition(3)) == of(df.select("v", "k", "t")) == of(spark.createDataFrame(rows[::-1], kind))
    assert of(df) != of(df.distinct()) and of(df.where("k = 2")) != of(spark.createDataFrame([(2, "", None)], kind)) and of(df.limit(0)) == (0, 0, 0)
    added = K.combined((K.fingerprint(df), 1), (K.fingerprint(df.where("k = 1")), -1), (K.fingerprint(df.where("k = 3")), 1)).first()
    assert tuple(added) == of(df.where("k > 1").unionByName(df.where("k = 3")))
    h = [hashlib.md5(f"{k}\x1f{t if t is not None else chr(0)}\x1f{json.dumps(v) if v is not None else chr(0)}".encode()).hexdigest().replace(" ", "") for k, t, v in rows]
    assert of(df) == (4, sum(int(x[:16], 16) for x in h) % K.PRIMES[0], sum(int(x[16:], 16) for x in h) % K.PRIMES[1])


def test_runs_that_differ_are_named_by_shard(spark):
    calls = []

    def job():
        calls.append(1)
        shift = F.when((F.col("shard") == 2) & F.lit(len(calls) == 2), 1).otherwise(0)
        return spark.range(40).select((F.col("id") % 4).alias("shard"), "id").select("shard", (F.col("id") + shift).alias("id"))

    assert {r.shard: (r.n_first, r.same) for r in K.run_twice(job, ("shard",)).collect()} == {0: (10, True), 1: (10, True), 2: (10, False), 3: (10, True)}
    apart = K.compared(K.fingerprint(spark.range(3), ("id",)), K.fingerprint(spark.range(1, 4), ("id",)), ("id",)).collect()
    assert {r.id: (r.n_first, r.n_second, r.same) for r in apart} == {0: (1, 0, False), 1: (1, 1, True), 2: (1, 1, True), 3: (0, 1, False)}


def test_an_episode_is_a_walk_through_its_states():
    scene = E.Scene("t", F.lit(1), F.lit("p"))
    asked, report = ("ask", F.lit("p")), scene.report("x")
    E.walked([asked, *scene.search(1), report])
    for steps in ([asked, report], [scene.search(1)[0]], [asked, scene.search(1)[1]], [asked, *scene.search(1)], [asked, scene.search(1)[0], scene.error("s", "m", 1), report]):
        with pytest.raises(ValueError):
            E.walked(steps)


def test_episodes_read_as_json(spark):
    rows = [(i, p, c) for i, (p, c) in enumerate([('Convert 3 m to cm, "now"', "units"), ("What of\nrate 5?", "literature"), (None, "simulation"), ("é 2", "hybrid"), ("", "other")])]
    df = spark.createDataFrame(rows, "id long, prompt string, category string")
    built = {r.id: r for r in E.built(df.where("prompt IS NOT NULL"), "id", "prompt", "category").collect()}
    fixed = {r.id: r for r in E.repairs(spark.range(3), "id").collect()}
    assert [fixed[i].repair for i in range(3)] == list(E.REPAIRS)
    for r in [*built.values(), *fixed.values()]:
        assert r.messages[0].role == "user" and r.messages[-1].role == "assistant" and all(m.content is not None for m in r.messages)
        blocks = [b for m in r.messages for b in re.findall(r"~~~\w+\n(.*?)\n~~~", m.content, re.S)]
        broken = [b for b in blocks if not _reads(b)]
        assert len(broken) == (1 if getattr(r, "id") == 0 and "repair" in r else 0)
    call, result = (json.loads(re.search(r"(?s)~~~\w+\n(.*)\n~~~", built[0].messages[i].content)[1]) for i in (1, 2))
    assert call["args"] == {"value": 3.0, "from_unit": "m", "to_unit": "cm"} and result["data"] == {"value": 300.0, "unit": "cm"} and result["id"] == call["id"]
    assert json.loads(re.search(r"(?s)~~~\w+\n(.*)\n~~~", built[1].messages[3].content)[1])["args"]["doi"] == json.loads(re.search(r"(?s)~~~\w+\n(.*)\n~~~", built[1].messages[-1].content)[1])["evidence"][0]["doi"]
    assert D.TOOLS and E.built(df.limit(0), "id", "prompt", "category").collect() == []


def _reads(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def test_parts_of_an_episode_are_made_once_a_row(spark):
    prompts = spark.createDataFrame([(1, "Convert 2 m to cm", "units"), (2, "Porosity of 3 cathodes", "hybrid")], "id long, prompt string, category string").repartition(2)
    plan = E.built(prompts, "id", "prompt", "category")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") <= 3 and plan.count("EXP(") <= 1 and plan.count("convert\\s+") <= 8
