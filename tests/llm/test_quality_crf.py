"""Quality rules: base measures and decoding by brute force, the gradient by differences, held-out verdicts."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import common, quality_crf as q

SF = "/root/testdata/sf0.1"


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dups = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dups += x in seen
            seen.add(x)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    cover = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(cover)


def test_base_measures():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choices(["a ", "b ", "é#", "c\n", "\n", " |", "\x0b", " ", "\x1c", "d\t"], k=r.randint(0, 60)))
        words = text.encode().split()
        assert (len(words), *q.base(text.encode(), words)) == brute_base(text)


def random_field(rng):
    return q.Field(np.vstack([rng.normal(size=(q.N_FEATURES, 2)), np.zeros((1, 2))]), rng.normal(size=(2, 2)), rng.normal(size=2))


def score(field, f, labels):
    e = field.emissions(f)
    return field.first[labels[0]] + sum(e[i, x] for i, x in enumerate(labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))


def test_decoding_is_the_best_sequence():
    rng = np.random.default_rng(3)
    field = random_field(rng)
    texts = [rng.integers(0, q.N_FEATURES, (n, 12)) for n in (3, 0, 7, 1, 5)]
    for f, got in zip(texts, field.decode(texts)):
        assert len(f) == len(got)
        if len(f):
            best = max(itertools.product((0, 1), repeat=len(f)), key=lambda x: score(field, f, x))
            assert abs(score(field, f, best) - score(field, f, got.tolist())) < 1e-9


def test_gradient():
    rng = np.random.default_rng(4)
    features, mask = rng.integers(0, q.N_FEATURES, (3, 4, 12)), np.array([[1, 1, 1, 1], [1, 0, 0, 0], [1, 1, 0, 0]], dtype=bool)
    labels, params = rng.integers(0, 2, (3, 4)), rng.normal(size=q.N_FEATURES * 2 + 6)
    value, grad = q.likelihood(params, features, labels, mask, 0.1)
    for i in [0, 5, len(params) - 6, len(params) - 4, len(params) - 1]:
        d = np.zeros_like(params)
        d[i] = 1e-6
        up, down = (q.likelihood(params + s * d, features, labels, mask, 0.1)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-4
    assert value < 0


def test_likelihood_by_all_sequences():
    rng = np.random.default_rng(8)
    features, mask = rng.integers(0, q.N_FEATURES, (2, 4, 12)), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], dtype=bool)
    labels, params = rng.integers(0, 2, (2, 4)), rng.normal(size=q.N_FEATURES * 2 + 6)
    f = q.N_FEATURES * 2
    field = q.Field(np.vstack([params[:f].reshape(-1, 2), np.zeros((1, 2))]), params[f : f + 4].reshape(2, 2), params[f + 4 :])
    want = 0.0
    for x, y, m in zip(features, labels, mask):
        x, y = x[m], y[m].tolist()
        want += score(field, x, y) - np.logaddexp.reduce([score(field, x, z) for z in itertools.product((0, 1), repeat=len(x))])
    assert abs(q.likelihood(params, features, labels, mask, 0.0)[0] - want) < 1e-9


def test_held_out_verdicts_and_mixed_documents(spark):
    """Documents that were not learned from; and such with a run of the other kind's lines put in, which is found inside them."""
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    field = q.train(docs, labels, per_label=250)
    rest = docs.join(labels, "doc_id").join(q.training_labels(labels, 250), "doc_id", "left_anti")
    got = q.judge(rest.select("doc_id", "text"), field).join(labels, "doc_id").where("n_words >= 50").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert len(good) > 1000 and len(bad) > 100
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.15

    r = random.Random(5)
    texts = {k: [x.text.split("\n") for x in rest.where(F.col("quality") == k).orderBy("doc_id").limit(120).collect() if len(x.text.split("\n")) > 3] for k in (0, 1)}
    rows, truth = [], {}
    for i, host in enumerate(texts[1]):
        guest, at = r.choice(texts[0])[-3:], r.randrange(len(host) + 1)
        rows.append((i, "\n".join([*host[:at], *guest, *host[at:]])))
        truth[i] = [0] * at + [1] * 3 + [0] * (len(host) - at)
    found = q.judge(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()
    pairs = [(x, t) for f in found if len(f.line_labels) == len(truth[f.doc_id]) for x, t in zip(f.line_labels, truth[f.doc_id])]
    assert sum(len(set(f.line_labels)) == 2 and 0 < f.content_share < 1 for f in found) > 0.9 * len(found)
    assert sum(x == t for x, t in pairs) / len(pairs) > 0.9


def test_odd_inputs(spark):
    rows = [(1, None), (2, ""), (None, " \n"), (3, "word " * 60), (4, "x" * 300000), (4, "a b c " * 40 + "\n" + "a b c " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality long")
    got = q.judge(docs, q.train(docs, labels)).collect()
    assert len(got) == 6 and all(r.base_failed and not r.kept for r in got)
    assert sorted(r.n_dup_lines for r in got)[-1] == 1
    clash = q.judge(docs.selectExpr("*", "'x' AS n_words", "1 AS kept", "2 AS line_labels", "'t' AS content_share"), q.train(docs, labels))
    assert dict(clash.dtypes)["n_words"] == "bigint" and clash.count() == 6
    assert q.judge(docs.limit(0), q.train(docs.limit(0), labels)).collect() == []
