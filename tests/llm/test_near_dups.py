"""Near-duplicate classes against all pairs of a small corpus."""

import random

import numpy as np

from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm import near_dups as nd


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def labelled(text):
    w, seen, out = text.split(), {}, []
    for s in [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))]:
        seen[s] = seen.get(s, 0) + 1
        out.append((s, seen[s]))
    return out


def similar(a, b):
    a, b = labelled(a), labelled(b)
    m = lcs(a, b)
    return m / (len(a) + len(b) - m)


def brute(rows):
    ids = [i for i, t in rows if t and t.split()]
    text = dict(rows)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if find(i) != find(j) and similar(text[i], text[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def corpus(seed):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    rows, passage = [], " ".join(r.choices(words, k=25))
    for _ in range(14):
        base = r.choices(words, k=r.choice([1, 4, 6, 12, 40, 60, 90, 200]))
        for _ in range(r.randint(1, 7)):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append(" ".join(copy) + (" " + passage if r.random() < 0.3 else ""))
    rows += ["der " * 60, "der " * 64, "", None, " \n", rows[0]]
    return list(enumerate(rows))


def test_similarity_is_the_ordered_share():
    r = random.Random(5)
    for _ in range(200):
        a = r.choices("abcdefgh", k=r.randint(1, 60))
        b = [x for x in a if r.random() > 0.03]
        a, b = " ".join(a), " ".join(b)
        if b:
            got, want = nd.similarity(nd.shingles(a, {}), nd.shingles(b, {})), similar(a, b)
            assert abs(got - want) < 1e-9 if want >= 0.8 else got < 0.8


def test_classes_match_all_pairs(spark):
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in nd.near_dup_classes(df).collect()}
    assert got == brute(rows)
    kept = nd.keep_one(df.selectExpr("*", "'x' AS rep", "1 AS node")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values())) and kept[0].asDict().keys() == {"doc_id", "text", "rep", "node"}


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL_BUCKET", 2)
    for block, cells in ((150, 1 << 21), (10**6, 700)):
        monkeypatch.setattr(nd, "BLOCK_SHINGLES", block)
        r = random.Random(block)
        base = [f"w{i}" for i in range(70)]
        rows = []
        for i in range(40):
            copy = list(base)
            for _ in range(r.choice([1, 2, 3, 4])):
                copy[r.randrange(70)] = f"x{r.randrange(9)}"
            rows.append((i, " ".join(copy)))
        monkeypatch.setattr(nd, "CELLS", cells)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert {x.doc_id: x.class_id for x in nd.near_dup_classes(df).collect()} == brute(rows)


def test_ties_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (1, text + " x"), (None, text), (None, "other words here"), (2, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, nd.near_dup_classes(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (1, 1), (None, 1), (None, None), (2, 2), (2, 2)], key=str)
    assert len(nd.keep_one(df).collect()) == 4
    assert nd.near_dup_classes(df.limit(0)).collect() == []


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(map(tuple, nd.connected(links).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_sketches_are_few_and_whole():
    h = nd.shingles(" ".join(f"w{i}" for i in range(60000)), {})
    assert len(h) == 59996 and len(nd.sketches(h)) == 64
    assert len(np.unique(nd.sketches(nd.shingles("a b", {})))) == 32


def test_texts_whose_hashes_fall_together_stay_apart(spark, monkeypatch):
    strong = nd.hashed
    monkeypatch.setattr(nd, "hashed", lambda text, salt=0: strong(text, salt) % 5 if salt < 2 else strong(text, salt))
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.class_id for r in nd.near_dup_classes(df).collect()} == brute(rows)
    assert sorted(r.doc_id for r in nd.keep_one(df).collect()) == sorted(set(brute(rows).values()))


def colliding(r):
    """Two texts of one xxhash64: the second stripe of 32 bytes undoes what the first does to the hash's first lane. Words and all else differ
    enough that no five of them in a row are common."""
    mask, p1, p2 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F

    def after(lane):
        x = (42 + p1 + p2 + int.from_bytes(lane, "little") * p2) & mask
        return ((x << 31 | x >> 33) * p1) & mask

    a, b = b"collided", b"together"
    while True:
        c = bytes(r.choices(b"abcdefghijklmnopqrstuvwxyz", k=8))
        d = (int.from_bytes(b, "little") + (after(a) - after(c)) * pow(p2, -1, 1 << 64)) & mask
        d = d.to_bytes(8, "little")
        if all(32 < x < 127 for x in d):
            return tuple((x + b" one two three four five " [:24] + y + b" six seven eight nine ten"[:24]).decode() for x, y in ((a, b), (c, d)))


def test_texts_of_the_same_raw_hash_stay_apart(spark):
    """The 64-bit hash itself collides here, as Spark computes it, not a remainder of it; the check does not follow from it."""
    r = random.Random(3)
    a, b = colliding(r)
    assert a != b
    rows = [(1, a), (2, b), (3, b), (4, a), (5, "another text altogether with more words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert df.select(F.xxhash64("text")).distinct().count() == 2
    assert df.select(nd.checked("text")).distinct().count() == 3
    assert df.where(nd.checked("text") == F.xxhash64("text", F.lit("check"))).count() == 0
    assert {x.doc_id: x.class_id for x in nd.near_dup_classes(df).collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5}
    assert sorted((x.doc_id, x.text) for x in nd.keep_one(df).collect()) == [(1, a), (2, b), (5, rows[4][1])]


def test_many_copies_and_a_stranger_are_linear_work(spark):
    """The blocks of a large class are not put beside each other: rows grow with the copies, not with their square."""
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("key"), (F.col("id") + 10).alias("node"), F.lit(60).alias("n"), F.lit(10).cast("long").alias("root"))
    stranger = spark.createDataFrame([(1, 5, 60, 5)], "key long, node long, n int, root long")
    out = nd.dealt(rows.unionByName(stranger))
    blocks = 100_000 * 60 // nd.BLOCK_SHINGLES
    assert 100_000 + blocks <= out.count() <= 100_000 + blocks + 2
    assert out.groupBy("key", "i", "j").count().agg(F.max("count")).first()[0] < 2 * nd.BLOCK_SHINGLES / 60


def test_a_text_is_once_in_the_bucket_of_its_near_copies(spark, monkeypatch):
    """However many sketches near copies share: rows of buckets grow with the copies alone."""
    r, write, seen = random.Random(8), common.materialise, []

    def written(df, label):
        out = write(df, label)
        if label in ("buckets", "mixed"):
            seen.append((label, out.count()))
        return out

    monkeypatch.setattr(common, "materialise", written)
    base = [f"w{i}" for i in range(120)]
    for n in (30, 60):
        rows = []
        for i in range(n):
            copy = list(base)
            copy[r.randrange(120)] = f"x{i}"
            rows.append((i, " ".join(copy)))
        got = nd.near_dup_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert {x.class_id for x in got} == {0}
        assert 0 < sum(count for _, count in seen) <= 10 * n
        seen.clear()


def test_the_largest_class_of_a_bucket_meets_the_others(spark):
    """A stranger that is like one text of the largest class alone, and one that is like none."""
    base = [f"w{i}" for i in range(100)]
    texts = {1: base[:], 2: base[:], 3: base[:], 4: base[:], 5: [f"y{i}" for i in range(80)] + base[80:]}
    for node, places in ((2, range(0, 6)), (3, range(0, 12)), (4, range(0, 18))):
        for i in places:
            texts[node][i] = f"x{i}"
    words = {node: " ".join(t) for node, t in texts.items()}
    near = {(a, b) for a in words for b in words if a < b and similar(words[a], words[b]) >= 0.8}
    assert near & {(1, 4), (2, 4), (3, 4)} == {(3, 4)} and not any(5 in pair for pair in near)
    root = {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    rows = spark.createDataFrame([(7, k, len(nd.shingles(t, {})), root[k]) for k, t in words.items()], "key long, node long, n int, root long")
    hashes = spark.createDataFrame([(k, bytearray(nd.shingles(t, {}).tobytes())) for k, t in words.items()], "node long, h binary")
    assert [tuple(x) for x in nd.alike(rows, hashes, 0.8).collect()] == [(3, 4)]
    met = nd.dealt(rows).groupBy("key", "i", "j").agg(F.collect_set("root").alias("roots")).where("i < 0").collect()
    assert [sorted(x.roots) for x in met] == [[1, 4, 5]]


def test_texts_set_aside_reach_the_threshold_with_none():
    r = random.Random(2)
    for _ in range(40):
        rows = [t for _, t in corpus(r.random()) if t and t.split()]
        sets = [nd.shingles(t, {}) for t in rows]
        sizes = np.array([len(x) for x in sets])
        number = np.unique(np.concatenate(sets), return_inverse=True)[1]
        left = np.array([r.random() < 0.5 for _ in rows])
        for one, other in ((left, ~left), (left, left)):
            (a, x), (b, y), width = nd.sides(number, sizes, one, other, 0.8)
            assert len(x[0]) == len(x[1]) and (not width or max(x[1].max(initial=0), y[1].max(initial=0)) < width)
            for u in np.flatnonzero(one):
                for v in np.flatnonzero(other):
                    if u != v and nd.similarity(sets[u], sets[v]) >= 0.8:
                        assert u in a and v in b
    passage = [f"p{i}" for i in range(50)]
    sets = [nd.shingles(" ".join(passage + [f"t{k}_{i}" for i in range(50)]), {}) for k in range(20)]
    everyone = np.ones(20, dtype=bool)
    (a, _), (b, _), width = nd.sides(np.unique(np.concatenate(sets), return_inverse=True)[1], np.array([len(x) for x in sets]), everyone, everyone, 0.8)
    assert len(a) == len(b) == width == 0


def test_recall_against_all_pairs_of_the_documents(spark):
    """Every pair of sf0.01's documents with an ordered similarity of 0.8 or more, found through an exact index of shingles."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text and r.text.split()]
    sets = {i: nd.shingles(t, {}) for i, t in rows}
    index, pairs = {}, set()
    for i, h in sets.items():
        shared = {}
        for x in h.tolist():
            for j in index.get(x, ()):
                shared[j] = shared.get(j, 0) + 1
            index.setdefault(x, []).append(i)
        pairs |= {(j, i) for j, n in shared.items() if n >= 0.8 * (len(h) + len(sets[j]) - n) and nd.similarity(sets[j], h) >= 0.8}
    of = {r.doc_id: r.class_id for r in nd.near_dup_classes(docs).collect()}
    assert len(pairs) > 50 and sum(of[a] == of[b] for a, b in pairs) >= 0.99 * len(pairs)
