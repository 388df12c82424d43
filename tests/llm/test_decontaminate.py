"""Decontamination against brute force."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from quarry.llm import decontaminate as dc


def brute(docs, items, size):
    out = []
    wins = {}
    for item, text in items:
        for w in dc.windows(dc.words(text), size):
            wins.setdefault(w, set()).add("" if item is None else str(item))
    for i, text in docs:
        ws, hit, found = dc.words(text), set(), set()
        for n in {len(w) for w in wins}:
            for s in range(len(ws) - n + 1):
                if (got := wins.get(tuple(ws[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= got
        out.append((i, len(ws), len(hit), sorted(found)))
    return sorted(out, key=str)


def data(seed):
    r = random.Random(seed)
    word = lambda: r.choice("Aa b C, dé f- 9".split())
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(60)] + [(60, None), (61, ""), (None, "a b C dé f 9 a b"), (3, "b " * 4000)]
    items = [(i, " ".join(word() for _ in range(r.randint(0, 9)))) for i in range(25)] + [(None, "dé f b a"), (4, None), (7, "b b b b b")]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    for seed, size, at_once, block in ((1, 4, 20_000, 4 << 20), (2, 3, 5, 600)):
        monkeypatch.setattr(dc, "WINDOWS_AT_ONCE", at_once)
        monkeypatch.setattr(dc, "BLOCK_BYTES", block)
        docs, items = data(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        t = spark.createDataFrame(items, "item_id long, text string")
        got = dc.decontaminate(d, t, size).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute(docs, items, size)


def test_one_index_serves_any_test_set(spark, tmp_path):
    docs, items = data(5)
    index = dc.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), path=f"{tmp_path}/index")
    terms = {bytes(r.term) for r in index.where("term IS NOT NULL").collect()}
    assert terms == {w for _, t in docs for w in dc.words(t)}
    for part in (items[:9], items[9:]):
        got = dc.matches(index, spark.createDataFrame(part, "item_id long, text string"), 3).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == brute(docs, part, 3)


def test_a_window_that_is_everywhere(spark):
    docs = spark.createDataFrame([(i, "the same few words " * (i % 4) + f"x{i}") for i in range(300)], "doc_id long, text string").repartition(7)
    tests = spark.createDataFrame([(f"q{i}", "the same few words") for i in range(50)], "item_id string, text string")
    got = dc.decontaminate(docs, tests).collect()
    assert all((r.n_hit, len(r["items"])) == (4 * (r.doc_id % 4), 50 * (r.doc_id % 4 > 0)) for r in got) and len(got) == 300


def near(ws, terms, slop):
    """The shortest ranges with all terms, as often as they are asked for, by trying all."""
    from collections import Counter

    need, found = Counter(terms), []
    for s in range(len(ws)):
        for e in range(s + len(terms), min(len(ws), s + len(terms) + slop) + 1):
            if not need - Counter(ws[s:e]):
                found.append((s, e))
    return [x for x in found if not any(y != x and x[0] <= y[0] and y[1] <= x[1] for y in found)]


def test_proximity(spark):
    docs = [(1, "alpha x beta y gamma"), (2, "alpha x x x x beta x x gamma"), (3, "gamma beta alpha"), (4, "alpha alpha beta")]
    tests = spark.createDataFrame([("q", "alpha beta gamma")], "item_id string, text string")
    got = {r.doc_id: (r["items"], r.n_hit) for r in dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), tests, 10, slop=2).collect()}
    assert got == {1: (["q"], 5), 2: ([], 0), 3: (["q"], 3), 4: ([], 0)}
    r = random.Random(9)
    rows = [(i, " ".join(r.choices("abcde", k=r.randint(0, 25)))) for i in range(60)]
    item = "a b a c"
    got = dc.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("q", item)], "item_id string, text string"), slop=3).collect()
    text = dict(rows)
    for x in got:
        want = near(text[x.doc_id].split(), item.split(), 3)
        hit = {k for s, e in want for k in range(s, e)}
        assert x.n_hit == len(hit) and list(x["items"]) == (["q"] if want else []), (text[x.doc_id], x.spans, want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in dc.decontaminate(docs, none).collect()] == [(2, 0, [])]
    assert dc.decontaminate(docs.limit(0), none).collect() == []


def test_positions_are_packed_and_unpacked():
    r = np.random.default_rng(1)
    gaps = np.concatenate([r.integers(0, 1 << k, 50) for k in (1, 7, 8, 14, 15, 21, 28, 31)] + [[0, 127, 128, 16383, 16384, (1 << 28) - 1, 1 << 28]])
    data, ends = dc.packed(gaps)
    assert np.array_equal(dc.unpacked(data.tobytes()), gaps) and ends[-1] == len(data)
    for i in (0, 60, 200):
        assert dc.unpacked(data[ends[i] : ends[i + 1]].tobytes()).tolist() == [gaps[i + 1]]
    assert len(dc.packed(gaps[:0])[0]) == 0 == len(dc.unpacked(b""))


def test_a_window_in_every_document_and_slots_by_block(spark, monkeypatch):
    """One passage stands in all documents, so one term's lists are asked for in every block; blocks with few windows keep one slot."""
    monkeypatch.setattr(dc, "BLOCK_BYTES", 3000), monkeypatch.setattr(dc, "WINDOWS_AT_ONCE", 7)
    hot = " ".join(f"hot{i}" for i in range(12))
    rows = [(i, f"filler{i} " * 20 + hot + (" rare" + " ".join(f"r{j}" for j in range(30)) if i % 50 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame([(1, hot), (2, " ".join(f"r{j}" for j in range(1, 30))), (3, "nowhere at all")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in dc.decontaminate(docs, tests).collect()}
    want = {i: (41, ["1", "2"]) if i % 50 == 0 else (12, ["1"]) for i in range(200)}
    assert got == want
    monkeypatch.setattr(dc, "CHUNK_BYTES", 700)  # several chunks
    distinct, _ = dc.item_windows(tests, 10)
    assert 2 < len(dc.chunks(distinct)) < 10 and sum(c.count() for c in dc.chunks(distinct)) == distinct.count()
    assert {r.doc_id: (r.n_hit, list(r["items"])) for r in dc.decontaminate(docs, tests).collect()} == want


def test_a_block_is_numbered_without_an_object_for_each_word(spark):
    """Peak memory while a block's words are numbered: far less than the words as objects (40 bytes and more each)."""
    texts = [" ".join(f"w{(i * j) % 97}" for j in range(2000)) for i in range(100)] + [None, "", "Ä b, B"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    lengths, names, term = dc.numbered(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    plain = [dc.words(t) for t in texts]
    assert lengths == list(map(len, plain)) and names == sorted(set().union(*plain))
    assert [names[k] for k in term] == [w for ws in plain for w in ws]
    assert peak < 16 * len(term)
