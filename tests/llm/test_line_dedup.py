"""Line dedup against brute force over all runs."""

import random

import numpy as np

from quarry.llm import line_dedup


def brute(rows, least):
    """Deletes every line in a run of least words that occurs at an earlier place. rows: (id, text) in order."""
    places = []
    for d, (_, text) in enumerate(rows):
        at = [(i, x.strip(), len(x.split())) for i, x in enumerate((text or "").split("\n")) if x.split()]
        places.append(at)
    seen, gone = {}, [set() for _ in rows]
    for d, at in enumerate(places):
        for s in range(len(at)):
            total = 0
            for e in range(s, len(at)):
                total += at[e][2]
                if total >= least:
                    key = tuple(x[1] for x in at[s : e + 1])
                    d0, s0 = seen.setdefault(key, (d, s))
                    if (d0, s0) != (d, s):  # the lines of the first occurrence stay where the two overlap
                        begin = max(s, s0 + e + 1 - s) if d0 == d else s
                        gone[d].update(x[0] for x in at[begin : e + 1])
    out = []
    for d, (i, text) in enumerate(rows):
        if not gone[d]:
            out.append((i, text, len(places[d]), 0))
        elif len(gone[d]) == len(places[d]):
            out.append((i, "", len(places[d]), len(gone[d])))
        else:
            out.append((i, "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[d]), len(places[d]), len(gone[d])))
    return out


def corpus(seed, docs=120):
    r = random.Random(seed)
    pool = [" ".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(14)]
    rows = [(i, "\n".join(r.choice([*pool, " ".join(r.choices("stuvwxyz", k=6)), "", "  "]) for _ in range(r.randint(0, 12)))) for i in range(docs)]
    rows[5] = (5, None)
    rows[7] = (7, rows[3][1])
    rows[11] = (11, "one two\n" * 30)
    rows[12] = (12, "long " * 5000 + "\n" + "long " * 5000)
    return rows


def test_the_first_run_stays_in_a_text_that_repeats_itself(spark):
    rows = [(1, "one two\n" * 30), (2, "one two\n" * 24 + "x"), (3, "a b c d e\n" * 12 + "end of it")]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == "one two\n" * 25 and (got[1].n_lines, got[1].n_removed) == (30, 5)
    assert got[2].n_removed == 0  # 48 words
    assert got[3].text == "a b c d e\n" * 10 + "end of it" and got[3].n_removed == 2


def test_matches_brute_force(spark):
    for seed, least, gram in ((1, 12, 6), (2, 20, 5), (3, 9, 9)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = line_dedup.dedup(df, least, gram).select("doc_id", "text", "n_lines", "n_removed").collect()
        assert sorted(map(tuple, got)) == brute(rows, least)


def test_windows_and_contexts_by_search_are_those_by_definition():
    r = random.Random(6)
    for _ in range(300):
        counts = np.array([r.randint(1, 9) for _ in range(r.randint(1, 25))])
        least, gram = r.randint(5, 40), r.randint(1, 20)
        n, total = len(counts), lambda s, e: int(counts[s:e].sum())
        every = {(s, e) for s in range(n) for e in range(s + 1, n + 1) if total(s, e) >= least and (total(s, e - 1) < least or total(s + 1, e) < least)}
        every = {(s, e) for s, e in every if total(s, e - 1) < least or total(s + 1, e) < least}
        marks = [i for i in range(n) if total(i, n) >= gram]
        for at, context in zip(marks, line_dedup.contexts_of(counts, marks, least, gram)):
            end = next(e for e in range(at + 1, n + 1) if total(at, e) >= gram)
            want = {(s, e) for s, e in every if s <= at and e >= end}
            assert set(line_dedup.windows_with(counts, at, end, least)) == want
            assert context == (min([at, *(s for s, _ in want)]), max([end, *(e for _, e in want)]))


def test_matches_extend_line_by_line_from_the_pair():
    own, first = b"".join(bytes([x]) * 16 for x in b"abcdefg"), b"".join(bytes([x]) * 16 for x in b"xbcdefy")
    assert line_dedup.extended(own, 3, first, 3) == (2, 3) and line_dedup.extended(own, 0, first, 0) == (0, 0)
    assert line_dedup.extended(own, 2, first[32:], 0) == (0, 4)


def test_what_the_first_place_does_not_tell(spark):
    """One passage in all documents; the lines around it are the same in pairs of documents that the first one is not in. A run of very many
    lines is found whole, by pairs with one first place."""
    core = "\n".join(f"core line {i} of the passage that all documents have" for i in range(4))
    rows = [(0, core)]
    for i in range(1, 13):
        edge = f"left {i // 2} one two three four five six\n" * 3
        rows.append((i, f"own {i}\n{edge}{core}\nright {i // 3} and some more words here\nend {i}"))
    long = "\n".join(f"line {i} with some few words" for i in range(10_000))
    rows += [(100, long), (101, "before\n" + long + "\nafter")]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(map(tuple, got))[:13] == brute(rows[:13], 50)
    assert {r.doc_id: r.n_removed for r in got if r.doc_id >= 100} == {100: 0, 101: 10_000}


def test_work_is_linear_in_the_lines(spark):
    """Each line of a repeated run is in a bounded number of contexts and hashed windows, however long the run is."""
    for n in (300, 3000):
        text = "\n".join(f"line {i} with some few words" for i in range(n))
        _, digests, counts = line_dedup.lines_of(text)
        marks = list(line_dedup.fingerprints(digests, counts, 50, 25))
        contexts = line_dedup.contexts_of(counts, marks, 50, 25)
        assert sum(b - a for a, b in contexts) < 12 * n


def test_ties_nulls_and_clashing_names(spark):
    text = "alpha " * 60
    rows = [(1, text, "x", 1), (1, text, "x", 2), (None, text, None, 3), (2, None, "y", 4), (2, "", "y", 5), (3, "short", "z", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, n_removed int")
    got = line_dedup.dedup(df).orderBy("doc_id").collect()
    assert len(got) == 6 and got[0].asDict().keys() == {"doc_id", "text", "gone", "n_removed", "n_lines", "n_removed_"}
    assert sorted(r.n_removed for r in got) == [1, 2, 3, 4, 5, 6] and dict(line_dedup.dedup(df).dtypes)["n_removed"] == "int"
    by = sorted((r.doc_id or 9, r.text if r.text is not None else "~", r.n_removed_) for r in got)
    assert by == [(1, "", 1), (1, text, 0), (2, "", 0), (2, "~", 0), (3, "short", 0), (9, "", 1)]
    cased = line_dedup.dedup(df.withColumnRenamed("n_removed", "N_LINES")).collect()
    assert set(cased[0].asDict()) == {"doc_id", "text", "gone", "N_LINES", "n_lines_", "n_removed"} and sorted(r.N_LINES for r in cased) == [1, 2, 3, 4, 5, 6]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup(empty).collect() == []
