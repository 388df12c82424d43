"""Secret scans: base spans by the stated rule, inferred automata on known formats, odd inputs."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm import secret_scan as ss

ANY_CASE = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    found = [("assign", m.start(), m.end()) for m in ANY_CASE.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_base_spans_follow_the_rule():
    r = random.Random(1)
    bits = ["password", "PassWd", "secret", "token", "Api_key", "apikey", "ſecret", ":", "=", " ", '"', "'", "abc123", "x", "AKIA", "ABCDEFGH12345678", "é", "0123456789abcdef", "deadbeef", "\n", "-", "."]
    for _ in range(4000):
        text = "".join(r.choices(bits, k=r.randint(0, 14)))
        assert [x[:3] for x in ss.base_spans(text)] == brute(text), text


def formats():
    r = random.Random(2)
    access = ["AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)) for _ in range(200)]
    hexes = ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(200)]
    return ss.Formats({"access": access, "hex": hexes}, Counter("the quick brown fox jumps over the lazy dog " * 50)), r


def test_inferred_formats_tell_credentials_from_words():
    f, r = formats()
    assert all(len(a.counts) < 400 for a in f.automata.values())
    new = ["AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)) for _ in range(50)] + ["".join(r.choices("0123456789abcdef", k=40)) for _ in range(50)]
    assert sum(map(f.is_secret, new)) >= 95
    plain = ["internationalization", "thereandbackagain2", "onandonandonandon1", "aaaaaaaaaaaaaaaaaaaaaaa", "4808875255130719"]
    assert not any(map(f.is_secret, plain))


def test_every_run_is_scored():
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    some = lambda n, of: "".join(r.choices(of, k=n))
    words = Counter("the quick brown fox jumps over the lazy dog " * 50)
    f = ss.Formats({"key": ["XK" + some(20, letters) for _ in range(200)], "live": ["sk_live_" + some(24, "0123456789abcdef") + some(8, letters) for _ in range(200)], "short": ["Q7" + some(5, "XYZ0123456789") for _ in range(200)]}, words)
    key, live, short = "XK" + some(20, letters), "sk_live_" + some(24, "0123456789abcdef") + "ZkQwPmTr", "Q7X0Y1Z"
    text = f"first {key} then {live} and {short}."
    found = {text[s:e]: k for k, s, e in ss.scan_text(text, f)[1]}
    assert found[key] == found[live] == found[short] == "format"  # letters alone, partly a hex span, seven characters
    assert not any(map(f.is_secret, ["internationalization", "thequickbrownfox", "jumps", "555-7713", "+1"]))


def test_runs_inside_a_base_span_are_not_spans_again():
    f, r = formats()
    for word in ("".join(r.choices("0123456789abcdef", k=40)), "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))):
        assert [k for k, _, _ in ss.scan_text(f"a {word} b", f)[1]] != ["format"] and len(ss.scan_text(f"a {word} b", f)[1]) == 1


def test_probabilities_of_a_state_sum_to_one():
    f, _ = formats()
    for a in f.automata.values():
        assert all(abs(sum(2.718281828459045**x for x in s.values()) - 1) < 1e-9 for s in a.logs)


def test_merging_finds_a_loop():
    a = ss.infer(["ab" * n for n in range(1, 9) for _ in range(2 ** (9 - n))])
    assert len(a.counts) <= 4 and a.score("ab" * 30) > a.score("ba" * 30)


def brute_infer(words, alpha=ss.ALPHA):
    """ALERGIA straight from its definition, on sets of words by state: a state is the multiset of the words' rests that reach it."""
    from math import log, sqrt

    def far(n1, f1, n2, f2):
        return abs(f1 / n1 - f2 / n2) > sqrt(0.5 * log(2 / alpha)) * (1 / sqrt(n1) + 1 / sqrt(n2))

    def heads(rests):
        return Counter(r[:1] for r in rests)

    def tails(rests, c):
        return [r[1:] for r in rests if r[:1] == c]

    def same(x, y):
        a, b = heads(x), heads(y)
        if any(far(len(x), a[c], len(y), b[c]) for c in a.keys() | b.keys()):
            return False
        return all(same(tails(x, c), tails(y, c)) for c in (a.keys() & b.keys()) - {""})

    return same


def test_merging_tests_are_those_of_the_definition():
    """On words of two letters: the first two states are merged exactly where the definition calls them compatible."""
    r = random.Random(6)
    seen = set()
    for _ in range(200):
        p, q = r.choice((0.1, 0.5, 0.9)), r.choice((0.05, 0.5, 0.95))
        words = ["".join("a" if r.random() < (q if i else p) else "b" for i in range(r.randint(0, 3))) for _ in range(r.choice((5, 80)))] + ["a", "b"]
        same = brute_infer(words)
        below = [w[1:] for w in words if w[:1] == "a"]
        merged = ss.infer(words).to[0].get("a") == 0
        assert merged == same(words, below)
        seen.add(merged)
    assert seen == {True, False}


def test_all_words_together_have_probability_one():
    r = random.Random(7)
    a = ss.infer(["".join(r.choices("ab", k=r.randint(0, 4))) for _ in range(300)])
    mass = {0: 1.0}
    done = 0.0
    for _ in range(400):  # the share of words that have ended after so many steps
        after: dict = {}
        for state, m in mass.items():
            total = sum(a.counts[state].values())
            for c, n in a.counts[state].items():
                if c == "":
                    done += m * n / total
                elif n:
                    after[a.to[state][c]] = after.get(a.to[state][c], 0) + m * n / total
        mass = after
    assert abs(done - 1) < 1e-6


def test_public_formats_are_found_and_words_are_not(spark):
    """Tokens that were not learned from, planted in clean text: every one is found, at its place, and nothing else."""
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    formats = ss.train(docs)
    r, rows, want = random.Random(8), [], {}
    clean = [x.text for x in docs.where(F.length("text") > 500).orderBy("doc_id").limit(150).collect() if not ss.base_spans(x.text)]
    for i, text in enumerate(clean):
        words = text.split(" ")
        at, token = r.randrange(1, len(words)), ss.examples(r.choice(sorted(ss.FORMATS)), 1, seed=1000 + i)[0]
        before = " ".join(words[:at])
        rows += [(i, f"{before} {token} {' '.join(words[at:])}"), (-1 - i, text)]
        want[i] = ("format", len(before) + 1, len(before) + 1 + len(token))
    got = {x.doc_id: [tuple(s) for s in x.spans] for x in ss.scan(spark.createDataFrame(rows, "doc_id long, text string"), formats).collect()}
    assert sum(want[i] in got[i] for i in want) >= 0.99 * len(want)
    assert sum(len(got[-1 - i]) for i in want) == 0


def test_words_side_by_side_are_scored_as_alone():
    f, r = formats()
    some = "abcxyzABCXYZ019+/_=-"
    words = ["".join(r.choices(some, k=r.randint(1, 90))) for _ in range(400)] + ["AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=r.choice((16, 70)))) for _ in range(60)] + ["a", "A", "Word", "WORD", "+", "7", "0123456789abcdef" * 2]
    got = f.secrets(words)
    assert got == set(filter(f.is_secret, words)) and got == {w for w in words if f.gain(w) >= ss.LEAST_GAIN} and 50 < len(got) < len(set(words))


def test_spans_by_plain_scores():
    """Every run of credential characters, its score by walking each automaton, against the verdicts of scan_text."""
    f, r = formats()
    words = ["AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=12)), "jumps", "AKIAXX", "0123456789abcdef", "Lazy", "over-the", "+1", "a"]
    for _ in range(300):
        text = " ".join(r.choices(words, k=6))
        base = [x[:3] for x in ss.base_spans(text)]
        want = list(base)
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
            if len(m[0]) >= f.least and f.gain(m[0]) >= ss.LEAST_GAIN and not any(s <= m.start() and m.end() <= e for _, s, e in base):
                want.append(("format", m.start(), m.end()))
        assert sorted(ss.scan_text(text, f)[1]) == sorted(want)


def test_odd_inputs(spark):
    rows = [(1, None), (1, ""), (None, "é token: abcdef " + "x" * 100000), (2, "secret: token = abcdefgh"), (3, "f" * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS base", "2 AS spans")
    got = {(r.doc_id, len(r.base)): [tuple(x) for x in r.spans] for r in ss.scan(docs, ss.train(docs)).collect()}
    assert got == {(1, 0): [], (None, 1): [("assign", 2, 15)], (2, 0): [], (3, 1): [("hex", 0, 24)]}
    assert ss.scan(docs.limit(0), ss.train(docs.limit(0))).collect() == []


def test_redaction():
    assert ss.redact("a token=abcdef b", [("assign", 2, 14), ("hex", 8, 14)]) == "a [secret] b"
