"""Longest-match token counts against plain greedy matching."""

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import wordpiece
from quarry.llm.bpe import load_ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def greedy(word: bytes, pieces) -> int:
    longest, at, n = max(map(len, pieces)), 0, 0
    while at < len(word):
        size = next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces)
        at, n = at + size, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=2, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12), st.lists(st.text("abc", max_size=30).map(str.encode), min_size=1, max_size=8))
def test_small_vocabularies(pieces, words):
    pieces = pieces | {bytes([b]) for b in range(256)}
    machine = wordpiece.Automaton(sorted(pieces))
    assert machine.count(words).tolist() == [greedy(w, pieces) for w in words]


def test_rows(spark):
    ranks = set(load_ranks(PATH))
    texts = [None, "", " \n\t", "internationalisation of thoughts", "x" * 5000, "Straße 😀😀 ünïcödé", "a b " * 300, "same", "same"]
    docs = spark.createDataFrame([(i if i else None, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {(r.doc_id, r.n_words, r.n_tokens) for r in wordpiece.token_counts(docs, PATH).collect()}
    want = set()
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        want.add((i or None, len(words), sum(greedy(b" " + w, ranks) for w in words)))
    assert got == want
    assert wordpiece.token_counts(docs.limit(0), PATH).count() == 0
