"""Byte-level BPE against the library whose vocabulary it reads."""

import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
TRICKY = ["", " ", "  a", "a  b\n\n c", "it's we've they'll I'd 'sx 'S ''s", "x 'll", "１２ ³ ½a", "　  x", "àb", "😀😀 'm", "\n \n", "tab\t\tz ", "<|endoftext|>", "don't 's", "9" * 999, "ab" * 3000, "!?" * 2500, " " * 5000 + "x"]


def ids_of(texts):
    data = [t.encode() for t in texts]
    offsets = [0]
    for d in data:
        offsets.append(offsets[-1] + len(d))
    import numpy as np

    return bpe.codec(PATH).encode(np.array(offsets), b"".join(data))


def test_tricky_texts():
    assert ids_of(TRICKY) == [THEIRS.encode_ordinary(t) for t in TRICKY]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=60), max_size=6))
def test_any_text(texts):
    assert ids_of(texts) == [THEIRS.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab's tvelrdm\n\t 1! é", max_size=80), max_size=6))
def test_dense_boundaries(texts):
    assert ids_of(texts) == [THEIRS.encode_ordinary(t) for t in texts]


def test_offsets_decode_slices():
    text = "Zwölf Boxkämpfer jagen Viktor — 12 times."
    (ids,) = ids_of([text])
    codec = bpe.codec(PATH)
    at = codec.offsets(ids)
    raw = text.encode()
    for i in range(len(ids)):
        for j in range(i, len(ids)):
            end = at[j] if j < len(ids) else len(raw)
            assert codec.decode(ids[i:j]) == raw[at[i] : end]


def test_rows(spark):
    rng = random.Random(3)
    texts = [None, "", *TRICKY, *("".join(rng.choice("ab c\n'sé1") for _ in range(200)) for _ in range(20))]
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)] + [(5, "twice", "x", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")
    got = bpe.encode_decode(docs, PATH, outputs=("ids", "decoded", "digests")).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), tuple(THEIRS.encode_ordinary(t or "")), t or "") for i, t, *_ in rows)
    assert sorted((str(r.doc_id), tuple(r.ids), r.decoded) for r in got) == want
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.encode_decode(docs.where(F.lit(False)), PATH).count() == 0


def test_a_worker_keeps_no_merges_after_its_task(spark):
    """Workers are reused: what a task has merged must not stay in memory for later tasks."""
    import pyarrow as pa

    docs = spark.createDataFrame([(i, f"zqxv{i}kw qjzx{i * 7919}") for i in range(400)], "doc_id long, text string").repartition(8)
    assert bpe.encode_decode(docs, PATH).count() == 400
    docs_ids = bpe.encode_decode(docs, PATH, outputs=("ids", "digests"))
    assert docs_ids.agg(F.sum(F.size("ids"))).first()[0] > 800

    def kept(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.codec(PATH).merges)], pa.int64())], ["n"])

    held = [r.n for r in spark.range(64).repartition(8).mapInArrow(kept, "n long").collect()]
    assert held and max(held) == 0
