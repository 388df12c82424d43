"""The corpus pipeline: every stage against a plain version of its decision, edge cases, and the registered queries' contracts."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quarry.llm import bpe, common, queries

from .. import oracle
from .test_langid import FOREIGN

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each."""
    docs, out = common.table(spark, SMALL, "documents"), []
    out.append(docs.toPandas())
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, SMALL), name)
        out.append(docs.toPandas())
    return out


def test_columns_and_ids(stages):
    for before, after in zip(stages, stages[1:]):
        assert set(after.doc_id) <= set(before.doc_id)
        assert len(after) == after.doc_id.nunique()
    assert all(list(x.columns) == COLUMNS for x in stages[:-1])


def test_language_stage_keeps_texts_with_letters(stages):
    before, after = stages[0], stages[1]
    gone = before[~before.doc_id.isin(after.doc_id)]
    assert len(gone) < 0.02 * len(before)
    assert not any(any(c.isalpha() for c in t or "") and len((t or "").split()) > 50 for t in gone.text)


def test_language_stage_fills_no_language_of_a_foreign_text(spark):
    docs = common.table(spark, SMALL, "documents")
    foreign = [(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(FOREIGN)]
    got = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(foreign, docs.schema)), SMALL)
    assert got.where("doc_id >= 1000000000").count() == 0
    assert got.where("lang IS NULL").count() == 0


def test_near_duplicate_stage_keeps_one_of_each_class(spark, stages):
    before, after = stages[2], stages[3]
    shingles = {}
    for d, t in zip(before.doc_id, before.text):
        w = t.split()
        shingles[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    kept = sorted(after.doc_id)
    for i, a in enumerate(kept):
        for b in kept[i + 1 :]:
            x, y = shingles[a], shingles[b]
            if x and y and min(len(x), len(y)) >= 0.9 * max(len(x), len(y)):
                assert len(x & y) < 0.9 * len(x | y), (a, b)
    assert before[~before.doc_id.isin(after.doc_id)].text.map(lambda t: bool(t.split())).all()


def test_decontamination_stage(spark, stages):
    before, after = stages[3], stages[4]
    docs = spark.createDataFrame(before.astype(object).where(before.notna(), None), common.table(spark, SMALL, "documents").schema)
    folder = common.checkpoint_root(spark)
    path = f"{folder}/t/{hashlib.md5(str(len(before)).encode()).hexdigest()}/documents.parquet"
    docs.write.mode("overwrite").parquet(path)
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path.removeprefix('file://')}/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SMALL}/benchmark.parquet'")
    clean = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.OP2_SQL}) WHERE NOT contaminated").fetchall()}
    assert set(after.doc_id) == clean


def test_token_stage(stages):
    before, after = stages[4], stages[5]
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries.BYTE_RANKS), special_tokens={})
    texts = dict(zip(before.doc_id, before.text))
    assert set(after.doc_id) == set(texts)
    for r in after.itertuples():
        assert list(r.ids) == theirs.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_documents_pass_every_stage(spark):
    rows = [(None, None, None, None, None), (None, "", None, "s", 0), (1, "word " * 5000, "en", None, 3), (1, "word " * 5000, "en", None, 3), (2, "\n \n", "x", "s", 3), (3, "a b c", None, None, None), (4, "0 1 2", "en", "s", 5)]
    schema = common.table(spark, SMALL, "documents").schema
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialise(stage(spark, docs, SMALL), name)
        assert docs.count() <= len(rows)


def test_op2_matches_its_sql(spark):
    oracle.check(queries.op2_decontaminate(spark, SMALL), queries.OP2_SQL, SMALL)


@pytest.mark.parametrize("name", ["op1_crf_quality", "op4_lstm_main_text", "op5_byte_bpe", "op6_token_counts", "op9_hash_tree_shards", "op10_grammar_secrets", "op12_importance_resampling"])
def test_queries_give_a_row_for_each_input_row(spark, name):
    source, key = ("pages", "page_id") if name.startswith("op4") else ("documents", "doc_id")
    got = queries.QUERIES[name](spark, SMALL)
    want = common.table(spark, SMALL, source)
    assert got.select(key).exceptAll(want.select(key)).count() == 0 and got.count() == want.count()


def test_registered():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert [n.split("_")[0] for n in queries.QUERIES if n != "pipeline"] == [f"op{i}" for i in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5


def test_clashing_extra_columns(spark):
    docs = common.table(spark, SMALL, "documents").limit(20).withColumns({c: F.lit("x") for c in ("n_lines", "node", "id", "n_hit", "key", "__at")})
    for stage in corpus_pipeline.STAGES[:4]:
        assert stage[1](spark, docs, SMALL).columns == docs.columns
