"""Generated data, fingerprints and built episodes over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dialogs as D
from ..operators import episodes as E
from ..operators import fingerprints as K
from ..operators import generators as G
from ..operators import sampling
from ..session import written
from .common import Registry, table
from .models import rounded

R = Registry()

#: Philox in SQL: a round a step, 128-bit products. {keys}: a query of (id, stream); seed 42.
_PHILOX = """WITH RECURSIVE keys AS ({keys}),
r AS (SELECT id, stream, 0 AS i, (id & 4294967295)::HUGEINT AS a, (id >> 32)::HUGEINT AS b, stream::HUGEINT AS c, 0::HUGEINT AS d, 42::HUGEINT AS k, 0::HUGEINT AS l FROM keys
UNION ALL SELECT id, stream, i + 1, xor(xor((c * 3449720151) >> 32, b), k), (c * 3449720151) & 4294967295, xor(xor((a * 3528531795) >> 32, d), l), (a * 3528531795) & 4294967295, (k + 2654435769) & 4294967295, (l + 3144134277) & 4294967295 FROM r WHERE i < 10),
u AS (SELECT id, stream, (a::DOUBLE + 0.5) / 4294967296 AS a, (b::DOUBLE + 0.5) / 4294967296 AS b, (c::DOUBLE + 0.5) / 4294967296 AS c, (d::DOUBLE + 0.5) / 4294967296 AS d, a AS word FROM r WHERE i = 10),
z AS (SELECT id, stream, sqrt(-2 * ln(a)) * cos(2 * pi() * b) AS z0, sqrt(-2 * ln(a)) * sin(2 * pi() * b) AS z1, sqrt(-2 * ln(c)) * cos(2 * pi() * d) AS z2, sqrt(-2 * ln(c)) * sin(2 * pi() * d) AS z3 FROM u) """
_FOUR = "round(f.z0, 6) AS feature_0, round(f.z1, 6) AS feature_1, round(f.z2, 6) AS feature_2, round(f.z3, 6) AS feature_3"
_TWO_STREAMS = "SELECT c_custkey AS id, s AS stream FROM customer, range(2) AS g(s)"


@R.add(_PHILOX.format(keys=_TWO_STREAMS) + f"SELECT f.id AS c_custkey, {_FOUR}, (v.z1 > v.z0)::INT AS label FROM z f JOIN z v USING (id) WHERE f.stream = 0 AND v.stream = 1")
def generated_classification(spark, d):
    return rounded(G.classification(table(spark, d, "customer").select("c_custkey"), "c_custkey"), 6)


@R.add(_PHILOX.format(keys=_TWO_STREAMS) + f"SELECT f.id AS c_custkey, {_FOUR}, (0.1 * v.z0 + 0.4 * f.z0 - 0.2 * f.z1 + 0.1 * f.z2 + 0.5 * f.z3 > avg(0.1 * v.z0 + 0.4 * f.z0 - 0.2 * f.z1 + 0.1 * f.z2 + 0.5 * f.z3) OVER ())::INT AS label FROM z f JOIN z v USING (id) WHERE f.stream = 0 AND v.stream = 1")
def generated_linear(spark, d):
    return rounded(G.linear(table(spark, d, "customer").select("c_custkey"), "c_custkey"), 6)


_BASE = tuple({"prompt_text": f"prompt {i}", "domain": x} for i, x in enumerate(("chemistry", "physics", "biology")))


@R.add(_PHILOX.format(keys="SELECT p_partkey AS id, 0 AS stream FROM part") + "SELECT id AS p_partkey, 'sample_' || lpad(id::VARCHAR, 6, '0') AS sample_id, 'prompt ' || (word % 3) AS prompt_text, ['chemistry', 'physics', 'biology'][(word % 3)::INT + 1] AS domain, 'prompt ' || (id % 3) AS in_turn FROM u")
def generated_corpus(spark, d):
    keys = table(spark, d, "part").select("p_partkey")
    turn = G.corpus(keys, "p_partkey", _BASE).select("p_partkey", F.col("prompt_text").alias("in_turn"))
    return G.corpus(keys, "p_partkey", _BASE, seed=42).join(turn, "p_partkey")


#: The fingerprint of {rows} by source, over the same row hashes.
_PRINT = """SELECT source, count(*) AS n, (sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT) % 2305843009213693951)::BIGINT AS a, (sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT) % 4611686018427387847)::BIGINT AS b FROM (
  SELECT source, md5(concat_ws(chr(31), coalesce(doc_id::VARCHAR, chr(0)), coalesce(lang, chr(0)), coalesce(n_chars::VARCHAR, chr(0)), coalesce(source, chr(0)), coalesce(text, chr(0)))) AS h FROM ({rows})) GROUP BY source"""
_EDITED = "SELECT doc_id, CASE WHEN source = 'src1' AND doc_id = (SELECT max(doc_id) FROM documents WHERE source = 'src1') THEN text || '!' ELSE text END AS text, lang, source, n_chars FROM documents"


@R.add(_PRINT.format(rows="SELECT * FROM documents"))
def dataset_fingerprint(spark, d):
    return K.fingerprint(table(spark, d, "documents"), ("source",))


@R.add(f"WITH x AS ({_PRINT.format(rows='SELECT * FROM documents')}), y AS ({_PRINT.format(rows=_EDITED)}) SELECT source, coalesce(x.n, 0) AS n_first, coalesce(y.n, 0) AS n_second, coalesce(x.a = y.a AND x.b = y.b AND x.n = y.n, false) AS same FROM x FULL JOIN y USING (source)")
def fingerprint_comparison(spark, d):
    """The documents against themselves with one text of one source changed; the fingerprint of the edit follows from the old one."""
    docs = table(spark, d, "documents")
    last = docs.where("source = 'src1'").agg(F.max("doc_id").alias("last"))
    gone = docs.join(F.broadcast(last), F.col("doc_id") == F.col("last")).where("source = 'src1'").drop("last")  # one row
    old = K.fingerprint(docs, ("source",))
    new = K.combined((old, 1), (K.fingerprint(gone, ("source",)), -1), (K.fingerprint(gone.withColumn("text", F.concat("text", F.lit("!"))), ("source",)), 1), by=("source",))
    return K.compared(old, new, ("source",))


@R.add("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) AS p, count(*) OVER () AS n FROM documents),
s AS (SELECT CASE WHEN p <= floor(n * 0.8 + 0.5) THEN 'train' ELSE 'test' END AS split FROM p) SELECT split, count(*) AS n_first, count(*) AS n_second, true AS same FROM s GROUP BY 1""")
def run_twice_comparison(spark, d):
    """A split of the documents, run twice at different partitions: every part has the same rows."""
    tasks = iter((3, 16))

    def job():
        docs = table(spark, d, "documents").select("doc_id", "source").repartition(next(tasks))
        return sampling.split(docs, ("doc_id",), {"train": 0.8, "test": 0.2})

    return K.run_twice(job, ("split",))


_CATEGORY = "['units', 'literature', 'simulation', 'hybrid'][p_partkey % 4 + 1]"
_MS = "(20 + ('0x' || substr(md5('{kind}:' || p_partkey || ':{step}'), 1, 4))::BIGINT % 120)"
_EPISODE_MS = " ".join(f"WHEN '{c}' THEN ({' + '.join(_MS.format(kind='episode', step=s) for s in steps)}) / {len(steps)}.0" for c, steps in (("units", ("units",)), ("literature", ("search", "fetch")), ("simulation", ("python",))))
_HYBRID = " + ".join(_MS.format(kind="episode", step=s) for s in ("search", "fetch", "python"))


@R.add(f"""WITH p AS (SELECT p_partkey, {_CATEGORY} AS category, ('0x' || substr(md5('Convert ' || p_size || ' m to cm for ' || p_name || ' at ' || p_size || 'C'), 1, 2))::INT % 5 = 0 AS think FROM part),
t AS (SELECT *, category = 'hybrid' AND think AS thinks, CASE category WHEN 'units' THEN 1 WHEN 'literature' THEN 2 WHEN 'simulation' THEN 1 ELSE 3 END AS n FROM p)
SELECT p_partkey, category, (2 + 2 * (n + thinks::INT))::INT AS messages, (n + thinks::INT)::BIGINT AS tool_calls, n::BIGINT AS valid_calls, (n + thinks::INT)::BIGINT AS tool_results, (n + thinks::INT)::BIGINT AS good_results,
round(CASE category {_EPISODE_MS} ELSE ({_HYBRID} + CASE WHEN thinks THEN {_MS.format(kind='episode', step='think')} ELSE 0 END) / (3.0 + thinks::INT) END, 6) AS mean_ms, true AS final_valid, true AS citation_valid FROM t""")
def episode_scores(spark, d):
    """Episodes of all categories for every part, graded by the operator that grades dialogues."""
    return _graded(E.built(_spread(_prompts(spark, d)), "p_partkey", "prompt", "category"), "category")


def _prompts(spark, d):
    size = F.col("p_size").cast("string")
    prompt = F.concat(F.lit("Convert "), size, F.lit(" m to cm for "), "p_name", F.lit(" at "), size, F.lit("C"))
    return table(spark, d, "part").select("p_partkey", prompt.alias("prompt"), F.element_at(F.array(*map(F.lit, E.CATEGORIES)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("category"))


def _spread(rows):
    """Few bytes a row that become a long text: more tasks than the file's size alone would give."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def _graded(built, name):
    """The episodes' scores. Episodes are written once, for grading reads them several times."""
    built = written(built, "episodes")
    turns = built.select("p_partkey", F.posexplode("messages").alias("turn", "m")).select("p_partkey", "turn", "m.role", F.col("m.content").alias("text"))
    scores = D.tool_scores(turns, "p_partkey")
    out = built.select("p_partkey", name, F.size("messages").alias("messages")).join(scores, "p_partkey")
    return rounded(out, 6)


@R.add(f"""SELECT p_partkey, ['malformed_json', 'missing_fetch', 'python_error'][p_partkey % 3 + 1] AS repair, CASE p_partkey % 3 WHEN 1 THEN 8 ELSE 6 END AS messages, 2::BIGINT AS tool_calls, CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS valid_calls,
CASE p_partkey % 3 WHEN 1 THEN 3 ELSE 2 END::BIGINT AS tool_results, CASE p_partkey % 3 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS good_results,
round(CASE p_partkey % 3 WHEN 0 THEN 28.5::DOUBLE WHEN 1 THEN 98 / 3.0::DOUBLE ELSE (18 + {_MS.format(kind='repair', step='fixed')}) / 2.0 END, 6) AS mean_ms, true AS final_valid, true AS citation_valid FROM part""")
def repair_scores(spark, d):
    """The three repair scenarios in turn, for every part."""
    return _graded(E.repairs(_spread(table(spark, d, "part").select("p_partkey")), "p_partkey"), "repair")
