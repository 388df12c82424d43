"""Importance resampling towards a target distribution, over hashed word n-grams.

Features of a text are all runs of one to `longest` consecutive words, repeats counted; a feature falls into one of `buckets` by the crc32 of its
bytes, words joined by a space. The target texts give each bucket a count t of T in all, the corpus s of S. A bucket's gain is the logarithm of
the ratio of its smoothed shares, in thousandths and rounded down; a document's weight is the sum of the gains of its features. Adding Gumbel noise
of a hash of the id makes the highest scores a draw without replacement in proportion to the weights.

1. Count: texts are read once. A task gives words integer ids by a dictionary. A run of words is the tuple of their ids, packed into one number,
   so the runs of a slice of text are an integer array. Its distinct tuples are found by sorting, the bytes of each are put together from
   the dictionary and hashed once, and the bucket joins back to every occurrence. What is stored of a document are its distinct buckets with
   their counts, and of a task the sum of all its documents' counts.
2. Gains: the tasks' sums are added by bucket, a row each.
3. Weigh: the stored buckets of each document meet the gains, a table of `buckets` numbers.
4. Draw: rows are dealt by ranges of (eligible, score, id), sorted and numbered inside each range; the ranges' counts give the first number of
   each. Ranges can cut through equal scores, and no task sees all rows.

A dictionary starts anew when it holds `MOST_WORDS` words, so that a packed tuple fits in 63 bits; a distinct tuple is hashed once in each piece
of `PIECE_WORDS` words that holds it, of one text or of many. Results don't depend on either.

Cases: a null text has no words, and neither has one of separators alone; such documents weigh 0 and are not drawn. A null id takes part in the
noise as the empty text and comes last among equal scores. Rows with the same id or equal rows are drawn each for itself. An empty target or
corpus smooths all shares alike. Other columns of either table do not matter.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import words

LONGEST, BUCKETS = 3, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bits of a word id in a tuple, the words whose tuples are sorted together, and the bytes of text that a task reads at a time.
WORD_BITS = 21
MOST_WORDS = (1 << WORD_BITS) - 1
PIECE_WORDS, SLICE_TEXT = 1 << 18, 4 << 20


class Words:
    """The dictionary: words to ids from 1, and back."""

    def __init__(self):
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = [b""]

    def of(self, text: list[bytes]) -> np.ndarray:
        try:
            return np.fromiter(map(self.ids.__getitem__, text), dtype=np.int64, count=len(text))
        except KeyError:
            for w in set(text).difference(self.ids):
                self.ids[w] = len(self.words)
                self.words.append(w)
            return np.fromiter(map(self.ids.__getitem__, text), dtype=np.int64, count=len(text))

    def buckets(self, tuples: np.ndarray, buckets: int) -> np.ndarray:
        """The bucket of each tuple: its words' bytes, joined by spaces, hashed."""
        known, mask = self.words, (1 << WORD_BITS) - 1
        first, second, third = ((tuples >> (WORD_BITS * i) & mask).tolist() for i in range(3))
        joined = (b" ".join([known[a], known[b], known[c]]) if c else b" ".join([known[a], known[b]]) if b else known[a] for a, b, c in zip(first, second, third))
        return np.fromiter(map(zlib.crc32, joined), dtype=np.int64, count=len(tuples)) % buckets


def tuples(ids: np.ndarray, row: np.ndarray, longest: int, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed tuples, row of each) of all runs of up to `longest` ids of one row that begin in the first `starts` places."""
    packed, out, rows = ids, [ids[:starts]], [row[:starts]]
    for n in range(1, longest):
        if len(ids) <= n:
            break
        packed = packed[: len(ids) - n] | ids[n:] << (WORD_BITS * n)
        inside = np.flatnonzero(row[: len(ids) - n] == row[n:])
        inside = inside[inside < starts]
        out.append(packed[inside]), rows.append(row[inside])
    return np.concatenate(out), np.concatenate(rows)


def counted(texts: list[list[bytes]], known: Words, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of words: (features of each row; where its distinct buckets end; those buckets, rising; their counts). Words are taken in pieces
    of bounded size, each with the words that its last runs go on to."""
    flat = [w for t in texts for w in t]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    step, cells, times, per_row = min(PIECE_WORDS, MOST_WORDS - longest), [], [], np.zeros(len(texts), dtype=np.int64)
    for at in range(0, len(flat), step):
        piece = flat[at : at + step + longest - 1]
        if len(known.words) + len(piece) > MOST_WORDS and len(known.words) + len(set(piece)) > MOST_WORDS:
            known.__init__()
        found, of = tuples(known.of(piece), row[at : at + len(piece)], longest, step)
        distinct, where = np.unique(found, return_inverse=True)
        cell, n = np.unique(of * buckets + known.buckets(distinct, buckets)[where], return_counts=True)
        cells.append(cell), times.append(n)
        per_row += np.bincount(of, minlength=len(texts))
    if len(cells) > 1:
        cell, where = np.unique(np.concatenate(cells), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate(times)).astype(np.int64)
    elif not cells:
        cell = n = np.zeros(0, dtype=np.int64)
    return per_row, np.searchsorted(cell, (np.arange(len(texts)) + 1) * buckets), cell % buckets, n


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Stored: a row per document (id, n_words, n_features, the distinct buckets as rising uint16 differences, their counts as uint32), and rows of
    sums, int64 by bucket, of all documents that a task has read."""
    if longest > 3 or buckets > 1 << 16:
        raise ValueError("tuples hold three words and buckets sixteen bits at most")
    common.text_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    names = ["id", "n_words", "n_features", "buckets", "times", "sums"]

    def cut(values: np.ndarray, ends: np.ndarray, width: int) -> pa.Array:
        offsets = np.concatenate([[0], ends * width]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())

    def run(batches):
        known, sums, id_type = Words(), np.zeros(buckets, dtype=np.int64), None
        for batch in common.slices(batches, budget=SLICE_TEXT):
            id_type, n = batch.column(0).type, batch.num_rows
            texts = [words(t) for t in common.texts(batch)]
            per_row, ends, cells, times = counted(texts, known, longest, buckets)
            np.add.at(sums, cells, times)
            starts = np.concatenate([[0], ends[:-1]])
            gaps = np.diff(cells, prepend=0)
            filled = starts[starts < ends]
            gaps[filled] = cells[filled]
            n_words = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_words, pa.array(per_row, pa.int64()), cut(gaps.astype(np.uint16), ends, 2), cut(times.astype(np.uint32), ends, 4), pa.nulls(n, pa.binary())], names)
        if sums.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), *(pa.nulls(1, pa.int64()) for _ in "ab"), *(pa.nulls(1, pa.binary()) for _ in "ab"), pa.array([sums.tobytes()], pa.binary())], names)

    return common.materialise(source.mapInArrow(run, f"id {kind}, n_words long, n_features long, buckets binary, times binary, sums binary"), "features")


def totals(found: DataFrame) -> DataFrame:
    """(bucket, n): the corpus's features by bucket."""

    def run(batches):
        for batch in batches:
            for s in batch.column(0).to_pylist():
                n = np.frombuffer(s, dtype=np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], ["bucket", "n"])

    return found.where("sums IS NOT NULL").select("sums").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket. corpus, target: totals()."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for side, of in ((s, corpus), (t, target)):
        for r in of.collect():  # a row per bucket
            side[r.bucket] = r.n
    all_s, all_t = s.sum() + buckets, t.sum() + buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], dtype=np.int64)


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of each document."""
    shared = found.sparkSession.sparkContext.broadcast(gain)
    kind = found.schema["id"].dataType.simpleString()

    def run(batches):
        g = shared.value
        for batch in batches:
            ids, n_words, n_features, cells, times = (batch.column(i) for i in range(5))
            weight = [int((g[np.cumsum(np.frombuffer(c, dtype=np.uint16), dtype=np.int64)] * np.frombuffer(n, dtype=np.uint32).astype(np.int64)).sum()) for c, n in zip(cells.to_pylist(), times.to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, n_words, n_features, pa.array(weight, pa.int64())], ["id", "n_words", "n_features", "weight"])

    rows = found.where("sums IS NULL").select("id", "n_words", "n_features", "buckets", "times")
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the first 32 bits of a hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """scored (stored: id, score and others) with rank, from 1: percent of the eligible rows, rounded down, have one."""
    drawn = scored.where(eligible).count() * percent // 100
    order = [F.col("__in").desc(), F.col("score").desc(), F.col("id").asc_nulls_last()]
    rows = scored.withColumn("__in", F.coalesce(eligible, F.lit(False))).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = common.materialise(rows.withColumn("__at", F.monotonically_increasing_id()), "ranges")  # range << 33 | place in it
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part).count().collect())  # a row per range
    upto, firsts = 0, []
    for p, n in counts:
        firsts.append((p, upto))
        upto += n
    starts = rows.sparkSession.createDataFrame(firsts, "__part long, __before long")
    out = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")
    nth = F.col("__before") + place + 1
    return out.withColumn("rank", F.when(F.col("__in") & (nth <= drawn), nth)).drop("__in", "__at", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text") -> DataFrame:
    """Per document: its id, n_features, weight, score and rank (null where it is not drawn). Drawn are percent of those with least_words words
    or more, highest scores first."""
    since = common.mark()
    found = features(docs, longest, buckets, id_column, text_column)
    wanted = features(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), longest, buckets, "id", "text")
    gain = gains(totals(found), totals(wanted), buckets)
    scored = weighed(found, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = common.materialise(scored, "scored")
    common.release(since, scored)
    out = ranked(scored, F.col("n_words") >= least_words, percent)
    return out.select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")
