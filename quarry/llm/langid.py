"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to four bytes with frozen counts. A byte is coded from the longest context that the
language has seen; where it is new there, an escape leads to the next shorter one, with the symbols already ruled out excluded (escape
method C), down to the empty context and last to all bytes that the language has never seen. The probabilities of the 256 bytes
after any context sum to one, so a text's summed code length is exact. The language that codes a text shortest is predicted.

A text is in none of the languages if one of two models without context codes it shorter than every language does, by a bit that says
which: `shares`, each byte by its share of all languages' training bytes mixed with 1/256 at the weight `UNIFORM`, and 8 bits for every byte.
The first meets letters in no order, the second other scripts and coded data, whose bytes a language must escape to.

The score of a prediction is the weight of its language among all languages and that better model without context; a model's weight falls
with its mean code length per byte times `SCORE_BYTES` (times the text's bytes where it has fewer). So it does not run to 0 or 1 with the
length of the text: it says how far apart the models are on a stretch of that length.

A byte's code length depends on the four bytes before it only (a text begins after four line feeds). The lengths of the five-byte
windows of the training sample are laid out in one table for all languages, the most frequent ones first, up to `TABLE_CELLS` numbers;
other windows are coded from the trees and kept, with the same lengths.

Training: per language the `per_language` documents of least id hash, each with its first `train_bytes` bytes, from rows with a
language outside the held-out fold. All languages together take `sample_bytes` at most: with very many languages each gets fewer
documents. The bounds do not grow with the corpus. Prediction reads whole texts.

Cases: null text, text without a letter, and any text where nothing could be learned: `und`, score 0. Equal lengths: the first language
in order. A null id is hashed as the empty text for the fold. Each row gives a row; long texts need no more memory than a slice.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
PAD = b"\n" * ORDER
PER_LANGUAGE, TRAIN_BYTES, SAMPLE_BYTES = 600, 1 << 13, 1 << 25
#: The uniform part of the byte shares, and the stretch that a score is for.
UNIFORM, SCORE_BYTES = 1 / 64, 4
#: Code lengths in the table: 4 bytes each, on the driver and in each task.
TABLE_CELLS = 1 << 25
#: Windows outside the table whose lengths a task keeps.
CACHE_ENTRIES = 100_000

_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(five bytes before and with each position, as numbers, of all texts laid side by side; where each text begins and ends)."""
    data = np.frombuffer(b"".join([x for t in texts for x in (PAD, t)] + [b"\n"]), dtype=np.uint8).astype(np.uint64)
    n = len(data) - ORDER
    key = data[:n].copy()
    for i in range(1, ORDER + 1):
        key <<= np.uint64(8)
        key |= data[i : i + n]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
    return key.astype(np.int64), np.stack([starts, starts + sizes], axis=1).ravel()


class Tree:
    """One language. For each order: the (context, byte) pairs with counts, and of each context the number of bytes seen (n), of
    different ones (d), and what is left of both in the next shorter context without the context's own bytes (n_up, d_up)."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels: list[tuple[np.ndarray, ...]] = []
        for k in range(ORDER + 1):
            pairs, where = np.unique(keys & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            total = np.bincount(where, weights=counts, minlength=len(pairs)).astype(np.int64)
            contexts, first, d = np.unique(pairs >> 8, return_index=True, return_counts=True)
            n = np.add.reduceat(total, first)
            if k:
                up_pairs, up_total, up_contexts, up_n, up_d = self.levels[-1][:5]
                taken = np.add.reduceat(up_total[np.searchsorted(up_pairs, pairs & ((1 << 8 * k) - 1))], first)
                up = np.searchsorted(up_contexts, contexts & ((1 << 8 * (k - 1)) - 1) if k > 1 else np.zeros_like(contexts))
                n_up, d_up = up_n[up] - taken, up_d[up] - d
            else:
                n_up = d_up = np.zeros(1, dtype=np.int64)
            self.levels.append((pairs, total, contexts, n, d, n_up, d_up))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """The code length of each window's last byte."""
        out = np.zeros(len(keys))
        open_, child = np.ones(len(keys), dtype=bool), np.full(len(keys), -1)
        for k in range(ORDER, -1, -1):
            pairs, total, contexts, n, d, _, _ = self.levels[k]
            pair = keys & ((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(contexts, pair >> 8), len(contexts) - 1)
            there = open_ & (contexts[at] == pair >> 8)
            big_n, big_d = n[at], d[at]
            if k < ORDER:
                n_up, d_up = self.levels[k + 1][5:]
                below = child >= 0
                big_n, big_d = np.where(below, n_up[child], big_n), np.where(below, d_up[child], big_d)
            spot = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            seen = there & (pairs[spot] == pair) & (big_d > 0)
            escape = there & ~seen & (big_d > 0)
            out[seen] -= np.log2(total[spot[seen]] / (big_n + big_d)[seen])
            out[escape] -= np.log2(big_d[escape] / (big_n + big_d)[escape])
            open_ &= ~seen
            child = np.where(there, at, -1)
        out[open_] += np.log2(max(1, 256 - len(self.levels[0][0])))
        return out


class Table:
    """Windows to rows by hash buckets."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(2, len(keys))))) + 1))
        h = self.slot(keys)
        self.order = np.argsort(h, kind="stable")
        self.keys = keys[self.order]
        self.first = np.searchsorted(h[self.order], np.arange((1 << (64 - int(self.shift))) + 1))
        self.most = int(np.diff(self.first).max(initial=0))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; -1 if it has none."""
        slot = self.slot(keys)
        at, out = self.first[slot], np.full(len(keys), -1, dtype=np.int64)
        if not len(self.keys):
            return out
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        out[hit] = at[hit]
        left = np.flatnonzero(~hit)
        for j in range(1, self.most):
            spot = at[left] + j
            inside = spot < self.first[slot[left] + 1]
            left, spot = left[inside], spot[inside]
            hit = self.keys[spot] == keys[left]
            out[left[hit]] = spot[hit]
            left = left[~hit]
        return out


class Model:
    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], cells: int = TABLE_CELLS):
        self.langs = langs
        self.trees = [Tree(*c) for c in counts]
        keys, where = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True) if counts else (np.zeros(0, dtype=np.int64),) * 2
        bytes_ = np.ones(256)
        if counts:
            times = np.bincount(where, weights=np.concatenate([c[1] for c in counts]))
            bytes_ += np.bincount(keys & 255, weights=times, minlength=256)
            if len(keys) > (most := cells // (len(counts) + 1)):
                keys = keys[np.sort(np.argsort(-times, kind="stable")[:most])]
        self.shares = -np.log2((1 - UNIFORM) * bytes_ / bytes_.sum() + UNIFORM / 256)
        self.table = Table(keys)
        self.costs = self.cost(self.table.keys)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        return np.stack([*(t.bits(keys) for t in self.trees), self.shares[keys & 255]], axis=1).astype(np.float32)

    def lengths(self, texts: list[bytes], kept: dict[int, np.ndarray] | None = None) -> np.ndarray:
        """Code lengths in bits: a row per text, a column per language and one, the last, by byte shares alone."""
        keys, ends = windows(texts)
        row = self.table.find(keys)
        costs = self.costs[row]
        if len(new := np.flatnonzero(row < 0)):
            kept = {} if kept is None else kept
            unseen, where = np.unique(keys[new], return_inverse=True)
            missing = np.array([k for k in unseen.tolist() if k not in kept], dtype=np.int64)
            if len(missing):
                if len(kept) > CACHE_ENTRIES:
                    kept.clear()
                    missing = unseen
                kept.update(zip(missing.tolist(), self.cost(missing)))
            costs[new] = np.stack([kept[k] for k in unseen.tolist()])[where]
        sums = np.add.reduceat(costs, ends, axis=0, dtype=np.float64)[::2]
        sums[ends[::2] == ends[1::2]] = 0
        return sums

    def predict(self, texts: list[str | None], kept: dict | None = None) -> tuple[list[str], list[float], list[bool]]:
        """Of each text the language, the score, and whether it is in a learned language at all."""
        if not self.langs or not texts:
            return ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        data = [(t or "").encode() for t in texts]
        bits, size = self.lengths(data, kept), np.array([max(1, len(t)) for t in data])
        bits[:, -1] = np.minimum(bits[:, -1], 8 * size) + 1
        best = bits[:, :-1].argmin(axis=1)
        least = bits[np.arange(len(best)), best]
        weight = np.exp2(-np.clip((bits - least[:, None]) * np.minimum(1, SCORE_BYTES / size)[:, None], -1000, 1000))
        score = 1 / weight.sum(axis=1)
        ok = [has_letter(t) for t in texts]
        inside = least <= bits[:, -1]
        return [self.langs[b] if o else "und" for b, o in zip(best, ok)], [float(s) if o else 0.0 for s, o in zip(score, ok)], [bool(i and o) for i, o in zip(inside, ok)]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, train_bytes: int = TRAIN_BYTES, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """docs: doc_id, text, lang."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.fold())
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    languages = own.select(F.count_distinct("lang")).first()[0]
    per_language = max(1, min(per_language, sample_bytes // (train_bytes * max(1, languages))))
    limits = common.least_per_group(own.select("lang", "doc_id"), "lang", key, per_language, ("doc_id",))
    limits = common.materialise(limits.groupBy("lang").agg(F.max("h").alias("most")), "languages")  # a row per language
    sample = own.select("lang", "text", key.alias("h")).join(F.broadcast(limits), "lang").where("h <= most").select("lang", "text")

    def count(batches):
        for batch in common.slices(batches):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), common.texts(batch)):
                by.setdefault(lang, []).append(text.encode()[:train_bytes])
            for lang, texts in by.items():
                keys, ends = windows(texts)
                mask = np.zeros(len(keys) + 1, dtype=np.int8)
                np.add.at(mask, ends[::2], 1), np.add.at(mask, ends[1::2], -1)
                unique, n = np.unique(keys[np.cumsum(mask[:-1]) > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(unique), pa.string()), pa.array(unique), pa.array(n, pa.int64())], ["lang", "w", "n"])

    grams = sample.mapInArrow(count, "lang string, w long, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    found = grams.toArrow()  # bounded by the sample
    names = found["lang"].combine_chunks().dictionary_encode()
    of, w, n = names.indices.to_numpy(), found["w"].to_numpy(), found["n"].to_numpy()
    number = {lang: i for i, lang in enumerate(names.dictionary.to_pylist())}
    return Model(sorted(number), [(w[of == number[lang]], n[of == number[lang]]) for lang in sorted(number)])


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column, lang_pred and score of each text."""
    spark = common.text_batches(docs.sparkSession)
    source = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        kept: dict[int, np.ndarray] = {}
        for batch in common.slices(batches, budget=1 << 20):
            langs, scores, _ = m.predict(common.texts(batch), kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [id_column, "lang_pred", "score"])

    return source.mapInArrow(run, f"`{id_column}` {source.schema[0].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.0, text_column: str = "text", lang_column: str | None = "lang") -> DataFrame:
    """The documents in a learned language, with a score of least or more: not those without a letter, and not those that a model without
    context codes shorter than any language does. A null in lang_column, if the table has it, becomes the predicted language."""
    spark = common.text_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    column = docs.columns.index(lang_column) if lang_column in docs.columns and dict(docs.dtypes)[lang_column] == "string" else None

    def run(batches):
        m = shared.value
        kept: dict[int, np.ndarray] = {}
        for batch in common.slices(batches, text_column, 1 << 20):
            langs, scores, inside = m.predict(common.texts(batch, text_column), kept)
            if column is not None:
                given = batch.column(column)
                batch = batch.set_column(column, batch.schema.field(column), pc.if_else(pc.is_null(given), pa.array(langs, given.type), given))
            yield batch.filter(pa.array([i and s >= least for i, s in zip(inside, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
