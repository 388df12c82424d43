"""Token counts by a linear longest-match automaton.

A trie over the vocabulary gets failure links in the manner of longest-match-first tokenisation: the link of a node leads to the
node that stands for what is left of its string once the longest matching pieces have been popped, and the node keeps how many
pieces are popped on the way. A word is then read once, byte by byte, and only counts are added up; no piece is built.

A word is a run of bytes other than ASCII white space; a mark (one space byte, as in the vocabulary) goes before it. Words are read
side by side, one byte of every word at a time. The vocabulary must hold every single byte, so that any word can be matched; the query takes
the pieces of the byte-level ranks as its vocabulary, and their ranks play no part.

Cases: a null or empty text has no words and no tokens; texts and words of any length are read whole; each row gives a row.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .bpe import load_ranks

#: Words whose counts a worker keeps.
CACHE_ENTRIES = 400_000


class Automaton:
    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][byte]
            final[node] = node != 0
        if any(b not in children[0] or not final[children[0][b]] for b in range(256)):
            raise ValueError("the vocabulary lacks a single byte")
        fail, popped = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in children[node].items():
                queue.append(child)
                if final[child]:
                    fail[child], popped[child] = 0, 1
                    continue
                at, pops = fail[node], popped[node]
                while at != -1 and byte not in children[at]:
                    pops += popped[at]
                    at = fail[at]
                if at != -1:
                    fail[child], popped[child] = children[at][byte], pops
        self.fail, self.popped = np.array(fail, dtype=np.int32), np.array(popped, dtype=np.int32)
        keys = np.array(sorted((n << 8 | b, c) for n, kids in enumerate(children) for b, c in kids.items()), dtype=np.int64)
        self.keys, self.targets = np.ascontiguousarray(keys[:, 0]), keys[:, 1].astype(np.int32)
        rest = np.zeros(len(children), dtype=np.int32)
        for node in range(1, len(children)):
            at, pops = node, 0
            while at != 0:
                pops += popped[at]
                at = fail[at]
                if at == -1:
                    raise ValueError("a node can't be matched to its end")
            rest[node] = pops
        self.rest = rest

    def count(self, words: list[bytes]) -> np.ndarray:
        """Pieces of each word."""
        order = np.argsort([-len(w) for w in words], kind="stable")
        lengths = np.array([len(w) for w in words], dtype=np.int64)[order]
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])[:-1]])[order]
        node, out = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        live = len(words)
        for at in range(int(lengths[0]) if live else 0):
            live = int(np.searchsorted(-lengths, -at, side="left"))  # words longer than at
            byte = data[starts[:live] + at]
            todo = np.arange(live)
            while len(todo):
                key = (node[todo] << 8) | byte[todo]
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[found] == key
                node[todo[hit]] = self.targets[found[hit]]
                todo = todo[~hit]
                out[todo] += self.popped[node[todo]]
                node[todo] = self.fail[node[todo]]
        out += self.rest[node]
        back = np.empty(len(words), dtype=np.int64)
        back[order] = out
        return back


@lru_cache(maxsize=2)
def automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(list(load_ranks(path))), {}


def token_counts(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column, n_words and n_tokens of each text. vocabulary: the path of a rank file that every executor can read."""
    common.text_batches(docs.sparkSession)
    source = docs.select(F.col(id_column), F.col(text_column).alias("text"))

    def run(batches):
        machine, known = automaton(vocabulary)
        for batch in common.slices(batches):
            words = [t.encode().split() if t else [] for t in common.texts(batch)]
            new = [w for w in set().union(*words) if w not in known]
            if len(known) + len(new) > CACHE_ENTRIES:
                known.clear()
                new = list(set().union(*words))
            known.update(zip(new, machine.count([b" " + w for w in new]).tolist()))
            sums = [sum(map(known.__getitem__, ws)) for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(ws) for ws in words], pa.int64()), pa.array(sums, pa.int64())], [id_column, "n_words", "n_tokens"])

    return source.mapInArrow(run, f"`{id_column}` {source.schema[0].dataType.simpleString()}, n_words long, n_tokens long")
