"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by offsets.

Pre-tokens are found without a regular expression. Every code point gets a symbol (its class, with one or two characters of
look-ahead folded in), every symbol is a transition function on eight states, and the functions are composed by a blocked
associative scan. The state before a character and its symbol say whether a pre-token starts there.

Cases: a null or empty text has no tokens (n_tokens 0, digests of the empty string). Text of any length is encoded whole.
Repeated rows and repeated or null ids give a row each. Input columns other than the named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The code points with the White_Space property; the endings of the pattern's contractions.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Symbols: the classes; a space that joins the next pre-token; white space before one; other white space; an apostrophe before an ending.
S_LETTER, S_NUMBER, S_OTHER, S_JOIN, S_LAST, S_WHITE, S_APOS1, S_APOS2 = range(8)
#: States: what the open pre-token is; CLOSED after a finished one; ONE_MORE and TWO_MORE inside a contraction.
Q_LETTER, Q_NUMBER, Q_OTHER, Q_JOIN, Q_WHITE, Q_CLOSED, Q_ONE, Q_TWO = range(8)
#: Merged pre-tokens that a worker keeps.
CACHE_ENTRIES = 400_000
BLOCK = 128


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for i in range(0x110000):
        if (k := kinds.get(unicodedata.category(chr(i))[0])) is not None:
            out[i] = k
    out[WHITE_SPACE] = SPACE
    return out


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token starts at the symbol."""
    if symbol == S_LETTER and state in (Q_ONE, Q_TWO):
        return (Q_CLOSED if state == Q_ONE else Q_ONE), False
    if symbol in (S_LETTER, S_NUMBER, S_OTHER):
        return symbol, state not in (symbol, Q_JOIN)
    if symbol in (S_APOS1, S_APOS2):
        if state in (Q_OTHER, Q_JOIN):
            return Q_OTHER, False
        return (Q_ONE if symbol == S_APOS1 else Q_TWO), True
    if symbol == S_WHITE:
        return Q_WHITE, state != Q_WHITE
    return (Q_JOIN if symbol == S_JOIN else Q_CLOSED), True


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(composition table, end state by function from CLOSED, starts by state and symbol, identity). Functions 0-7 are the
    symbols, 8-15 the symbols at the start of a text."""
    plain = [tuple(step(q, s)[0] for q in range(8)) for s in range(8)]
    reset = [(f[Q_CLOSED],) * 8 for f in plain]
    known: dict[tuple, int] = {}
    order: list[tuple] = []
    for f in [*plain, *reset, tuple(range(8))]:
        known.setdefault(f, len(order))
        order.append(f)  # a repeated function keeps its own number too
    at = 0
    while at < len(order):
        for g in list(order):
            for h in (tuple(g[q] for q in order[at]), tuple(order[at][q] for q in g)):
                if h not in known:
                    known[h] = len(order)
                    order.append(h)
        at += 1
    m = len(order)
    table = np.array([[known[tuple(g[q] for q in f)] for g in order] for f in order], dtype=np.uint16 if m > 255 else np.uint8)
    starts = np.array([[step(q, s)[1] for s in range(8)] for q in range(8)])
    return table, np.array([f[Q_CLOSED] for f in order], dtype=np.uint8), starts, known[tuple(range(8))]


def prefix_functions(f: np.ndarray) -> np.ndarray:
    """The composition of all functions up to and with each position: scans inside blocks, then over the blocks' totals."""
    table, _, _, identity = automaton()
    n, m = len(f), len(table)
    flat = table.ravel()
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, identity, dtype=table.dtype)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    for i in range(1, BLOCK):
        grid[i] = flat[grid[i - 1].astype(np.int32) * m + grid[i]]
    total, hop = grid[-1].copy(), 1
    while hop < rows:
        total[hop:] = flat[total[:-hop].astype(np.int32) * m + total[hop:]]
        hop *= 2
    before = np.concatenate([[np.array(identity, dtype=table.dtype)], total[:-1]]).astype(np.int32) * m
    grid = flat[before[None, :] + grid]
    return grid.T.ravel()[:n]


def boundaries(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions of code points at which pre-tokens start. text_starts: where each (not empty) text starts."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes()[points]
    first = np.zeros(n, dtype=bool)
    first[text_starts] = True
    last = np.zeros(n, dtype=bool)
    last[np.append(text_starts[1:], n) - 1] = True
    symbol = kind.copy()
    white = kind == SPACE
    joins = white & ~last
    joins[:-1] &= ~white[1:]
    symbol[white] = S_WHITE
    symbol[joins] = S_LAST
    symbol[joins & (points == 0x20)] = S_JOIN
    apos = np.flatnonzero((points == 0x27) & ~last)
    if len(apos):
        one = points[apos + 1]
        two = points[np.minimum(apos + 2, n - 1)]
        two = np.where(last[apos + 1], 0, two)
        symbol[apos[np.isin(one, [ord(c) for c in ENDINGS_1])]] = S_APOS1
        for a, b in ENDINGS_2:
            symbol[apos[(one == ord(a)) & (two == ord(b))]] = S_APOS2
    f = symbol.astype(np.uint8)
    f[first] += 8
    _, ends, starts, _ = automaton()
    state = ends[prefix_functions(f)]
    before = np.concatenate([[Q_CLOSED], state[:-1]])
    before[first] = Q_CLOSED
    return np.flatnonzero(starts[before, symbol])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Pair merging of one pre-token: the adjacent pair of the lowest rank first, the leftmost of equals."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    if len(piece) > 400:
        return merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pair = [ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
    while pair:
        low = min(pair)
        if low == 1 << 30:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
    return tuple(ranks[p] for p in parts)


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same merges from a heap over a linked list, for very long pre-tokens."""
    import heapq

    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        if not alive[i] or end[i] != mid or mid >= n or not alive[mid] or end[mid] != stop:
            continue
        alive[mid] = False
        end[i], after[i] = stop, after[mid]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], i, stop))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class Merges(dict):
    """Pre-token to ids, merged on first sight; emptied when full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = merge(piece, self.ranks)
        if len(piece) <= 64:
            self[piece] = out
        return out


class Codec:
    """The vocabulary of a rank file; encodes and decodes whole texts."""

    def __init__(self, path: str):
        ranks = load_ranks(path)
        self.merges = Merges(ranks)
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.decimal = [str(i).encode() for i in range(len(self.pieces))]
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)

    def encode(self, offsets: np.ndarray, data: bytes) -> list[list[int]]:
        """Ids of each text; data holds the texts' UTF-8 one after another."""
        raw = np.frombuffer(data, dtype=np.uint8)
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        filled = offsets[:-1][offsets[1:] > offsets[:-1]]
        cuts = heads[boundaries(points, np.searchsorted(heads, filled))] if len(points) else np.zeros(0, dtype=np.int64)
        per_text = np.searchsorted(cuts, offsets).tolist()
        cuts = [*cuts.tolist(), len(data)]
        look, out = self.merges.__getitem__, []
        for a, b in zip(per_text, per_text[1:]):
            out.append(list(chain.from_iterable(map(look, [data[s:e] for s, e in zip(cuts[a:b], cuts[a + 1 : b + 1])]))))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """The byte at which each token starts, so that any range of tokens decodes to a known slice of the text."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])[:-1]]) if ids else np.zeros(0, dtype=np.int64)

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(b" ".join(map(self.decimal.__getitem__, ids))).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


OUTPUTS = {"ids": "ids array<int>", "offsets": "offsets array<long>", "decoded": "decoded string", "digests": "ids_sha256 string, decoded_sha256 string"}


def encode_decode(docs: DataFrame, vocabulary: str, outputs: tuple[str, ...] = ("ids", "offsets"), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes each text and decodes the ids again. Returns the id column, n_tokens and the chosen OUTPUTS. vocabulary is the
    path of a rank file that every executor can read."""
    common.text_batches(docs.sparkSession)
    source = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    schema = ", ".join([f"`{id_column}` {source.schema[0].dataType.simpleString()}", "n_tokens long", *(OUTPUTS[o] for o in outputs)])

    def run(batches):
        c = codec(vocabulary)
        for batch in common.slices(batches):
            offsets, data = common.utf8(batch.column(1))
            ids = c.encode(offsets, data)
            columns = [batch.column(0), pa.array([len(x) for x in ids], pa.int64())]
            for o in outputs:
                if o == "ids":
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                elif o == "offsets":
                    columns.append(pa.array([c.offsets(x) for x in ids], pa.list_(pa.int64())))
                elif o == "decoded":
                    columns.append(pa.array([c.decode(x).decode("utf-8") for x in ids], pa.string()))
                else:
                    columns.append(pa.array([c.digest(x) for x in ids], pa.string()))
                    columns.append(pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string()))
            names = [id_column, "n_tokens"]
            for o in outputs:
                names += ["ids_sha256", "decoded_sha256"] if o == "digests" else [o]
            yield pa.RecordBatch.from_arrays(columns, names)
        c.merges.clear()  # the worker lives on, for tasks of other stages too
        common.give_back()

    return source.mapInArrow(run, schema)
