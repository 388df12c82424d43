"""Secret scans: base patterns, and formats learned by grammar inference.

Labelled credentials make a prefix tree with counts. Its states are merged where their statistics are compatible (the ALERGIA test: the
shares of each next character and of ending differ by no more than a Hoeffding bound), which leaves a probabilistic automaton for the
format. Every candidate - a run of credential characters that is not wholly inside one base span, with or without digits, of any length
that an automaton accepts - is scored by the automata, per character, against the characters of ordinary words and numbers; one that
fits a format much better is a span of kind `format`, which may overlap base spans.

Training: labelled credentials are of two sorts. Of each public token format in FORMATS `per_format` examples come from a seeded generator; of
each base kind `per_kind` different values, those of least hash, come from the corpus, of `train_value` characters at most. These bounds do not
grow with the corpus. The characters of ordinary words are counted over all texts, in the pass that finds the base values. Every text is
scanned whole.

Cases: null and empty texts have no spans. Offsets count code points. Equal rows give a row each; with no credentials to learn from only
the base patterns work.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "format")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: A text without any of these can't hold an assignment.
_ASSIGN_HINT = re.compile(r"(?:[Ww][Oo][Rr][Dd]|[Ss][Ww][Dd]|[Rr][Ee][Tt]|[Kk][Ee][Nn]|[Kk][Ee][Yy])[\"' ]*[:=]")
_LONG_HEX = re.compile(r"[0-9a-f]{24}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
PER_KIND, PER_FORMAT, TRAIN_VALUE = 400, 120, 200
#: The part of ordinary characters' shares that is spread evenly, so that a corpus of few letters makes no word improbable.
EVEN = 0.01
#: Candidates of more characters are scored one at a time.
WIDE = 64

# Public token formats as (prefix, alphabet, characters after the prefix), parts in order.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ALNUM = _DIGITS + _UPPER + _LOWER
FORMATS = {
    "github": (("ghp_", _ALNUM, 36),),
    "gitlab": (("glpat-", _ALNUM, 20),),
    "google": (("AIza", _ALNUM + "_-", 35),),
    "npm": (("npm_", _ALNUM, 36),),
    "sendgrid": (("SG_", _ALNUM + "_-", 22), ("_", _ALNUM + "_-", 43)),
    "slack": (("xoxb-", _DIGITS, 12), ("-", _DIGITS, 12), ("-", _ALNUM, 24)),
    "stripe": (("sk_live_", _ALNUM, 24),),
}


def examples(name: str, n: int, seed: int = 3) -> list[str]:
    """n tokens of a public format."""
    r = random.Random(f"{name}:{seed}")
    return ["".join(prefix + "".join(r.choices(alphabet, k=k)) for prefix, alphabet, k in FORMATS[name]) for _ in range(n)]
#: ALERGIA's confidence, and the natural-log gain per character over ordinary words that makes a candidate a secret.
ALPHA, LEAST_GAIN = 0.05, 1.0
_END = ""


def assignments(text: str) -> list[tuple[int, int, str]]:
    if not _ASSIGN_HINT.search(text):
        return []
    return [(m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]


def accesses(text: str) -> list[tuple[int, int, str]]:
    if "AKIA" not in text:
        return []
    return [(m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]


def hexes(text: str) -> list[tuple[int, int, str]]:
    """Only a text with 24 such characters in a row is read by the pattern."""
    at, out = 0, []
    while (m := _LONG_HEX.search(text, at)) is not None:
        end = HEX.match(text, m.start()).end()
        out.append((m.start(), end, text[m.start() : end]))
        at = end
    return out


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind."""
    found = [(k, *x) for k, f in zip(KINDS, (assignments, accesses, hexes)) for x in f(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


class Automaton:
    """A probabilistic automaton: of each state the counts of next characters (the empty one: the end) and the states they lead to."""

    def __init__(self, counts: list[Counter], to: list[dict[str, int]]):
        self.counts, self.to = counts, to
        self.logs = [{c: math.log(n / sum(x.values())) for c, n in x.items() if n} for x in counts]

    def score(self, word: str, floor: float = math.log(1e-4)) -> float:
        """The log-likelihood of a word; a step that was never seen costs the floor and stays in its state."""
        state, total = 0, 0.0
        for c in word:
            logs = self.logs[state]
            if c in logs:
                total += logs[c]
                state = self.to[state][c]
            else:
                total += floor
        return total + self.logs[state].get(_END, floor)

    def reaches(self, word: str, least: float, floor: float = math.log(1e-4)) -> bool:
        """Whether score() is least or more; as no step adds to it, most words are done after a few characters."""
        state, total = 0, 0.0
        for c in word:
            logs = self.logs[state]
            step = logs.get(c)
            if step is None:
                total += floor
            else:
                total += step
                state = self.to[state][c]
            if total < least:
                return False
        return total + self.logs[state].get(_END, floor) >= least

    def tables(self, floor: float = math.log(1e-4)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each state: the step's log and the next state by character code, and the log of ending."""
        log, to = np.full((len(self.logs), 128), floor), np.repeat(np.arange(len(self.logs))[:, None], 128, axis=1)
        for i, (logs, nexts) in enumerate(zip(self.logs, self.to)):
            for c, x in logs.items():
                if c:
                    log[i, ord(c)], to[i, ord(c)] = x, nexts[c]
        return log, to, np.array([logs.get(_END, floor) for logs in self.logs])

    def least(self) -> int:
        """The fewest characters of a word that it accepts."""
        depth = {0: 0}
        for state in (todo := [0]):
            if self.counts[state][_END]:
                return depth[state]
            for below in self.to[state].values():
                if below not in depth:
                    depth[below] = depth[state] + 1
                    todo.append(below)
        raise ValueError("an automaton without an end")


def different(n1: int, f1: int, n2: int, f2: int, alpha: float) -> bool:
    """Whether two shares differ by more than the Hoeffding bound."""
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of the words: prefix tree, then merging of compatible states from the start outwards."""
    counts: list[Counter] = [Counter()]
    to: list[dict[str, int]] = [{}]
    for word in words:
        at = 0
        for c in word:
            counts[at][c] += 1
            if c not in to[at]:
                to[at][c] = len(counts)
                counts.append(Counter())
                to.append({})
            at = to[at][c]
        counts[at][_END] += 1
    total = [sum(x.values()) for x in counts]

    def compatible(a: int, b: int, depth: int = 0) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a == b:
                continue
            for c in counts[a].keys() | counts[b].keys():
                if different(total[a], counts[a][c], total[b], counts[b][c], alpha):
                    return False
            todo.extend((to[a][c], to[b][c]) for c in to[a].keys() & to[b].keys())
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            counts[a].update(counts[b])
            total[a] += total[b]
            for c, below in to[b].items():
                if c in to[a]:
                    todo.append((to[a][c], below))
                else:
                    to[a][c] = below

    red, blue = [0], [(0, c) for c in sorted(to[0])]
    while blue:
        parent, c = blue.pop(0)
        state = to[parent][c]
        if state in red:
            continue
        for r in reversed(red):  # the latest first: states deep in the tree are seldom seen and compatible with many, the start included
            if compatible(r, state):
                to[parent][c] = r
                fold(r, state)
                break
        else:
            red.append(state)
        blue = sorted({(r, c) for r in red for c, s in to[r].items() if s not in red})
    number = {s: i for i, s in enumerate(red)}
    return Automaton([counts[s] for s in red], [{c: number[x] for c, x in to[s].items()} for s in red])


class Formats:
    """The automata of the credentials by kind, and the characters of ordinary words."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: Counter):
        self.automata = {k: infer(words) for k, words in sorted(credentials.items()) if len(words) >= 5}
        alphabet = _ALNUM + "+/_=-"
        total = max(1, sum(ordinary.values()))
        share = {c: (1 - EVEN) * ordinary[c] / total + EVEN / len(alphabet) for c in alphabet}
        self.ordinary = {c: math.log(x) for c, x in share.items()}
        self.folded = {c: math.log(share[c.lower()] + (share[c.upper()] if c.isalpha() else 0)) for c in alphabet}
        self.least = min((a.least() for a in self.automata.values()), default=0)
        self.tables = [a.tables() for a in self.automata.values()]
        codes = [chr(i) for i in range(128)]
        number = {c: -math.log(10) for c in _DIGITS}
        self.plains = np.array([[logs.get(c, 0.0) for c in codes] for logs in (self.ordinary, self.folded, self.ordinary | number)])

    def plain(self, word: str) -> float:
        """The log-likelihood as ordinary characters. A number's, with or without separators, are ten even digits; the letters of a word
        in one case, or with a capital, and without a digit count as either case's."""
        letters = "".join(_LETTER.findall(word))
        digits = 0 if letters else sum("0" <= c <= "9" for c in word)
        one_case = letters.isupper() or letters[1:].islower() or len(letters) == 1
        logs = self.folded if one_case and not _DIGIT.search(word) else self.ordinary
        return sum(logs[c] for c in word if not digits or not "0" <= c <= "9") - digits * math.log(10)

    def gain(self, word: str) -> float:
        """The log-likelihood per character, of the best format, over that of ordinary characters."""
        return (max(a.score(word) for a in self.automata.values()) - self.plain(word)) / (len(word) + 1)

    def is_secret(self, word: str) -> bool:
        if not self.automata or len(word) < self.least:
            return False
        least = self.plain(word) + LEAST_GAIN * (len(word) + 1)
        return any(a.reaches(word, least) for a in self.automata.values())

    def secrets(self, words: list[str]) -> set[str]:
        """Those of the words that are secrets: is_secret() for all of them side by side, very long ones alone."""
        out = {w for w in words if len(w) > WIDE and self.is_secret(w)}
        words = [w for w in words if self.least <= len(w) <= WIDE]
        if not words or not self.automata:
            return out
        size = np.array([len(w) for w in words])
        inside = np.arange(size.max()) < size[:, None]
        code = np.zeros(inside.shape, dtype=np.uint8)
        code[inside] = np.frombuffer("".join(words).encode(), dtype=np.uint8)
        upper, lower, digit = ((code >= ord(x)) & (code <= ord(y)) & inside for x, y in ("AZ", "az", "09"))
        alpha = upper | lower
        n_upper, n = upper.sum(axis=1), alpha.sum(axis=1)
        first = upper[np.arange(len(words)), alpha.argmax(axis=1)]
        one_case = ((n > 0) & (n_upper == n)) | ((n > 1) & (n_upper == first)) | (n == 1)
        kind = np.where(n == 0, 2, np.where(one_case & ~digit.any(axis=1), 1, 0))
        least = (self.plains[kind[:, None], code] * inside).sum(axis=1) + LEAST_GAIN * (size + 1) - 1e-9
        for log, to, end in self.tables:
            live, state, total = np.arange(len(words)), np.zeros(len(words), dtype=np.int64), np.zeros(len(words))
            for j in range(inside.shape[1]):
                done = size[live] == j
                if done.any():
                    hit = live[done][total[done] + end[state[done]] >= least[live[done]]]
                    out.update(words[i] for i in hit.tolist())
                c = code[live, j]
                total = total + log[state, c]
                stay = ~done & (total >= least[live])
                live, state, total = live[stay], to[state, c][stay], total[stay]
                if not len(live):
                    break
            hit = live[total + end[state] >= least[live]]
            out.update(words[i] for i in hit.tolist())
        return out


def scan_text(text: str, formats: Formats, secrets: set[str] | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans). secrets: those among the text's candidates, if they are known."""
    base = [x[:3] for x in base_spans(text)]
    if secrets is None:
        secrets = formats.secrets(list(set(CANDIDATE.findall(text))))
    more, at, end = [], 0, 0
    for m in CANDIDATE.finditer(text) if secrets else ():
        if m[0] in secrets:
            while at < len(base) and base[at][1] <= m.start():
                end = max(end, base[at][2])
                at += 1
            if end < m.end():
                more.append(("format", m.start(), m.end()))
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def train(docs: DataFrame, per_kind: int = PER_KIND, per_format: int = PER_FORMAT, train_value: int = TRAIN_VALUE, formats: tuple[str, ...] = tuple(FORMATS), id_column: str = "doc_id", text_column: str = "text") -> Formats:
    """One pass over all texts gives the base values and the counts of credential characters; both are reduced before the shuffle."""
    common.text_batches(docs.sparkSession)
    source = docs.select(F.col(text_column).alias("text"))
    alphabet = _ALNUM + "+/_=-"

    def extract(batches):
        for batch in common.slices(batches):
            found: Counter = Counter()
            for text in common.texts(batch):
                for k, _, _, v in base_spans(text or ""):
                    if len(v) <= train_value:
                        found[k, v] += 1
            times = np.bincount(np.frombuffer(common.utf8(batch.column(0))[1], dtype=np.uint8), minlength=256)
            found.update({("character", c): int(times[ord(c)]) for c in alphabet})
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], ["kind", "value", "n"])

    found = common.materialise(source.mapInArrow(extract, "kind string, value string, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    credentials = {name: examples(name, per_format) for name in formats}
    chosen = common.least_per_group(found.where("kind <> 'character'"), "kind", F.xxhash64("value"), per_kind, ("value",))
    for kind, value in chosen.select("kind", "value").orderBy("kind", "value").collect():  # per_kind rows of each of three kinds
        credentials.setdefault(kind, []).append(value)
    plain = Counter({r.value: r.n for r in found.where("kind = 'character' AND n > 0").collect()})  # a row per character
    return Formats(credentials, plain)


def scan(docs: DataFrame, formats: Formats, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column, the base spans and all spans of each text: arrays of (kind, start, end)."""
    spark = common.text_batches(docs.sparkSession)
    source = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    shared = spark.sparkContext.broadcast(formats)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def rows(found):
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], span)

    def run(batches):
        f = shared.value
        for batch in common.slices(batches):
            texts = [t or "" for t in common.texts(batch)]
            words: set[str] = set()
            for t in texts:
                words.update(CANDIDATE.findall(t))
            secrets = f.secrets(list(words))
            both = [scan_text(t, f, secrets) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), rows([b for b, _ in both]), rows([a for _, a in both])], [id_column, "base", "spans"])

    kind = "array<struct<kind:string,start:int,end:int>>"
    return source.mapInArrow(run, f"`{id_column}` {source.schema[0].dataType.simpleString()}, base {kind}, spans {kind}")


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[secret]") -> str:
    """The text with each span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: x[1:]):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])
