"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

A text is the sequence of its lines that hold a word. Each line has binary features of its shape (length, symbols, case, digits, word
variety, punctuation, repetition). The field scores label sequences by feature and transition weights; Viterbi decoding, side by side
over many texts, gives the best labels, and the share of words in content lines decides whether a text is kept. Base rules go first.

Training: per quality label the `per_label` labelled documents of least id hash, with their first `train_lines` lines; the bound does not
grow with the corpus. What is labelled are documents, so the labels of lines are latent. A first fit has them follow their document, with
runs of lines from the other kind spliced in by a seeded generator, whose labels are known. Then, `rounds` times, each document is decoded
and keeps the decoded labels where they agree with its own label (a good one mostly content, a bad one mostly boilerplate, by words),
else all lines take its label; spliced copies follow, and the field is fitted again. The weights maximise the penalised conditional
likelihood.

Cases: null and empty texts have no words and fail the base rules; without labelled rows of both kinds every line is content. Rows
with equal ids give a row each. Other columns of the input, whatever their names, do not come through. Text of any length is read whole; the label of a document with contradicting labels is its least one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

PER_LABEL, TRAIN_LINES, ROUNDS = 500, 120, 2
CONTENT, BOILERPLATE = 0, 1
#: A text is kept if so large a part of its words is in content lines.
LEAST_CONTENT = 0.5

_SPACE = b" \t\n\r\x0b\x0c"
_DIGITS, _UPPER, _LOWER = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
_FINAL = (b".", b"!", b"?", b":", b'"', "…".encode(), "。".encode())

#: Limits between the bins of each numeric feature, in the order of line_features.
BINS = (
    (1.5, 3.5, 8.5, 20.5, 60.5),  # words
    (0.01, 0.05, 0.12),  # symbols to characters
    (0.02, 0.1, 0.3),  # digits to characters
    (0.1, 0.3, 0.7),  # upper case to ASCII letters
    (0.2, 0.4, 0.6, 0.8),  # different words to words
    (2.5, 4.0, 9.0),  # characters to words
    (0.02, 0.1, 0.4),  # words equal to the word before
    (0.3, 0.6, 0.9),  # words that end in a sign
)
FLAGS = 3  # ends like a sentence; equals an earlier line; begins in lower case
OFFSETS = np.concatenate([[0], np.cumsum([len(b) + 1 for b in BINS])])
N_FEATURES = int(OFFSETS[-1]) + FLAGS + 1  # and the bias


def base(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = sum(len(w) for w in words)
    if not text.isascii():
        chars -= len(text) - len(text.decode())
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return chars, sum(text.count(bytes([s])) for s in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    if len(number) == n:
        return 0
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    grams = pairs[:-1] * len(number) + ids[2:]
    _, which, times = np.unique(grams, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[which] > 1)
    cover = np.zeros(n, dtype=bool)
    for i in range(3):
        cover[hit + i] = True
    return int(cover.sum())


def line_features(text: bytes) -> tuple[np.ndarray, list[int]]:
    """(a row of feature numbers per line, words per line) of the lines that hold a word."""
    rows, sizes, seen = [], [], set()
    flags = []
    for line in text.split(b"\n"):
        words = line.split()
        if not (n := len(words)):
            continue
        size = len(line)
        upper = size - len(line.translate(None, _UPPER))
        lower = size - len(line.translate(None, _LOWER))
        same = sum(map(bytes.__eq__, words, words[1:]))
        signs = sum(1 for w in words if not w[-1:].isalnum() and w[-1] < 128)
        rows.append((n, (size - len(line.translate(None, SYMBOLS))) / size, (size - len(line.translate(None, _DIGITS))) / size, upper / max(1, upper + lower), len(set(words)) / n, size / n, same / n, signs / n))
        flags.append((line.rstrip(_SPACE).endswith(_FINAL), line in seen, words[0][:1].islower()))
        seen.add(line)
        sizes.append(n)
    if not rows:
        return np.zeros((0, len(BINS) + FLAGS + 1), dtype=np.int64), sizes
    values = np.array(rows)
    out = np.empty((len(rows), len(BINS) + FLAGS + 1), dtype=np.int64)
    for j, limits in enumerate(BINS):
        out[:, j] = OFFSETS[j] + np.searchsorted(limits, values[:, j])
    none = N_FEATURES  # a feature that is off
    out[:, len(BINS) : -1] = np.where(np.array(flags), OFFSETS[-1] + np.arange(FLAGS), none)
    out[:, -1] = N_FEATURES - 1
    return out, sizes


class Field:
    """weights: (features + 1, 2), the last row zero; moves: (from, to); first: of the first line."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, first: np.ndarray):
        self.weights, self.moves, self.first = weights, moves, first

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1)

    def decode(self, features: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each text (Viterbi); of equals the one with content at the last difference."""
        sizes = np.array([len(f) for f in features])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        live = int((sizes > 0).sum())
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int8)] * len(features)
        if not live:
            return out
        flat = self.emissions(np.concatenate([features[i] for i in order[:live]]))
        starts = np.concatenate([[0], np.cumsum(sizes[:live])[:-1]])
        back = np.zeros((len(flat), 2), dtype=np.int8)
        score = self.first + flat[starts]
        final = np.empty((live, 2))
        for t in range(1, int(sizes[0])):
            now = int(np.searchsorted(-sizes, -t, side="left"))
            final[now : len(score)] = score[now:]
            through = score[:now, :, None] + self.moves
            best = through.argmax(axis=1)
            back[starts[:now] + t] = best
            score = np.take_along_axis(through, best[:, None, :], axis=1)[:, 0] + flat[starts[:now] + t]
        final[: len(score)] = score
        for r, i in enumerate(order[:live]):
            label, n = int(final[r].argmax()), int(sizes[r])
            way = np.empty(n, dtype=np.int8)
            steps = back[starts[r] : starts[r] + n].tolist()
            for t in range(n - 1, -1, -1):
                way[t] = label
                label = steps[t][label]
            out[i] = way
        return out


class Packed:
    """Texts laid side by side without padding: a row of features per line, the longest text first."""

    def __init__(self, texts: list[np.ndarray], labels: list[np.ndarray]):
        order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
        self.sizes = np.array([len(texts[i]) for i in order], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)
        self.features, self.kind = np.unique(np.concatenate([texts[i] for i in order]), axis=0, return_inverse=True)  # lines are alike
        self.labels = np.concatenate([labels[i] for i in order]).astype(np.int64)
        self.steps = [self.starts[: int(np.searchsorted(-self.sizes, -t, side="left"))] + t for t in range(int(self.sizes[0]))]
        self.later = np.concatenate(self.steps[1:]) if len(self.steps) > 1 else np.zeros(0, dtype=np.int64)
        self.truth = np.eye(2)[self.labels]
        self.moves = np.bincount(self.labels[self.later - 1] * 2 + self.labels[self.later], minlength=4).reshape(2, 2)


def packed_likelihood(params: np.ndarray, x: Packed, penalty: float) -> tuple[float, np.ndarray]:
    """The penalised log-likelihood of the labels and its gradient, by the scaled forward and backward sums of all texts side by side."""
    f = N_FEATURES * 2
    weights = np.vstack([params[:f].reshape(N_FEATURES, 2), np.zeros((1, 2))])
    moves, first = params[f : f + 4].reshape(2, 2), params[f + 4 :]
    emit = weights[x.features].sum(axis=1)[x.kind]
    high = emit.max(axis=1, keepdims=True)
    e, m, s = np.exp(emit - high), np.exp(moves - moves.max()), np.exp(first - first.max())
    n = len(emit)
    ahead, behind, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    for t, rows in enumerate(x.steps):
        a = e[rows] * (s if t == 0 else ahead[rows - 1] @ m)
        total = a[:, 0] + a[:, 1]
        scale[rows] = total
        ahead[rows] = a / total[:, None]
    e /= scale[:, None]
    for rows in reversed(x.steps[1:]):
        behind[rows - 1] = (e[rows] * behind[rows]) @ m.T
    norm = np.log(scale).sum() + high.sum() + len(x.later) * moves.max() + len(x.starts) * first.max()
    after = x.later
    pair = m * (ahead[after - 1].T @ (e[after] * behind[after]))
    value = (x.truth * emit).sum() + (x.truth[x.starts] * first).sum() + (x.moves * moves).sum() - norm - penalty / 2 * (params**2).sum()
    gap = x.truth - ahead * behind
    by_kind = [np.bincount(x.kind, weights=gap[:, k], minlength=len(x.features)) for k in (0, 1)]
    slots = x.features.ravel()
    grad_w = np.stack([np.bincount(slots, weights=np.repeat(g, x.features.shape[1]), minlength=N_FEATURES + 1)[:-1] for g in by_kind], axis=1)
    grad = np.concatenate([grad_w.ravel(), (x.moves - pair).ravel(), gap[x.starts].sum(axis=0)])
    return float(value), grad - penalty * params


def likelihood(params: np.ndarray, features: np.ndarray, labels: np.ndarray, mask: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """packed_likelihood() of padded texts. features: (texts, lines, slots); labels and mask: (texts, lines)."""
    return packed_likelihood(params, Packed([f[m] for f, m in zip(features, mask)], [y[m] for y, m in zip(labels, mask)]), penalty)


def fit(texts: list[np.ndarray], labels: list[np.ndarray], rounds: int = 80, penalty: float = 1.0) -> Field:
    """Maximises the likelihood of the lines' labels by Adam over all texts at once. Without lines of both labels all is content."""
    params = np.zeros(N_FEATURES * 2 + 6)
    if len(set(np.concatenate([*labels, np.zeros(0, dtype=np.int64)]).tolist())) == 2:
        x = Packed(texts, labels)
        m, v = np.zeros_like(params), np.zeros_like(params)
        for i in range(1, rounds + 1):
            _, grad = packed_likelihood(params, x, penalty)
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            params += 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    f = N_FEATURES * 2
    return Field(np.vstack([params[:f].reshape(N_FEATURES, 2), np.zeros((1, 2))]), params[f : f + 4].reshape(2, 2), params[f + 4 :])


def spliced(texts: list[np.ndarray], labels: list[np.ndarray], kinds: list[int], rng: np.random.Generator) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each text with a run of lines of a text of the other kind put in somewhere, their labels with them."""
    of = [[i for i, k in enumerate(kinds) if k == kind] for kind in (0, 1)]
    out, marks = [], []
    for f, y, k in zip(texts, labels, kinds):
        i = of[1 - k][int(rng.integers(len(of[1 - k])))]
        start = int(rng.integers(len(texts[i])))
        run = slice(start, start + int(rng.integers(1, 1 + len(texts[i]))))
        at = int(rng.integers(len(f) + 1))
        out.append(np.concatenate([f[:at], texts[i][run], f[at:]]))
        marks.append(np.concatenate([y[:at], labels[i][run], y[at:]]))
    return out, marks


def fit_latent(texts: list[np.ndarray], words: list[np.ndarray], kinds: list[int], rounds: int = ROUNDS, seed: int = 17) -> Field:
    """The field from texts whose documents are labelled: kinds has CONTENT or BOILERPLATE for each, words the words of each line."""
    labels = [np.full(len(f), k, dtype=np.int64) for f, k in zip(texts, kinds)]
    if len(set(kinds)) < 2:
        return fit(texts, labels)
    rng = np.random.default_rng(seed)
    more, marks = spliced(texts, labels, kinds, rng)
    field = fit([*texts, *more], [*labels, *marks])
    for _ in range(rounds):
        for i, got in enumerate(field.decode(texts)):
            agree = words[i][got == kinds[i]].sum() > 0.5 * words[i].sum()
            labels[i] = got.astype(np.int64) if agree else np.full(len(got), kinds[i], dtype=np.int64)
        more, marks = spliced(texts, labels, kinds, rng)
        field = fit([*texts, *more], [*labels, *marks])
    return field


def training_labels(labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, quality) of the documents that train() learns from: per_label of each quality, by least hash of the id."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return common.least_per_group(known, "quality", F.xxhash64(F.col("doc_id").cast("string")), per_label, ("doc_id",)).select("doc_id", "quality")


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, train_lines: int = TRAIN_LINES) -> Field:
    """docs: doc_id, text. labels: doc_id, quality (1 is good)."""
    common.text_batches(docs.sparkSession)
    chosen = common.materialise(training_labels(labels, per_label), "labelled")  # 2 * per_label rows
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.where(F.length("text") > 0).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))

    def extract(batches):
        for batch in common.slices(batches):
            both = [line_features(t.encode()) for t in common.texts(batch)]
            rows, sizes = [f[:train_lines].ravel().tolist() for f, _ in both], [s[:train_lines] for _, s in both]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))], ["quality", "f", "words"])

    found = sample.select(F.col("quality").cast("int"), "text").mapInArrow(extract, "quality int, f array<int>, words array<int>").where(F.size("f") > 0).orderBy(F.xxhash64("f"), "quality").toArrow()
    width = len(BINS) + FLAGS + 1
    texts = [np.array(f, dtype=np.int64).reshape(-1, width) for f in found["f"].to_pylist()]
    return fit_latent(texts, [np.array(w) for w in found["words"].to_pylist()], [CONTENT if q else BOILERPLATE for q in found["quality"].to_pylist()])


def judge(docs: DataFrame, field: Field, least_content: float = LEAST_CONTENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document the base measures, base_failed, kept, content_share and line_labels (0 content, 1 boilerplate)."""
    common.text_batches(docs.sparkSession)
    source = docs.select(F.col(id_column), F.col(text_column).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in common.slices(batches):
            counts, features, sizes = [], [], []
            for t in common.texts(batch):
                text = (t or "").encode()
                words = text.split()
                counts.append((len(words), *base(text, words)))
                f, s = line_features(text)
                features.append(f), sizes.append(np.array(s, dtype=np.int64))
            labels = field.decode(features)
            share = [float(s[x == CONTENT].sum() / s.sum()) if len(s) else 0.0 for s, x in zip(sizes, labels)]
            failed = [n < MIN_WORDS or 100 * r > MAX_REPEAT_PERCENT * n for n, *_, r in counts]
            kept = [not f and s >= least_content for f, s in zip(failed, share)]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(failed), pa.array(kept), pa.array(share, pa.float64()), pa.array(labels, pa.list_(pa.int8()))], [id_column, *names, "base_failed", "kept", "content_share", "line_labels"])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_column}` {kind}, {', '.join(n + ' long' for n in names)}, base_failed boolean, kept boolean, content_share double, line_labels array<tinyint>")
