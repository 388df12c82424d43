"""Main text of web pages: a bidirectional LSTM labels every block.

A page is cut into leaf blocks in page order. Each block is a vector: hashed tokens of its tag path (tags, class and id words), hashed
words of its text, and measures of length, links, signs and place. A bidirectional LSTM (numpy) reads the sequence, so that each verdict
draws on the whole page; the blocks called content are the text.

Training: `train_pages` pages of least id hash, of `train_chars` characters at most and read up to `train_blocks` blocks, taken again with
further boilerplate put in and with other wrappers, from a seeded generator, and once more without telling names: no classes or ids, and
every sectioning element a plain division, so that text, links and place have to decide. What is content follows from the elements around a
block before the names go. The bounds do not grow with the corpus. Prediction sees no rules.

Blocks end at the edges of block elements; elements of other names, unknown ones included, are part of the text around them.
Scripts, styles, titles and text areas hold no text, up to the end of the page if they are not closed. Embedded frames and templates are
left out where they are closed; an open or self-closing one loses its tag only. Everything else - pictures, formulas, fallbacks of objects
and media, choices of forms - is text like any other, for the network to judge. Table cells are blocks.

Prediction goes over pages of like length side by side, in steps of bounded size that carry the states, once in each direction: what is
held of a page besides its blocks is one number a block. Open elements are found by tag at any depth.

Cases: null and empty pages, and pages without a block, give the empty text. Markup may be cut off anywhere, misnested or unclosed.
Pages of any length are read whole. Equal rows give a row each. Kept columns that the table lacks are left out; columns of other names,
`text` and `n_chars` included, do not matter.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_PAGES, TRAIN_CHARS, TRAIN_BLOCKS = 160, 200_000, 200
#: Blocks, padding included, that are read side by side in one step of prediction; nodes of tag paths kept from page to page.
STEP_CELLS, KEPT_NODES = 8192, 20_000
PATH_DIM, WORD_DIM, MEASURES = 128, 32, 8
INPUT, HIDDEN = PATH_DIM + WORD_DIM + MEASURES, 24

_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Elements of HTML by what they do to the text around them.
RAW = {"script", "style", "title", "textarea"}
RAW_IF_CLOSED = {"iframe", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "colgroup", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
SPACED = {"br", "img", "wbr"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


class Node:
    """An open element and those around it. raw: signed counts of the path's hashed tokens."""

    __slots__ = ("parent", "tag", "name", "depth", "raw", "below", "_vector")

    def __init__(self, parent: Node | None, tag: str, name: str):
        self.parent, self.tag, self.name = parent, tag, name
        self.depth = parent.depth + 1 if parent else 0
        self.raw = parent.raw.copy() if parent else np.zeros(PATH_DIM, dtype=np.int32)
        self.below: dict[str, Node] = {}
        self._vector: np.ndarray | None = None
        if parent:
            for token in (f"in:{tag}", *(f"name:{n}" for n in name.split()[1:])):
                i, sign = bucket(token, PATH_DIM)
                self.raw[i] += int(sign)

    def child(self, tag: str, name: str) -> Node:
        found = self.below.get(name)
        if found is None:
            found = self.below[name] = Node(self, tag, name)
        return found

    def vector(self) -> np.ndarray:
        if self._vector is None:
            v = self.raw.astype(np.float32)
            if self.parent:
                i, sign = bucket(f"leaf:{self.tag}", PATH_DIM)
                v[i] += sign
            self._vector = np.clip(v, -2, 2)
        return self._vector

    def names(self) -> list[str]:
        """The elements from the outermost to this one."""
        out, at = [], self
        while at.parent:
            out.append(at.name)
            at = at.parent
        return out[::-1]


class Block:
    __slots__ = ("at", "text", "link")

    def __init__(self, at: Node, text: str, link: float):
        self.at, self.text, self.link = at, text, link


@lru_cache(maxsize=20000)
def element(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role."""
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)) if "=" in attributes else ""
    return " ".join([tag, *(w.lower() for w in _NAME_WORD.findall(names))])


class Paths:
    """The root of the tag paths, shared by the pages of a task and begun anew when many nodes hang from it."""

    def __init__(self):
        self.root, self.made = Node(None, "", ""), 0

    def start(self) -> Node:
        if self.made > KEPT_NODES:
            self.root, self.made = Node(None, "", ""), 0
        return self.root


def blocks(page: str | None, paths: Paths | None = None) -> list[Block]:
    """The leaf blocks: text between the edges of block elements, references decoded, white space made single spaces."""
    out: list[Block] = []
    paths = paths or Paths()
    stack: list[Node] = [paths.start()]
    open_at: dict[str, list[int]] = {}  # places in the stack by tag
    unclosed: set[str] = set()  # tags of raw elements that nothing ahead closes
    parts: list[str] = []
    link = linked = at = 0

    def flush():
        nonlocal linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(stack[-1], text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def take(piece: str):
        nonlocal linked
        piece = html.unescape(piece) if "&" in piece else piece
        parts.append(piece)
        if link:
            linked += len(piece)

    def leave(place: int):
        """Closes the elements from a place in the stack on."""
        while len(stack) > place:
            open_at[stack.pop().tag].pop()

    page = page or ""
    while True:
        m = _MARK.search(page, at)
        if m is None:
            if at < len(page):
                take(page[at:])
            break
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if closing:
            if tag == "a":
                link = 0
            elif tag in BLOCK:
                flush()
                if places := open_at.get(tag):
                    leave(places[-1])
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW or tag in RAW_IF_CLOSED:
            end = None if tag in unclosed else re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(page, at)
            if end is None:
                unclosed.add(tag)
            if end:
                at = end.end()
            elif tag in RAW and not attributes.endswith("/"):
                at = len(page)
        elif tag in VOID or tag in SPACED:
            if tag in SPACED:
                parts.append(" ")
            if tag == "hr":
                flush()
        elif tag == "a":
            link = 1
        elif tag in BLOCK:
            flush()
            if stack[-1].tag == "p" or tag in CLOSED_BY.get(stack[-1].tag, ()):
                leave(len(stack) - 1)
                if tag == "tr" and stack[-1].tag == "tr":
                    leave(len(stack) - 1)
            known = len(stack[-1].below)
            open_at.setdefault(tag, []).append(len(stack))
            parent = stack[-1]
            stack.append(parent.child(tag, element(tag, attributes)))
            paths.made += len(parent.below) - known
    flush()
    return out


@lru_cache(maxsize=100000)
def bucket(token: str, dim: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode())
    return h % dim, 1.0 if h & 0x10000 else -1.0


def vectors(found: list[Block], start: int = 0, stop: int | None = None) -> np.ndarray:
    """A row per block from start to stop."""
    stop = len(found) if stop is None else min(stop, len(found))
    out = np.zeros((max(0, stop - start), INPUT), dtype=np.float32)
    for r, b in enumerate(found[start:stop]):
        out[r, :PATH_DIM] = b.at.vector()
        words = b.text.split()
        n = len(words)
        marks = np.array([bucket(w, WORD_DIM) for w in b.text.lower().split()])
        out[r, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(marks[:, 0].astype(np.int64), weights=marks[:, 1], minlength=WORD_DIM) / n**0.5
        signs = sum(b.text.count(c) for c in ".,;!?")
        place = (start + r) / len(found)
        out[r, -MEASURES:] = (np.log1p(n) / 3, b.link, min(1.0, signs / n), b.text[-1] in ".!?", place, 1 - place, min(b.at.depth, 64) / 8, 1)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM with one output; params by name."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params

    @staticmethod
    def fresh(seed: int = 7) -> Labeller:
        rng = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.08, (INPUT, 4 * HIDDEN)).astype(np.float32)
            p[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        p["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        p["s"] = rng.normal(0, 0.05, INPUT).astype(np.float32)  # the block's own vector goes to the output too
        p["c"] = np.zeros(1, dtype=np.float32)
        return Labeller(p)

    def run(self, x: np.ndarray, mask: np.ndarray, d: str, state: list | None = None, kept: list | None = None) -> np.ndarray:
        """States of one direction; x: (steps, pages, INPUT) in reading order, mask: (steps, pages). state: [h, c] before the first
        step, replaced by that after the last; kept takes what the gradient needs of each step."""
        steps, n, _ = x.shape
        z = (x.reshape(steps * n, INPUT) @ self.p[f"x{d}"] + self.p[f"c{d}"]).reshape(steps, n, 4 * HIDDEN)
        state = [np.zeros((n, HIDDEN), dtype=np.float32) for _ in range(2)] if state is None else state
        h, c = state
        out = np.zeros((steps, n, HIDDEN), dtype=np.float32)
        for t in range(steps):
            a = z[t] + h @ self.p[f"h{d}"]
            gate = sigmoid(a[:, : 3 * HIDDEN])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if kept is not None:
                kept.append((h, c, i, f, o, g, tc, m))
            c, h = np.where(m, c2, c), np.where(m, o * tc, h)
            out[t] = h
        state[:] = h, c
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        kept_f, kept_b = [], []
        ahead = self.run(x, mask, "f", kept=kept_f)
        behind = self.run(x[::-1], mask[::-1], "b", kept=kept_b)
        both = np.concatenate([ahead, behind[::-1]], axis=2)
        return both @ self.p["o"] + x @ self.p["s"] + self.p["c"], (both, kept_f, kept_b)

    def gradient(self, x: np.ndarray, mask: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean logistic loss over blocks and its gradient, through time in both directions."""
        logit, (both, kept_f, kept_b) = self.forward(x, mask)
        count = mask.sum()
        prob = sigmoid(logit)
        loss = -(np.where(truth, np.log(prob + 1e-12), np.log(1 - prob + 1e-12)) * mask).sum() / count
        d = ((prob - truth) * mask / count).astype(np.float32)
        g = {"o": np.einsum("tn,tnh->h", d, both), "s": np.einsum("tn,tni->i", d, x), "c": d.sum(keepdims=True).reshape(1)}
        d_both = d[:, :, None] * self.p["o"]
        for name, kept, dh_all, xs in (("f", kept_f, d_both[:, :, :HIDDEN], x), ("b", kept_b, d_both[::-1, :, HIDDEN:], x[::-1])):
            steps, n, _ = xs.shape
            dz = np.zeros((steps, n, 4 * HIDDEN), dtype=np.float32)
            w, dw = self.p[f"h{name}"], np.zeros((HIDDEN, 4 * HIDDEN), dtype=np.float32)
            dh, dc = np.zeros((n, HIDDEN), dtype=np.float32), np.zeros((n, HIDDEN), dtype=np.float32)
            for t in range(steps - 1, -1, -1):
                h, c, i, f, o, gg, tc, m = kept[t]
                dh = dh + dh_all[t]
                dc2 = np.where(m, dc + dh * o * (1 - tc**2), 0)
                a = np.concatenate([dc2 * gg * i * (1 - i), dc2 * c * f * (1 - f), np.where(m, dh * tc, 0) * o * (1 - o), dc2 * i * (1 - gg**2)], axis=1)
                dz[t] = a
                dw += h.T @ a
                dh, dc = np.where(m, a @ w.T, dh), np.where(m, dc2 * f, dc)
            g[f"h{name}"], g[f"x{name}"], g[f"c{name}"] = dw, xs.reshape(-1, INPUT).T @ dz.reshape(-1, 4 * HIDDEN), dz.sum(axis=(0, 1))
        return float(loss), g

    def label(self, pages: list[list[Block]], cells: int = STEP_CELLS) -> list[np.ndarray]:
        """Which blocks of each page are content. Pages of like length are read side by side, `cells` blocks at a time."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= cells:
                end += 1
            part, at = [pages[i] for i in order[at:end]], end
            for i, logit in zip(order[at - len(part) : at], self.logits(part, cells)):
                out[i] = logit > 0
        return out

    def logits(self, pages: list[list[Block]], cells: int = STEP_CELLS) -> list[np.ndarray]:
        """Both directions over some pages, in steps of at most `cells` blocks that hand their states on."""
        longest, step = max(map(len, pages)), max(1, cells // len(pages))
        starts = list(range(0, longest, step))
        out = np.zeros((longest, len(pages)), dtype=np.float32)
        only = None

        def part(start: int) -> tuple[np.ndarray, np.ndarray]:
            return padded([vectors(p, min(start, len(p)), start + step) for p in pages])

        for d, half in (("f", self.p["o"][:HIDDEN]), ("b", self.p["o"][HIDDEN:])):
            state = [np.zeros((len(pages), HIDDEN), dtype=np.float32) for _ in range(2)]
            for start in starts if d == "f" else reversed(starts):
                x, mask = only or part(start)
                only = (x, mask) if len(starts) == 1 else None
                rows = slice(start, start + len(x))
                if d == "f":
                    out[rows] += self.run(x, mask, d, state) @ half + x @ self.p["s"] + self.p["c"]
                else:
                    out[rows] += (self.run(x[::-1], mask[::-1], d, state) @ half)[::-1]
        return [out[: len(p), col] for col, p in enumerate(pages)]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), INPUT), dtype=np.float32), np.zeros((steps, len(pages)), dtype=bool)
    for col, p in enumerate(pages):
        x[: len(p), col], mask[: len(p), col] = p, True
    return x, mask


def fit(pages: list[np.ndarray], truths: list[np.ndarray], epochs: int = 14, width: int = 48, rate: float = 0.01, seed: int = 11) -> Labeller:
    """Adam over batches of pages."""
    model, rng = Labeller.fresh(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(w) for k, w in model.p.items()}
    order, step = [i for i in range(len(pages)) if len(pages[i])], 0
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), width):
            part = order[at : at + width]
            x, mask = padded([pages[i] for i in part])
            truth = np.zeros(mask.shape, dtype=bool)
            for col, i in enumerate(part):
                truth[: len(truths[i]), col] = truths[i]
            _, grads = model.gradient(x, mask, truth)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            step += 1
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g**2
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# Words in tags, classes and ids by which training pages are labelled.
BOILERPLATE = set("ad ads advert advertisement sponsor sponsored promo banner nav navigation navbar menu breadcrumb breadcrumbs footer header masthead sidebar aside widget comment comments reply disqus cookie consent notice alert popup modal newsletter subscribe signup login form search share social related recommended copyright legal tags pagination".split())
WRAPPERS = ("<article>", "<main>", '<div class="content">', '<div class="post-body">', '<div id="article-body">', '<section class="entry-content">', '<div class="story">', '<main><article class="post">')
FURNITURE = (
    "<header><a href='/'>{a}</a><p>{b}</p></header>",
    "<aside><h3>{a}</h3><p>{b} {c}</p></aside>",
    '<div class="sidebar"><ul><li><a href="/x">{a}</a></li><li><a href="/y">{b}</a></li></ul></div>',
    '<div id="cookie-notice"><p>{c}</p></div>',
    '<div class="notice"><p>{b}. {c}</p></div>',
    '<form><p>{a}</p><label>{b}</label><input><button>{a}</button></form>',
    '<form class="newsletter"><p>{c}</p></form>',
    '<section id="comments"><h2>{a}</h2><div class="comment"><p>{c}</p></div><div class="comment"><p>{b} {c}</p></div></section>',
    '<div class="comments"><ul><li><p>{c}</p></li><li><p>{b}</p></li></ul></div>',
    '<div class="advert"><p>{c}</p></div>',
    '<div class="ad-banner">{b}</div>',
    '<div class="share social"><a href="/s">{a}</a> <a href="/t">{b}</a></div>',
    '<ul class="breadcrumbs"><li><a href="/">{a}</a></li><li>{b}</li></ul>',
    '<div class="related"><h3>{a}</h3><a href="/r">{b}</a></div>',
    '<div class="promo"><h3>{a}</h3><p>{c}</p></div>',
    '<nav class="menu"><a href="/m">{a}</a><a href="/n">{b}</a></nav>',
    "<footer><p>{b}</p><p>{c}</p></footer>",
)


def is_content(block: Block) -> bool:
    """The verdict that the elements around a block give, for training."""
    path = block.at.names()
    words = [w for el in path for w in el.split()]
    inside = {"article", "main", "content", "post", "entry", "story", "body"} & {w for el in path for w in el.split() if not el.startswith("body")}
    return bool(inside) and not any(w in BOILERPLATE for w in words)


_SECTION = re.compile(r"<(/?)(?:article|main|nav|header|footer|aside|section|form)\b[^>]*>", re.I)
_NAMED = re.compile(r"""\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", re.I)


def unnamed(page: str) -> str:
    """The page without telling names: the same blocks in plain divisions."""
    return _NAMED.sub("", _SECTION.sub(r"<\1div>", page))


def varied(page: str, r: random.Random) -> str:
    """The page with further furniture, and maybe another wrapper around its text."""
    body = re.sub(r"<[^>]*>", " ", page).split()

    def some(n: int) -> str:
        at = r.randrange(max(1, len(body)))
        return html.escape(" ".join(body[at : at + n])) or "more"

    if "<article" in page and r.random() < 0.7:
        opening = r.choice(WRAPPERS)
        closing = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
        page = re.sub(r"<article[^>]*>", lambda _: opening, page, count=1).replace("</article>", closing, 1)
    edges = [m.end() for m in re.finditer(r"</(?:p|nav|h1|div|article|main)>|<body[^>]*>", page)]
    for at in sorted(r.sample(edges, min(len(edges), r.randint(1, 4))), reverse=True):
        piece = r.choice(FURNITURE).format(a=some(2), b=some(r.randint(2, 9)), c=some(r.randint(8, 60)))
        page = page[:at] + piece + page[at:]
    return page


def training_pages(pages: DataFrame, train_pages: int = TRAIN_PAGES, train_chars: int = TRAIN_CHARS, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(id, html) of the pages that train() learns from."""
    rows = pages.select(F.col(id_column).alias("id"), F.col(html_column).alias("html")).where(F.length("html").between(1, train_chars))
    return common.least_by_hash(rows, train_pages, "id", "html").select("id", "html")


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, train_chars: int = TRAIN_CHARS, train_blocks: int = TRAIN_BLOCKS, id_column: str = "page_id", html_column: str = "html") -> Labeller:
    r, found, truths = random.Random(5), [], []
    for row in training_pages(pages, train_pages, train_chars, id_column, html_column).collect():  # train_pages rows
        for page in (row.html, varied(row.html, r), varied(row.html, r), None):
            if page is not None:
                got = blocks(page)[:train_blocks]
                truth = np.array([is_content(b) for b in got], dtype=bool)
                last = page
            else:  # the last one once more, its names gone
                plain = blocks(unnamed(last))[:train_blocks]
                if [b.text for b in plain] != [b.text for b in got]:
                    continue
                got = plain
            found.append(vectors(got)), truths.append(truth)
    return fit(found, truths)


def extract(pages: DataFrame, model: Labeller, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """The id column, the kept ones, text, n_chars, and n_blocks (all blocks of the page)."""
    spark = common.text_batches(pages.sparkSession)
    keep = tuple(c for c in keep if c in pages.columns)
    source = pages.select(id_column, *keep, F.col(html_column).alias("__quarry_html"))
    shared = spark.sparkContext.broadcast(model.p)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches):
        labeller, paths = Labeller(shared.value), Paths()
        for batch in common.slices(batches, "__quarry_html"):
            found = [blocks(p, paths) for p in common.texts(batch, "__quarry_html")]
            labels = labeller.label(found)
            text = ["\n".join(b.text for b, hit in zip(bs, x) if hit) for bs, x in zip(found, labels)]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([len(b) for b in found], pa.int64())], [id_column, *keep, "text", "n_chars", "n_blocks"])

    return source.mapInArrow(run, f"{kinds}, text string, n_chars long, n_blocks long")
