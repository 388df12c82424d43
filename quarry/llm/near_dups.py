"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is the sequence of its shingles of five words; each is labelled with its occurrence number, so that no two of a text are
equal. A sketch takes the least few labelled shingles under one hash function and keeps them in text order: two texts share it
if they share those shingles in the same order. Each sketch is a bucket key of its own. Long texts take 64 sketches of 8 shingles,
short ones 32 of 4; the two ranges overlap so far that every pair at the threshold is in one of them together.

Similarity is M / (a + b - M), a and b being the shingle counts and M the length of the longest common subsequence: the share of
common shingles that an order-preserving alignment keeps. As labelled shingles are unique, the alignment inside the band that the
threshold leaves is a longest increasing subsequence.

Keys of the same first text (the least node) are one bucket: near copies share many keys, and a text is in their bucket once, not once a
key. A text has at most 96 keys, so no bucket unites more. What shares a key shares its bucket.

Buckets are never expanded into all pairs. (1) Every text meets the bucket's first text, which is done with there; the links found give
classes. (2) In buckets whose other texts are of several classes, one text of each class meets one of each other class. (3) What classes are
left there meet text by text, but for the pairs that have met. Small buckets are joined, large ones compared in blocks: texts of which too
little occurs among those they meet are set aside at once, for the others matrix products count common shingles; texts of the
class with most shingles in a bucket meet only those of the others. So a bucket of many near copies and a few strangers costs their number
times the strangers', and one of texts with no more than a passage in common costs their length. No pair at the threshold that shares a sketch is lost.

Texts are nodes by 64-bit hash, so exact copies are one node however many they are. Hashes of different texts that fall together are found by
a second 64-bit hash with another seed, and those texts are hashed anew. A text's shingles are hashed once for all comparisons. Classes come from alternating
large-star and small-star steps.

Cases: null texts and texts without a word link to nothing; texts of one to four words have one shingle, all their words. Rows with
equal id or equal rows give a row each; null ids come last in the choice of a class's id.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD = 5, 0.8
#: (sketches, shingles in each) of long and short texts; long: LONG_FROM shingles or more, short: SHORT_TO or fewer.
LONG, SHORT = (64, 8), (32, 4)
LONG_FROM, SHORT_TO = 48, 80
#: Numbers of a hash matrix at a time.
CELLS = 1 << 21
CACHE_ENTRIES = 200_000
#: Buckets of up to so many texts are joined pair by pair where classes differ, larger ones compared in blocks of so many shingles.
SMALL_BUCKET, BLOCK_SHINGLES = 16, 200_000

_RNG = np.random.default_rng(20240229)
_MIX = _RNG.integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = _RNG.integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(0, 1 << 32, 64, dtype=np.uint64).astype(np.uint32)
_MUL = (_RNG.integers(0, 1 << 31, 64, dtype=np.uint64).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_SEED = _RNG.integers(0, 1 << 63, (2, 64), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    try:
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        if len(known) > CACHE_ENTRIES:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(text: str, known: dict[bytes, int]) -> np.ndarray:
    """Labelled shingle hashes in text order."""
    w = word_hashes(text.encode().split(), known)
    n = len(w)
    if n <= SHINGLE:
        h = (w * _MIX[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n) if n else w
    else:
        h = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
        for i in range(SHINGLE):
            h += w[i : n - SHINGLE + 1 + i] * _MIX[i]
        h += np.uint64(SHINGLE)
    h = mixed(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if same.any():
        start = np.concatenate([[0], np.where(same, 0, np.arange(1, len(s)))])
        nth = np.empty(len(s), dtype=np.uint64)
        nth[order] = np.arange(len(s)) - np.maximum.accumulate(start)
        h = np.where(nth > 0, mixed(h + nth * np.uint64(0xD1B54A32D192ED03)), h)
    return h


def sketches(h: np.ndarray) -> np.ndarray:
    """The bucket keys of a text's shingle hashes."""
    out = []
    x = (h >> np.uint64(32)).astype(np.uint32)
    for tier, (count, size) in enumerate((LONG, SHORT)):
        if len(h) < LONG_FROM if tier == 0 else len(h) > SHORT_TO:
            continue
        size = min(size, len(h))
        rows = max(1, CELLS // len(h))
        for at in range(0, count, rows):
            part = slice(at, min(count, at + rows))
            g = (x[None, :] ^ _XOR[part, None]) * _MUL[part, None]
            pick = np.argpartition(g, size - 1, axis=1)[:, :size] if size < len(h) else np.tile(np.arange(size), (g.shape[0], 1))
            pick.sort(axis=1)
            out.append(mixed((h[pick] * _ORDER[:size]).sum(axis=1, dtype=np.uint64) ^ _SEED[tier, part]))
    return np.concatenate(out).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """The similarity of two labelled sequences; 0 where it can be seen to lie below the threshold."""
    both = len(a) + len(b)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    need = threshold * both / (1 + threshold) - 1e-9
    if len(i) < need:
        return 0.0
    band = both - 2 * need
    near = np.abs(i - j) <= band
    j = j[near][np.argsort(i[near])]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        m = len(tails)
    else:
        m = len(j)
    return m / (both - m)


_HAS_WORD = r"[^ \t\n\x0B\f\r]"


def hashed(text: str, salt: int = 0) -> Column:
    """The node of a text column: null where there is no word. salt: how often its hash has fallen together with that of another text.
    xxhash64 takes the hash of each argument as the seed of the next, so the salt stands first: behind the text it would add nothing."""
    return F.when(F.regexp_like(text, F.lit(_HAS_WORD)), F.xxhash64(F.lit(salt), text) if salt else F.xxhash64(text))


def checked(text: str) -> Column:
    """A hash of a text column that does not follow from hashed()."""
    return F.xxhash64(F.lit("check"), text)


def collisions(df: DataFrame, text: str) -> list[DataFrame]:
    """For each salt, the nodes that stand for several texts; nearly always none at all."""
    out: list[DataFrame] = []
    while True:
        found = with_nodes(df.select(text), text, "node", out).where("node IS NOT NULL").groupBy("node")
        found = found.agg(F.min(checked(text)).alias("a"), F.max(checked(text)).alias("b")).where("a < b")
        found = common.materialise(found.select("node"), "collisions")
        if not found.head(1):
            return out
        out.append(found)


def with_nodes(df: DataFrame, text: str, name: str, fallen: list[DataFrame]) -> DataFrame:
    """df with the node of its text. fallen: what collisions() gave."""
    df = df.withColumn(name, hashed(text))
    for salt, found in enumerate(fallen, 1):
        side = found.select(F.col("node").alias("__quarry_fallen"))
        side = F.broadcast(side) if common.small_enough(found, 16) else side
        again = df.join(side, df[name] == side["__quarry_fallen"], "left")
        df = again.withColumn(name, F.when(F.col("__quarry_fallen").isNotNull(), hashed(text, salt)).otherwise(F.col(name))).drop("__quarry_fallen")
    return df


def sketch(texts: DataFrame) -> DataFrame:
    """(key, node, n): the bucket keys of each text with its shingle count. Copies inside a task are taken once."""

    def run(batches):
        known: dict[bytes, int] = {}
        done: set[int] = set()
        for batch in common.slices(batches):
            keys, nodes, sizes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
            for n, text in zip(batch.column(0).to_pylist(), common.texts(batch)):
                if n in done:
                    continue
                done.add(n)
                h = shingles(text, known)
                k = sketches(h)
                keys.append(k), nodes.append(np.full(len(k), n)), sizes.append(np.full(len(k), min(len(h), 1 << 30), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, sizes)], ["key", "node", "n"])

    return texts.where("node IS NOT NULL").mapInArrow(run, "key long, node long, n int")


def hashes_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, h): the labelled shingle hashes, 8 bytes each, of a materialised table of nodes."""
    few = F.broadcast(nodes) if common.small_enough(nodes, 16) else nodes
    found = texts.join(few, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, known).tobytes() for t in common.texts(batch)], pa.binary())], ["node", "h"])

    return common.materialise(found.select("node", "text").mapInArrow(run, "node long, h binary"), "hashes")


def verify(pairs: DataFrame, hashes: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose alignment reaches the threshold. b's hashes are fetched first, so that those of an a in very many pairs are
    put beside them only in the last join."""
    right = pairs.join(hashes.select(F.col("node").alias("b"), F.col("h").alias("right_h")), "b")
    both = right.join(hashes.select(F.col("node").alias("a"), F.col("h").alias("left_h")), "a")

    def run(batches):
        last, h = None, None
        for batch in common.slices(batches, "right_h"):
            hit = []
            for r in range(batch.num_rows):
                if batch.column(0)[r] != last:
                    last, h = batch.column(0)[r], np.frombuffer(batch.column(2)[r].as_py(), dtype=np.uint64)
                if similarity(h, np.frombuffer(batch.column(3)[r].as_py(), dtype=np.uint64), threshold) >= threshold - 1e-12:
                    hit.append(r)
            take = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    return common.materialise(both.select("a", "b", "left_h", "right_h").mapInArrow(run, "a long, b long"), "links")


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b): root is the least node of the component."""
    edges, before = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), None
    while True:
        way = edges.union(edges.select("v", "u"))
        least = way.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = way.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = common.materialise(small, "components")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = tuple(state)


def buckets(rows: DataFrame) -> DataFrame:
    """(key, node, n): the texts that share a sketch with the text `key` where that is the least of all that have the sketch; without that
    text itself. rows: what sketch() gives."""
    shared = rows.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").drop("last")
    own = rows.join(shared, "key").where("node <> first").select(F.col("first").alias("key"), "node", "n")
    return common.materialise(own.distinct(), "buckets")


def classes(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of the nodes that are linked to another. texts: node, text."""
    rows = buckets(common.materialise(sketch(texts), "sketches"))
    star = rows.select(F.col("key").alias("a"), F.col("node").alias("b"))
    nodes = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    hashes = hashes_of(common.materialise(nodes, "candidates"), texts)
    found = common.materialise(connected(verify(star, hashes, threshold)), "classes")

    def labelled(of: DataFrame) -> DataFrame:
        return of.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def mixed(of: DataFrame, more: str = "true") -> DataFrame:
        """The rows of buckets that hold several classes, with the bucket's size. more: what else must hold of the bucket."""
        several = of.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("c"), F.min("rep").alias("p0")).where(f"r0 < r1 AND {more}").select("key", "c")
        return common.materialise(of.join(several, "key"), "mixed")

    def merged(links: list[DataFrame]) -> DataFrame:
        joined = found.select(F.col("root").alias("a"), F.col("node").alias("b"))
        for more in links:
            joined = joined.union(more)
        return common.materialise(connected(joined), "classes")

    # The first of each class in its bucket meets those of the other classes.
    own = labelled(rows)
    firsts = own.groupBy("key", "root").agg(F.min(F.struct("node", "n")).alias("m")).select("key", "root", "m.*", F.lit(1).alias("rep"))
    reps = mixed(firsts)
    links = apart(reps, hashes, star, threshold)
    if links:
        found = merged(links)
    # Then texts of classes of which more than the first are in the bucket.
    marks = firsts.select("key", "node", F.lit(1).alias("rep"))
    crowd = labelled(rows.join(marks, ["key", "node"], "left").withColumn("rep", F.coalesce("rep", F.lit(0))))
    crowd = mixed(crowd, "p0 = 0")
    links = apart(crowd, hashes, star, threshold)
    return merged(links) if links else found


def apart(rows: DataFrame, hashes: DataFrame, met: DataFrame, threshold: float) -> list[DataFrame]:
    """Links between texts of different classes that share a bucket, but for the pairs in `met`. rows: key, node, n, root, c (the bucket's
    texts)."""
    if not rows.head(1):
        return []
    small, large = rows.where(F.col("c") <= SMALL_BUCKET), rows.where(F.col("c") > SMALL_BUCKET)
    left, right = (small.select("key", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("root").alias(f"r_{x}")) for x in "ab")
    long_enough = (F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a"))
    cross = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("r_a") != F.col("r_b")) & long_enough).select("a", "b")
    cross = common.materialise(cross.distinct().join(met, ["a", "b"], "left_anti"), "cross")
    out = [verify(cross, hashes, threshold)] if cross.head(1) else []
    if large.head(1):
        out.append(common.materialise(alike(large, hashes, threshold).distinct(), "links"))
    return [links for links in out if links.head(1)]


class Forest:
    """Components of numbered things, joined one link at a time."""

    def __init__(self, labels: np.ndarray):
        _, first, self.of = np.unique(labels, return_index=True, return_inverse=True)
        self.up = list(range(len(first)))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def labels(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))], dtype=np.int64)[self.of]

    def join(self, a: int, b: int) -> None:
        self.up[self.find(self.of[a])] = self.find(self.of[b])

    def apart(self, a: int, b: int) -> bool:
        return self.find(self.of[a]) != self.find(self.of[b])


def dealt(rows: DataFrame) -> DataFrame:
    """Large buckets cut into pairs of blocks of bounded length. Side 0 are the texts of the class with most shingles in the bucket, side 1
    the others: blocks of side 0 meet those of side 1, which meet each other too. (key, i, j, own, node, root); i < 0 stands for side 0."""
    whole = rows.groupBy("key", "root").agg(F.sum("n").alias("length"))
    top = whole.groupBy("key").agg(F.max(F.struct("length", "root")).alias("top"), F.sum("length").alias("total"))
    blocks = [F.ceil(x / BLOCK_SHINGLES).cast("int") for x in (F.col("top.length"), F.col("total") - F.col("top.length"))]
    sides = top.select("key", F.col("top.root").alias("top"), blocks[0].alias("b0"), blocks[1].alias("b1"))
    rows = rows.join(sides, "key").withColumn("side", (F.col("root") != F.col("top")).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1"))).cast("int"))
    own, minus = F.col("own"), (-F.col("own") - 1)
    with_top = F.transform(F.sequence(F.lit(0), F.col("b0") - 1), lambda k: F.struct((-k - 1).alias("i"), own.alias("j")))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("b1") - 1), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    from_top = F.transform(F.sequence(F.lit(0), F.col("b1") - 1), lambda k: F.struct(minus.alias("i"), k.alias("j")))
    pairs = F.when(F.col("side") == 0, from_top).otherwise(F.concat(with_top, with_rest))
    out = rows.select("key", F.explode(pairs).alias("p"), F.when(F.col("side") == 0, minus).otherwise(own).alias("own"), "node", "root")
    return out.select("key", "p.i", "p.j", "own", "node", "root")


def sides(number: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> tuple:
    """What is left to compare between the left and right texts (masks: the same, or apart): for each side its texts with the row and
    column of each of their shingles in an incidence matrix, and the number of columns, shingles that both sides hold. A text of which
    less than the threshold occurs among those it meets reaches it with none, whatever their length: it is set aside, and what it alone
    has shared with a text counts no more for that. number: the shingles of all texts, one text after the other."""
    owner, same = np.repeat(np.arange(len(sizes)), sizes), np.array_equal(left, right)
    while True:
        held = [np.bincount(number[of[owner]], minlength=int(number.max(initial=-1)) + 1) for of in (left, right)]
        met = [n > same for n in held[::-1]]
        kept = [of & (np.bincount(owner, at[number], len(sizes)) >= threshold * sizes - 1e-6) for of, at in zip((left, right), met)]
        if all((a == b).all() for a, b in zip(kept, (left, right))):
            break
        left, right = kept
    both = met[0] & met[1]
    column = np.where(both, np.cumsum(both) - 1, -1)[number]
    out = []
    for of in (left, right):
        inside = of[owner] & (column >= 0)
        out.append((np.flatnonzero(of), ((np.cumsum(of) - 1)[owner[inside]], column[inside])))
    return *out, int(both.sum())


def alike(rows: DataFrame, hashes: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between texts of different classes in large buckets. Each pair of blocks is one product of two incidence matrices, which
    counts common shingles; an alignment can't match more. What may reach the threshold is aligned at once, unless links found before join
    the two texts: no more links are written out than join classes."""

    def compare(group: pa.Table) -> pa.Table:
        node, root, own = (group[c].to_numpy() for c in ("node", "root", "own"))
        sets = [np.frombuffer(h, dtype=np.uint64) for h in group["h"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        (lefts, x), (rights, y), width = sides(number, sizes, own == i, own == j, threshold)
        forest, links = Forest(root), []
        label = forest.labels()
        step = max(1, CELLS // max(1, width))

        def incidence(of: tuple[np.ndarray, np.ndarray], at: int, rows: int) -> np.ndarray:
            out = np.zeros((rows, width), dtype=np.float32)
            part = slice(*np.searchsorted(of[0], (at, at + rows)))
            out[of[0][part] - at, of[1][part]] = 1
            return out

        for at in range(0, len(rights), step):
            part = rights[at : at + step]
            theirs = incidence(y, at, len(part))
            for start in range(0, len(lefts), step):
                mine = lefts[start : start + step]
                different = label[mine][:, None] != label[part][None, :]
                if not different.any():
                    continue
                shared = incidence(x, start, len(mine)) @ theirs.T
                both = sizes[mine][:, None] + sizes[part][None, :]
                hit = (shared >= threshold * (both - shared) - 1e-6) & different
                before = len(links)
                for u, v in zip(*(x.tolist() for x in np.nonzero(hit))):
                    a, b = mine[u], part[v]
                    if forest.apart(a, b) and similarity(sets[a], sets[b], threshold) >= threshold - 1e-12:
                        forest.join(a, b)
                        links.append((a, b))
                label = forest.labels() if len(links) > before else label
        if group.nbytes > 2 * common.SLICE_BYTES:  # what a small group has used is little, and there may be thousands
            common.give_back()
        a, b = (node[[x[k] for x in links]] if links else np.zeros(0, dtype=np.int64) for k in (0, 1))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt(rows).join(hashes, "node").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def members(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", fallen: list[DataFrame] | None = None) -> DataFrame:
    """A row per document: id, node, class_id (the least id of its class) and rep (the id and node of the row that stays)."""
    common.text_batches(docs.sparkSession)
    since = common.mark()
    fallen = collisions(docs, text_column) if fallen is None else fallen
    source = with_nodes(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "text", "node", fallen)
    found = classes(source.select("node", "text"), threshold)
    common.release(since, found, *fallen)
    own = F.struct(F.col("id").isNull().alias("z"), "id", "node")
    firsts = source.where("node IS NOT NULL").groupBy("node").agg(F.min(own).alias("own")).join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = common.materialise(firsts, "firsts")
    reps = firsts.groupBy("root").agg(F.min("own").alias("rep"))
    of = firsts.join(reps, "root").select("node", "rep")
    out = source.select("id", "node").join(of, "node", "left")
    return out.select("id", "node", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("rep.id")).alias("class_id"), "rep")


def near_dup_classes(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, class_id): one row per document."""
    return members(docs, threshold, id_column, text_column).select(F.col("id").alias(id_column), "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without all but one of each class (the one of least id stays)."""
    fallen = collisions(docs, text_column)
    rows = common.materialise(members(docs, threshold, id_column, text_column, fallen).where("node IS NOT NULL"), "members")
    is_rep = F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("node") == F.col("rep.node"))
    drop = common.materialise(rows.where(~is_rep).select(F.col("id").alias("__quarry_id"), F.col("node").alias("__quarry_drop")).distinct(), "dropped")
    twice = common.materialise(rows.where(is_rep).groupBy(F.col("id").alias("__quarry_id"), F.col("node").alias("__quarry_drop")).count().where("count > 1").drop("count"), "repeated")
    keyed = with_nodes(docs, text_column, "__quarry_node", fallen)

    def without(side: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(side) if common.small_enough(side, 24) else side
        return keyed.join(side, keyed[id_column].eqNullSafe(side["__quarry_id"]) & (keyed["__quarry_node"] == side["__quarry_drop"]), how)

    kept = without(drop, "left_anti")
    if twice.head(1):  # equal rows that are their class's first: one stays
        kept = without(drop.union(twice), "left_anti").unionByName(without(twice, "left_semi").dropDuplicates([id_column, "__quarry_node"]))
    return kept.select(*docs.columns)
