"""Benchmark decontamination with a positional inverted index.

The corpus is indexed in blocks of whole documents, once for all test sets. Of each block the index has a row for every term, with the sorted
list of its word positions, and a row for its documents. It is stored as Parquet in the checkpoint folder, or where build_index() is told to.

Test windows come in chunks of bounded size, nearly always one, that every task can hold; each chunk is a search of its own. The stored lists'
lengths are the corpus frequencies of the windows' terms, and a window is sought by its rarest term: it is a candidate in the blocks that hold that
term and all its others. What a block's candidates ask for, (block, term) pairs, is all that is taken from the index: those lists meet the windows'
numbers by block, and offset-adjusted lists are intersected from the rarest term on. slop > 0 asks for proximity instead: the shortest word ranges that hold all of a window's terms, as often as it has them, in any
order, and are at most slop words longer than the window.

Words: A-Z lower-cased, runs of ASCII digits, letters and non-ASCII characters. A window is `window` consecutive words of an item; an
item of fewer words, but not none, is one window. The windows that one block is searched for are dealt into rows of bounded size, so that
any number of them works; sides are broadcast only behind a count.

Cases: null and empty texts have no words, hits or items. A null item id is written as the empty string; rows with the same item id
count as one item. Repeated documents and ids give a row each; a document lies in one block however long it is. Other columns of either
table do not matter.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of text in a block, and the words left free between two documents of one.
BLOCK_BYTES, GAP = 4 << 20, 1024
#: Windows that a block is searched for at a time.
WINDOWS_AT_ONCE = 20_000
#: Bytes of windows in a chunk, and what one takes besides its terms' bytes.
CHUNK_BYTES, WINDOW_BYTES = 16 << 20, 64

_MAP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_MAP).split() if text else []


def windows(item: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))] if item else []


INDEX_SCHEMA = "block long, doc_ids array<{id}>, n_words array<int>, term binary, n int, postings binary"


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """The stored index. Rows of documents have doc_ids and n_words, rows of terms have term, n and postings, the differences of the
    positions in as many bytes as each needs."""
    common.text_batches(docs.sparkSession)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        block = TaskContext.get().partitionId() << 33
        for batch in common.slices(batches, budget=BLOCK_BYTES):
            lengths, names, term = numbered(batch)
            bases = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64) + GAP)[:-1]])
            at = np.repeat(bases - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(len(term))
            at = at[np.argsort(term, kind="stable")]
            counts = np.bincount(term, minlength=len(names))
            ends = np.cumsum(counts)
            gaps = np.diff(at, prepend=0)
            gaps[ends[:-1]] = at[ends[:-1]]  # each list begins anew
            del term, at
            data, upto = packed(gaps)
            offsets = np.concatenate([[0], upto[ends - 1]]).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            ids_t, words_t, n = pa.list_(batch.column(0).type), pa.list_(pa.int32()), len(names)
            blocks, schema = pa.array([block] * (n + 1), pa.int64()), ["block", "doc_ids", "n_words", "term", "n", "postings"]
            yield pa.RecordBatch.from_arrays([blocks[:1], pa.array([batch.column(0).to_pylist()], ids_t), pa.array([lengths], words_t), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], schema)
            yield pa.RecordBatch.from_arrays([blocks[1:], pa.nulls(n, ids_t), pa.nulls(n, words_t), pa.array(names, pa.binary()), pa.array(counts, pa.int32()), lists], schema)
            block += 1

    rows = source.mapInArrow(run, INDEX_SCHEMA.format(id=kind))
    if path is None:
        return common.materialise(rows, "postings")
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def numbered(batch: pa.RecordBatch) -> tuple[list[int], list[bytes], np.ndarray]:
    """(words of each text, the sorted different words, the number of each word in the order of the texts). Words are objects for one text at a
    time; of all texts only the numbers are held."""
    number: dict[bytes, int] = {}
    lengths, parts = [], [np.zeros(0, dtype=np.int32)]
    for text in batch.column(batch.schema.get_field_index("text")):
        ws = words(text.as_py())
        lengths.append(len(ws))
        parts.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), dtype=np.int32, count=len(ws)))
    names = sorted(number)
    place = np.empty(len(names), dtype=np.int32)
    place[np.fromiter(map(number.__getitem__, names), dtype=np.int32, count=len(names))] = np.arange(len(names), dtype=np.int32)
    return lengths, names, place[np.concatenate(parts)]


def packed(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each number's end): seven bits a byte, lowest first, the top bit set on all but a number's last."""
    size = np.ones(len(gaps), dtype=np.int8)
    for k in range(1, 5):
        size += gaps >= 1 << 7 * k
    ends = np.cumsum(size, dtype=np.int64)
    out = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        out[ends[more] - size[more] + k] = (gaps[more] >> 7 * k & 127) | np.where(size[more] > k + 1, 128, 0)
    return out, ends


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(b < 128)
    if len(ends) == len(b):
        return b.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, starts)


class Lists:
    """Posting lists of one block."""

    none = np.zeros(0, dtype=np.int64)

    def __init__(self, terms: list[bytes], postings: list[bytes]):
        self.lists = {t: np.cumsum(unpacked(p)) for t, p in zip(terms, postings) if t is not None}

    def of(self, term: bytes) -> np.ndarray:
        return self.lists.get(term, self.none)


def phrase(lists: Lists, terms: list[bytes], rarest: int) -> np.ndarray:
    """Start positions of exact occurrences: candidates from the rarest term of all, thinned by each next rarest list of the block."""
    found = [lists.of(t) for t in terms]
    if not all(map(len, found)):
        return lists.none
    starts = found[rarest] - rarest
    for o in sorted(range(len(terms)), key=lambda i: len(found[i])):
        if not len(starts):
            break
        there = found[o]
        spot = np.minimum(np.searchsorted(there, starts + o), len(there) - 1)
        starts = starts[there[spot] == starts + o]
    return starts


def proximity(lists: Lists, terms: list[bytes], rarest: int, slop: int) -> list[tuple[int, int]]:
    """The shortest ranges [start, end) that hold the terms as often as the window does, of len(terms) + slop words at most. A range ends and
    begins with a term of the window, and none lies in another."""
    need, most = Counter(terms), len(terms) + slop
    anchors = lists.of(terms[rarest])
    for t in need:
        there = lists.of(t)
        anchors = anchors[np.searchsorted(there, anchors + most) - np.searchsorted(there, anchors - most) >= need[t]]
    if not len(anchors):
        return []
    marks = sorted({(int(p), t) for t in need for p in lists.of(t) if abs(anchors[min(np.searchsorted(anchors, p), len(anchors) - 1)] - p) < most or abs(anchors[max(np.searchsorted(anchors, p) - 1, 0)] - p) < most})
    out, have, missing, left = [], Counter(), len(terms), 0
    for end, (p, t) in enumerate(marks):
        have[t] += 1
        missing -= have[t] <= need[t]
        while have[marks[left][1]] > need[marks[left][1]]:
            have[marks[left][1]] -= 1
            left += 1
        if not missing:
            start = marks[left][0]
            if p + 1 - start <= most:
                while out and out[-1][0] >= start:
                    out.pop()
                if not out or out[-1][1] < p + 1:
                    out.append((start, p + 1))
            have[marks[left][1]] -= 1
            missing += 1
            left += 1
    return out


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_windows(tests: DataFrame, window: int, item_column: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(wid, terms) of the different windows, and (wid, item) of the items that hold them; both are stored."""
    source = tests.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).where(F.length("text") > 0)

    def run(batches):
        for batch in common.slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), common.texts(batch)):
                found = list(dict.fromkeys(windows(words(text), window)))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.list_(pa.binary()))], ["item", "terms"])

    every = common.materialise(source.mapInArrow(run, "item string, terms array<binary>"), "windows")
    distinct = common.materialise(every.select("terms").distinct().select(F.monotonically_increasing_id().alias("wid"), "terms"), "distinct")
    return distinct, common.materialise(every.join(distinct, "terms").select("wid", "item").distinct(), "owners")


class Windows:
    """A chunk of the test windows: terms by id, and by each term the windows of which it is the rarest, with its place."""

    def __init__(self, rows: list, frequency: dict[bytes, int]):
        self.terms = {r.wid: [bytes(t) for t in r.terms] for r in rows}
        self.by: dict[bytes, list[tuple[int, int]]] = {}
        for wid, terms in self.terms.items():
            if all(t in frequency for t in terms):  # others have a term that no text has
                place = min(range(len(terms)), key=lambda i: (frequency[terms[i]], i))
                self.by.setdefault(terms[place], []).append((wid, place))

    def met(self, there: set[bytes]) -> list[tuple[int, int]]:
        """(wid, place) of those all of whose terms a block has, sought from its rarest terms on."""
        return [(wid, place) for t in there & self.by.keys() for wid, place in self.by[t] if there.issuperset(self.terms[wid])]


def chunks(distinct: DataFrame) -> list[DataFrame]:
    """The windows in parts that fit in every task's memory; nearly always one."""
    size = distinct.agg(F.sum(F.octet_length(F.concat_ws("", F.transform("terms", lambda t: t.cast("string")))) + WINDOW_BYTES)).first()[0] or 0
    n = max(1, -(-size // CHUNK_BYTES))
    return [distinct.where(F.pmod(F.xxhash64("wid"), F.lit(n)) == k) for k in range(n)]


def candidates(index: DataFrame, chunk: DataFrame) -> tuple[DataFrame, DataFrame, Broadcast]:
    """(block, wid, place, term): a row for each window to be looked for in a block, with the place of its rarest term, and one for each term that
    those windows ask the block for; the lists' lengths say which term is rarest. Then the terms of the chunk, and its windows."""
    terms = common.materialise(chunk.select(F.explode("terms").alias("term")).distinct(), "terms")
    lists = common.materialise(of_terms(index, terms, "n"), "lists")
    frequency = {bytes(r.term): r.n for r in lists.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # of the chunk's terms
    shared = index.sparkSession.sparkContext.broadcast(Windows(chunk.collect(), frequency))

    def run(rows: pa.Table) -> pa.Table:
        windows = shared.value
        met = windows.met(set(rows["term"].to_pylist()))
        asked = list({t for wid, _ in met for t in windows.terms[wid]})
        none = [None] * len(asked)
        columns = [[wid for wid, _ in met] + none, [place for _, place in met] + none, [None] * len(met) + asked]
        return pa.table([pa.array([rows["block"][0].as_py()] * (len(met) + len(asked)), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary())))], ["block", "wid", "place", "term"])

    met = lists.select("block", "term").groupBy("block").applyInArrow(run, "block long, wid long, place int, term binary")
    return common.materialise(met, "met"), terms, shared


def of_terms(index: DataFrame, terms: DataFrame, *columns: str) -> DataFrame:
    """The index's rows of the given terms, those of one chunk (a stored table)."""
    few = F.broadcast(terms) if common.small_enough(terms, 64) else terms
    return index.where("term IS NOT NULL").select("block", "term", *columns).join(few, "term")


def search(index: DataFrame, chunk: DataFrame, slop: int) -> DataFrame:
    """(block, d, spans, wids): the word ranges of the d-th document of a block that are hit, and the windows that hit it."""
    met, terms, shared = candidates(index, chunk)
    slots = common.materialise(met.where("wid IS NOT NULL").groupBy("block").agg(F.ceil(F.count("*") / WINDOWS_AT_ONCE).alias("slots")), "slots")
    slots = F.broadcast(slots) if common.small_enough(slots, 16) else slots
    asked = common.materialise(met.where("wid IS NULL").select("block", "term"), "asked")
    asked = F.broadcast(asked) if common.small_enough(asked, 48) else asked
    dealt = met.where("wid IS NOT NULL").join(slots, "block").select("block", F.pmod(F.xxhash64("wid"), F.col("slots")).alias("slot"), "wid", "place")
    lists = of_terms(index, terms, "postings").join(asked, ["block", "term"]).select("block", F.lit(None).cast("array<int>").alias("n_words"), "term", "postings")
    lists = lists.unionByName(index.where("term IS NULL").select("block", "n_words", "term", "postings")).join(slots, "block")
    lists = lists.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), "n_words", "term", "postings")
    span_t, wid_t = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64())

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        spans: dict[int, list] = {}
        wids: dict[int, set] = {}
        if left.num_rows and right.num_rows:
            lists = Lists(right["term"].to_pylist(), right["postings"].to_pylist())
            (n_words,) = (x for x in right["n_words"].to_pylist() if x is not None)
            bases = np.concatenate([[0], np.cumsum(np.array(n_words, dtype=np.int64) + GAP)])
            for wid, place in zip(left["wid"].to_pylist(), left["place"].to_pylist()):
                ts = shared.value.terms[wid]
                hits = proximity(lists, ts, place, slop) if slop else [(s, s + len(ts)) for s in phrase(lists, ts, place).tolist()]
                for s, e in hits:
                    d = int(np.searchsorted(bases, s, side="right")) - 1
                    spans.setdefault(d, []).append((s - int(bases[d]), e - int(bases[d])))
                    wids.setdefault(d, set()).add(wid)
            common.give_back()
        merged = [[{"start": a, "end": b} for a, b in union(x)] for x in spans.values()]
        return pa.table([pa.array([key[0].as_py()] * len(spans), pa.int64()), pa.array(list(spans), pa.int32()), pa.array(merged, span_t), pa.array([sorted(wids[d]) for d in spans], wid_t)], ["block", "d", "spans", "wids"])

    both = dealt.groupBy("block", "slot").cogroup(lists.groupBy("block", "slot"))
    return common.materialise(both.applyInArrow(run, "block long, d int, spans array<struct<start:int,end:int>>, wids array<long>"), "hits")


def folded(spans: str) -> Column:
    """Sorted word ranges without overlaps: those found for one document in several rows."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def fold(done, s):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(s["start"] <= last["end"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.sort_array(F.flatten(F.collect_list(spans))), empty, fold)


def matches(index: DataFrame, tests: DataFrame, window: int = 10, slop: int = 0, item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document of a stored index: doc_id, n_words, n_hit (words inside a match), items (sorted ids), spans (word ranges of the matches)."""
    if slop and window + slop > GAP:
        raise ValueError(f"window and slop may be {GAP} words at most")
    since = common.mark()
    distinct, owners = item_windows(tests, window, item_column, item_text)
    hits, *more = [search(index, chunk, slop) for chunk in chunks(distinct)]
    for part in more:
        hits = hits.unionByName(part)
    items = hits.select("block", "d", F.explode("wids").alias("wid")).join(owners, "wid").groupBy("block", "d").agg(F.sort_array(F.collect_set("item")).alias("items"))
    spans = hits.groupBy("block", "d").agg(folded("spans").alias("spans"))
    found = common.materialise(spans.join(items, ["block", "d"]), "found")
    common.release(since, found)
    docs = index.where("term IS NULL").select("block", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("d", "x")).select("block", "d", F.col("x.doc_ids").alias("doc_id"), F.col("x.n_words").cast("long").alias("n_words"))
    side = F.broadcast(found) if common.small_enough(found, 1 << 10) else found
    out = docs.join(side, ["block", "d"], "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), spans.alias("spans"))


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = 10, slop: int = 0, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """matches() of documents that are indexed for it."""
    return matches(build_index(docs, id_column, text_column), tests, window, slop, item_column, item_text)


def drop_contaminated(docs: DataFrame, tests: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents in which no window of a test item occurs. Rows with the same id and the same 64-bit hash of the text share a verdict."""
    since = common.mark()
    node = F.xxhash64(text_column)
    tagged = docs.select(F.struct(F.col(id_column).alias("id"), node.alias("node")).alias("key"), F.col(text_column).alias("text"))
    hit = decontaminate(tagged, tests, window, id_column="key", text_column="text").where("n_hit > 0")
    hit = common.materialise(hit.select(F.col("doc_id.id").alias("__quarry_id"), F.col("doc_id.node").alias("__quarry_hit")).distinct(), "contaminated")
    common.release(since, hit)
    side = F.broadcast(hit) if common.small_enough(hit, 24) else hit
    keyed = docs.withColumn("__quarry_node", node)
    return keyed.join(side, keyed[id_column].eqNullSafe(side["__quarry_id"]) & (keyed["__quarry_node"] == side["__quarry_hit"]), "left_anti").select(*docs.columns)
