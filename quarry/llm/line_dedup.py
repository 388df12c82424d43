"""Line deduplication by winnowing over line hashes.

A document is the sequence of its lines that hold a word. A run of consecutive lines with `min_words` words or more that occurs
earlier - in a document with a smaller id, or further up in the same one - is deleted line by line; the first occurrence stays.

1. Select: the k-grams are the shortest line sequences with `gram_words` words, the windows the shortest with `min_words`; the
   k-gram of least hash in each window is a fingerprint. Equal windows share it, so each run that counts has a fingerprint. Texts are
   read once: what is stored of a document are its line hashes and its fingerprints' positions.
2. Join: the positions are joined with the fingerprints that occur more than once; others can't lie in a repeat. Each position that is
   left gets its context: the hashes of the lines of all windows that hold it. Of each fingerprint the first position is found.
3. Extend: every later position is paired with the first one of its fingerprint, never with all, and the match is extended both ways, line by
   line, as far as the two contexts agree. A window inside the match is a repeat, and its first occurrence is there: no earlier place has the
   fingerprint. What the first position can't tell are windows that go beyond the match. They may occur at another position of the
   fingerprint, where they go beyond the match as well; so they alone are hashed (128 bits) and meet each other, and the first stays.
4. Delete the lines of all repeats. Where a repeat overlaps its own first occurrence, the lines of that one stay. Windows are taken from each line
   onwards and backwards, which covers a repeated run exactly; a run of any length has fingerprints all along.

Nothing goes through the driver, at any size. Hot fingerprints and windows meet in partial aggregates, and in joins against a table with one
row for each, whose other side can be split; an occurrence is in one pair. Joins whose sides grow with the corpus are merge joins at
every size.

Cases: null and empty texts, and texts without a word, stay as they are. Lines are compared without white space at their ends.
Null ids come last in the order; of rows with the same id and text one is the first and the others are copies. Lines of any length are
whole units. A document all of whose lines go has the empty text and n_removed > 0. Input columns called n_lines or n_removed keep name and
values; the operator's own then take the name with as many underscores behind it as make it free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_WORDS, GRAM_WORDS = 50, 25


def lines_of(text: str | None) -> tuple[list[int], list[bytes], np.ndarray]:
    """(line numbers, 128-bit digests, word counts) of the lines that hold a word."""
    at, digests, counts = [], [], []
    for i, line in enumerate(text.encode().split(b"\n") if text else ()):
        if n := len(line.split()):
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(line.strip()))
            counts.append(n)
    return at, digests, np.array(counts, dtype=np.int64)


def reaches(counts: np.ndarray, least: int) -> np.ndarray:
    """For each line the end (exclusive) of the shortest sequence from it with so many words; past the end: len + 1."""
    total = np.concatenate([[0], np.cumsum(counts)])
    return np.searchsorted(total, total[:-1] + least)


def fingerprints(digests: list[bytes], counts: np.ndarray, min_words: int, gram_words: int) -> dict[int, int]:
    """The selected k-grams: start line to 64-bit hash."""
    n, out = len(digests), {}
    ends, windows = reaches(counts, gram_words), reaches(counts, min_words)
    grams = [xxhash.xxh3_64_intdigest(b"".join(digests[i:e])) if e <= n else None for i, e in enumerate(ends.tolist())]
    for i, w in enumerate(windows.tolist()):
        if w > n:
            break
        least = None
        for j in range(i, w):
            if ends[j] > w:
                break
            if least is None or grams[j] < grams[least]:
                least = j
        out[least] = grams[least]
    return out


def windows_with(counts: np.ndarray, at: int, end: int, min_words: int) -> list[tuple[int, int]]:
    """(start, end) of the windows, onwards and backwards, that hold the lines from at to end."""
    n = len(counts)
    forward, back = reaches(counts, min_words), n - reaches(counts[::-1], min_words)[::-1]
    first, last = int(np.searchsorted(forward, end)), int(np.searchsorted(back, at, side="right"))
    out = {(i, int(forward[i])): None for i in range(first, at + 1) if forward[i] <= n}
    out |= {(int(back[j]), j + 1): None for j in range(end - 1, last) if back[j] >= 0}
    return list(out)


def contexts_of(counts: np.ndarray, marks: list[int], min_words: int, gram_words: int) -> list[tuple[int, int]]:
    """For each marked fingerprint the lines [low, high) of all windows_with() it, from the ends of their ranges."""
    n, out = len(counts), []
    forward, back = reaches(counts, min_words), n - reaches(counts[::-1], min_words)[::-1]
    fit, short = int(np.searchsorted(forward, n, side="right")), int(np.searchsorted(back, 0))  # windows onwards before fit, backwards from short on
    for at, end in zip(marks, reaches(counts, gram_words)[marks].tolist()):
        first, to = int(np.searchsorted(forward, end)), min(at, fit - 1)
        since, last = max(end - 1, short), int(np.searchsorted(back, at, side="right"))
        spans = [(at, end)]
        if first <= to:
            spans.append((first, int(forward[to])))
        if since < last:
            spans.append((int(back[since]), last))
        out.append((min(a for a, _ in spans), max(b for _, b in spans)))
    return out


def extended(own: bytes, k: int, first: bytes, f: int) -> tuple[int, int]:
    """How many lines before k, and from k on, agree with those before and from f on. 16 bytes a line."""
    left, right, n, m = 0, 0, len(own) // 16, len(first) // 16
    while left < min(k, f) and own[16 * (k - left - 1) : 16 * (k - left)] == first[16 * (f - left - 1) : 16 * (f - left)]:
        left += 1
    while right < min(n - k, m - f) and own[16 * (k + right) : 16 * (k + right + 1)] == first[16 * (f + right) : 16 * (f + right + 1)]:
        right += 1
    return left, right


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def free(name: str, taken: list[str]) -> str:
    """The name with as many underscores as set it apart from the others, whatever their case: Spark does not tell names apart by it."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def sequences(source: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """Of each text with min_words words (id, node, text): the hashes of its lines, 16 bytes each, their word counts, and its fingerprints."""
    kind = source.schema["id"].dataType.simpleString()
    prints_t = pa.list_(pa.struct([("at", pa.int32()), ("h", pa.int64())]))

    def run(batches):
        for batch in common.slices(batches):
            row, lines, words, prints = [], [], [], []
            for r, text in enumerate(common.texts(batch)):
                _, digests, counts = lines_of(text)
                if counts.sum() >= min_words:
                    row.append(r), lines.append(b"".join(digests)), words.append(counts.astype(np.int32).tobytes())
                    prints.append([{"at": at, "h": signed(h)} for at, h in fingerprints(digests, counts, min_words, gram_words).items()])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(lines, pa.binary()), pa.array(words, pa.binary()), pa.array(prints, prints_t)], ["id", "node", "lines", "words", "prints"])

    return common.materialise(source.mapInArrow(run, f"id {kind}, node long, lines binary, words binary, prints array<struct<at:int,h:long>>"), "sequences")


def contexts(marked: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """(h, id, node, at, low, lines, words): the marked positions with the lines around them. marked: id, node, lines, words, marks."""
    kind = marked.schema["id"].dataType.simpleString()
    names = ["h", "id", "node", "at", "low", "lines", "words"]

    def run(batches):
        for batch in common.slices(batches, "lines"):
            row, h, at, low, around, sizes = [], [], [], [], [], []
            for r, (lines, words, marks) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))):
                counts = np.frombuffer(words, dtype=np.int32).astype(np.int64)
                for mark, (a, b) in zip(marks, contexts_of(counts, [m["at"] for m in marks], min_words, gram_words)):
                    row.append(r), h.append(mark["h"]), at.append(mark["at"]), low.append(a), around.append(lines[16 * a : 16 * b]), sizes.append(words[4 * a : 4 * b])
            take = pa.array(row, pa.int64())
            columns = [pa.array(h, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int32()), pa.array(low, pa.int32()), pa.array(around, pa.binary()), pa.array(sizes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return common.materialise(marked.select("id", "node", "lines", "words", "marks").mapInArrow(run, f"h long, id {kind}, node long, at int, low int, lines binary, words binary"), "contexts")


def runs(pairs: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """(id, node, s, e, h): of each position paired with its fingerprint's first, the lines that are repeats of that place (h null), and the windows
    that go beyond the match, with their hashes. pairs: id, node, at, low, lines, words, same (one text), f_at, f_low, f_lines."""
    kind = pairs.schema["id"].dataType.simpleString()
    columns = ["id", "node", "at", "low", "lines", "words", "same", "f_at", "f_low", "f_lines"]

    def run(batches):
        for batch in common.slices(batches, "lines"):
            row, start, end, digest = [], [], [], []
            for r, (at, low, lines, words, same, f_at, f_low, f_lines) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(2, 10)))):
                counts, k = np.frombuffer(words, dtype=np.int32).astype(np.int64), at - low
                left, right = extended(lines, k, f_lines, f_at - f_low)
                held = windows_with(counts, k, int(reaches(counts, gram_words)[k]), min_words)
                inside = [(s, e) for s, e in held if s >= k - left and e <= k + right]
                if same:
                    gone = {(max(s, e - (at - f_at)), e): None for s, e in inside}
                else:  # all hold the fingerprint, so together they are one run
                    gone = [(min(s for s, _ in inside), max(e for _, e in inside))] if inside else []
                for s, e in gone:
                    row.append(r), start.append(low + s), end.append(low + e), digest.append(None)
                for s, e in set(held).difference(inside):
                    row.append(r), start.append(low + s), end.append(low + e), digest.append(xxhash.xxh3_128_digest(lines[16 * s : 16 * e]))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(digest, pa.binary())], ["id", "node", "s", "e", "h"])

    return common.materialise(pairs.select(columns).mapInArrow(run, f"id {kind}, node long, s int, e int, h binary"), "runs")


def repeats(source: DataFrame, min_words: int, gram_words: int) -> DataFrame:
    """(id, node, gone): the line ranges [s, e), counted among the lines with a word, that go from each text. source: id, node, text."""
    texts = sequences(source, min_words, gram_words)
    places = texts.select("id", "node", F.inline("prints"))
    twice = common.materialise(places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "fingerprints")
    found = places.join(twice.hint("merge"), "h").groupBy(F.col("id").alias("i"), F.col("node").alias("k")).agg(F.collect_set(F.struct("at", "h")).alias("marks"))
    marked = texts.drop("prints").join(found.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("node") == F.col("k")))
    around = contexts(marked, min_words, gram_words)
    place = F.struct(F.col("id").isNull().alias("z"), "id", "node", "at")
    firsts = around.groupBy("h").agg(F.min(F.struct(place.alias("place"), "low", "lines")).alias("f"))
    firsts = common.materialise(firsts.select("h", "f.place", F.col("f.low").alias("f_low"), F.col("f.lines").alias("f_lines")), "firsts")
    pairs = around.join(firsts.hint("merge"), "h").where(~place.eqNullSafe(F.col("place")))
    same = F.col("id").eqNullSafe(F.col("place.id")) & (F.col("node") == F.col("place.node"))
    ran = runs(pairs.withColumns({"same": same, "f_at": F.col("place.at")}), min_words, gram_words)
    return ran.where("h IS NULL").select("id", "node", "s", "e").unionByName(beyond(ran.where("h IS NOT NULL"))).groupBy("id", "node").agg(F.collect_set(F.struct("s", "e")).alias("gone"))


def beyond(spots: DataFrame) -> DataFrame:
    """(id, node, s, e): of the hashed windows those that are not the first of their hash, without what overlaps the first."""
    place = F.struct(F.col("id").isNull().alias("z"), "id", "node", "s")
    first = spots.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("NOT (first <=> last)").select("h", "first")
    again = spots.join(common.materialise(first, "window_firsts").hint("merge"), "h").where(~place.eqNullSafe(F.col("first")))
    same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node"))
    begin = F.when(same, F.greatest("s", F.col("first.s") + F.col("e") - F.col("s"))).otherwise(F.col("s"))
    return again.select("id", "node", begin.alias("s"), "e")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, gram_words: int = GRAM_WORDS, id_column: str = "doc_id", text_column: str = "text", outputs: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All input columns, the text without its repeated runs, and n_lines, n_removed (lines with a word: all, deleted)."""
    common.text_batches(docs.sparkSession)
    since = common.mark()
    node = F.xxhash64(F.col(text_column))
    source = docs.select(F.col(id_column).alias("id"), node.alias("node"), F.col(text_column).alias("text"))
    gone = common.materialise(repeats(source, min_words, gram_words), "gone")
    common.release(since, gone)
    gone = gone.select(F.col("id").alias("__quarry_id"), F.col("node").alias("__quarry_at"), F.col("gone").alias("__quarry_gone"))
    keyed = docs.withColumn("__quarry_node", node)
    both = keyed.join(gone.hint("merge"), keyed[id_column].eqNullSafe(gone["__quarry_id"]) & (keyed["__quarry_node"] == gone["__quarry_at"]), "left")
    copies = docs.groupBy(F.col(id_column).alias("__quarry_c"), node.alias("__quarry_cn")).agg(F.count("*").alias("__quarry_n")).where("__quarry_n > 1")
    return removed(both, common.materialise(copies, "copies"), docs.columns, id_column, text_column, min_words, tuple(free(x, docs.columns) for x in outputs))


def removed(both: DataFrame, copies: DataFrame, out: list[str], id_column: str, text_column: str, min_words: int, outputs: tuple[str, str]) -> DataFrame:
    """Deletes the lines of `gone`; of rows that share id and text, all but one lose everything that a window covers. Which one stays is
    fixed by numbers that are written before they are compared; a group of copies is reduced to its least number by an aggregate."""
    first = F.lit(True)
    if copies.head(1):
        both = both.join(copies.hint("merge"), both[id_column].eqNullSafe(copies["__quarry_c"]) & (both["__quarry_node"] == copies["__quarry_cn"]), "left")
        again = common.materialise(both.where("__quarry_n IS NOT NULL").withColumn("__quarry_tag", F.monotonically_increasing_id()), "again")
        least = again.groupBy(F.col(id_column).alias("__quarry_l"), F.col("__quarry_node").alias("__quarry_ln")).agg(F.min("__quarry_tag").alias("__quarry_least"))
        again = again.join(least.hint("merge"), again[id_column].eqNullSafe(least["__quarry_l"]) & (again["__quarry_node"] == least["__quarry_ln"]))
        again = again.withColumn("__quarry_first", F.col("__quarry_tag") == F.col("__quarry_least"))
        names = [*out, "__quarry_gone", "__quarry_first"]
        both = both.where("__quarry_n IS NULL").withColumn("__quarry_first", first).select(names).unionByName(again.select(names))
        first = F.col("__quarry_first")
    given = both.select(*out, "__quarry_gone", first.alias("__quarry_first"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name in out)

    def delete(batches):
        for batch in common.slices(batches, text_column):
            names = batch.schema.names
            gone = batch.column(names.index("__quarry_gone")).to_pylist()
            firsts = batch.column(names.index("__quarry_first")).to_pylist()
            kept, n_lines, n_removed = [], [], []
            for text, runs, first in zip(common.texts(batch, text_column), gone, firsts):
                lines = text.split("\n") if text else []
                at = [i for i, line in enumerate(lines) if line.encode().split()]
                drop: set[int] = set()
                if not first and sum(len(lines[i].encode().split()) for i in at) >= min_words:
                    drop.update(at)
                for run in runs or ():
                    drop.update(at[run["s"] : run["e"]])
                n_lines.append(len(at)), n_removed.append(len(drop))
                if drop and len(drop) == len(at):
                    kept.append("")
                else:
                    kept.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
            cols = [pa.array(kept, pa.string()) if c == text_column else batch.column(names.index(c)) for c in out]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*out, *outputs])

    return given.mapInArrow(delete, f"{fields}, `{outputs[0]}` long, `{outputs[1]}` long")
