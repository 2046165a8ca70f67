"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of bytes other than ASCII white space and punctuation, A-Z lower-cased. Seeds of a test item are its n-grams, and n words of n + 1 in a row
without an inner one, so that a copy with every n-th word replaced, or a word put in after every second, meets one. A first pass counts in how many documents each seed occurs. Those in at most a share RARE
of the documents are used; the common others only where the item has fewer than SEEDS rare ones within PASSAGE words, and there all of them. So PASSAGE words in a row are always met, and so is an
edited copy unless all that it kept are common seeds beside many rare ones. Seeds found in a document are gathered by item and diagonal. A place is as wide as any alignment through its seeds that
could pass, and is aligned with the whole item unless it has too few of the item's words to pass. The score is that of the best local alignment as a share of the item's own. An alignment passes
with THRESHOLD of that, or with the score of PASSAGE words in a row, so that passages of long items count as well.

The benchmark is sent to all tasks in blocks of at most BLOCK_BYTES of text, so any benchmark size works; documents are read twice
for each block. Null and empty texts and items contain and match nothing. Items shorter than n words have one
n-gram of all their words. Rows with one doc_id give one result, the best; repeated items each have theirs. Rows without doc_id
are left out of contaminated()'s result, but decontaminate() judges each row by its own text, whatever its doc_id. Items without item_id count
as items without a name: decontaminate() uses them, contaminated() leaves them out. Empty tables give an empty result; extra columns are
ignored, or kept as they are. A text is looked at by one task as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netglean.llm import textkit

N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of an item's own score.
THRESHOLD = 0.5
#: Words in a row whose score is enough for an item of any length.
PASSAGE = 13
#: A seed in at most this share of the documents is rare.
RARE = 0.001
#: Rare seeds within PASSAGE words that do without the common ones.
SEEDS = 16
BLOCK_BYTES = 8_000_000


class Items:
    """A block of test items: ids, word hashes, and where each seed lies."""

    def __init__(self, ids: list[int], texts: list[str], n: int):
        w = textkit.Words(pa.array(texts, pa.string()), textkit.MARKS)
        self.ids, self.n = np.array([0 if i is None else i for i in ids], np.int64), n
        self.word, self.first = w.hash, w.first
        gram, self.item, at, self.reach = w.seeds(n)
        self.at = at - w.first[self.item]
        self.key, self.of = np.unique(gram, return_inverse=True)
        self.vocabulary, word = np.unique(self.word, return_inverse=True)
        self.holds = np.unique(np.repeat(np.arange(len(ids)), np.diff(self.first)) * len(self.vocabulary) + word)

    def lookup(self, gram: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in gram that key (sorted) holds, and where."""
        if not len(key) or not len(gram):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.zeros(1 << 22, bool)
        maybe[(key >> np.uint64(42)).astype(np.int64)] = True
        hit = np.flatnonzero(maybe[(gram >> np.uint64(42)).astype(np.int64)])
        at = np.minimum(np.searchsorted(key, gram[hit]), len(key) - 1)
        ok = key[at] == gram[hit]
        return hit[ok], at[ok]

    def choose(self, found: np.ndarray, docs: int, rare: float, most: int, passage: int) -> None:
        """Keeps the seeds that are rare, and the common ones of stretches of passage words (or of the item, if it is shorter) with fewer than most rare ones. found: in how many of docs documents each key occurs."""
        n = found[self.of]
        few = (n > 0) & (n <= rare * docs)
        length = np.diff(self.first)
        # windows of all items in one row: window x begins at word x of the block and lies within its item
        last = np.repeat(self.first[:-1] + np.maximum(length - passage, 0), length)
        begins, ends = self.first[self.item] + self.at, self.first[self.item] + self.at + self.reach
        ends = np.minimum(ends, self.first[self.item + 1])
        low = np.maximum(self.first[self.item], ends - passage)
        high = np.minimum(begins, last[begins])
        low = np.minimum(low, high)
        change = np.bincount(low[few], minlength=len(last) + 1) - np.bincount(high[few] + 1, minlength=len(last) + 1)
        needy = np.concatenate(([0], np.cumsum(np.cumsum(change)[: len(last)] < most)))
        keep = (n > 0) & (few | (needy[high + 1] > needy[low]))
        self.item, self.at = self.item[keep], self.at[keep]
        used, self.of = np.unique(self.of[keep], return_inverse=True)
        self.key = self.key[used]

    def promising(self, hashes: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which of the places low to high in the words hold so many words of their item that the score could be reached."""
        at, which = self.lookup(hashes, self.vocabulary)
        first, out = np.searchsorted(at, low), np.zeros(len(item), bool)
        n = np.searchsorted(at, high) - first
        total, a = np.cumsum(n), 0
        while a < len(item):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 2_000_000, "right")))
            place = np.repeat(np.arange(z - a), n[a:z])
            inside = np.arange(len(place)) - np.repeat(np.cumsum(n[a:z]) - n[a:z], n[a:z]) + np.repeat(first[a:z], n[a:z])
            pair = item[a:z][place] * len(self.vocabulary) + which[inside]
            held = self.holds[np.minimum(np.searchsorted(self.holds, pair), len(self.holds) - 1)] == pair
            out[a:z] = MATCH * np.bincount(place[held], minlength=z - a) >= need[a:z]
            a = z
        return out


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair of word sequences, and where in the text it ends; all pairs at once, row by row."""
    rows, cols = max(map(len, items)), max(map(len, texts))
    a, b = np.zeros((len(items), rows), np.uint64), np.zeros((len(items), cols), np.uint64)
    inside = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i, (x, y) in enumerate(zip(items, texts)):
        a[i, : len(x)], b[i, : len(y)] = x, y
        inside[0][i, : len(x)], inside[1][i, : len(y)] = True, True
    score = np.zeros((len(items), cols + 1), np.int32)
    best, end = np.zeros(len(items), np.int32), np.zeros(len(items), np.int32)
    slope = -GAP * np.arange(cols + 1, dtype=np.int32)
    for r in range(rows):
        pair = np.where((a[:, r : r + 1] == b) & inside[1] & inside[0][:, r : r + 1], MATCH, MISMATCH).astype(np.int32)
        new = np.zeros_like(score)
        new[:, 1:] = np.maximum(0, np.maximum(score[:, :-1] + pair, score[:, 1:] + GAP))
        new = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps along the text
        score = new
        top = score.max(axis=1)
        better = top > best
        end[better] = score[better].argmax(axis=1)
        best = np.maximum(best, top)
    return best, end


def finder(items: Items, threshold: float, passage: int) -> Callable[[pa.Array], tuple[np.ndarray, ...]]:
    """A function that finds, in a batch of texts, the rows, items, scores and ends (words) of all alignments that pass."""
    entry = np.argsort(items.of, kind="stable")
    key, first = items.key, np.append(np.searchsorted(items.of[entry], np.arange(len(items.key))), len(entry))
    length = np.diff(items.first)
    need = np.minimum(threshold * MATCH * length, MATCH * passage)
    # words that an alignment which passes can leave out or add
    loose = np.floor(MATCH * length - need).astype(np.int64)

    def find(texts: pa.Array) -> tuple[np.ndarray, ...]:
        w = textkit.Words(texts, textkit.MARKS)
        gram, rows, words, _ = w.seeds(items.n)
        hit, at = items.lookup(gram, key)
        if not len(hit):
            none = np.zeros(0, np.int64)
            return none, none, none.astype(float), none
        n = first[at + 1] - first[at]
        hit = np.repeat(hit, n)
        e = entry[np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)]
        item, at, row, hit = items.item[e], items.at[e], rows[hit], words[hit]
        left, right = at, length[item] - at
        low = np.maximum(hit - left - np.minimum(MATCH * left, loose[item]), w.first[row])
        high = np.minimum(hit + right + np.minimum(MATCH * right, loose[item]), w.first[row + 1])
        order = np.lexsort((hit - at, item, row))
        row, item, diagonal, low, high = (x[order] for x in (row, item, hit - at, low, high))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > length[item[1:]] // 2)
        begin = np.flatnonzero(new)
        row, item, low, high = row[begin], item[begin], np.minimum.reduceat(low, begin), np.maximum.reduceat(high, begin)
        ok = items.promising(w.hash, item, low, high, need[item])
        row, item, low, high = row[ok], item[ok], low[ok], high[ok]
        size = length[item]
        score, end = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        order = np.lexsort((high - low, size))
        a = 0
        while a < len(order):
            z = order[a : a + 256]
            while len(z) > 1 and len(z) * int((high[z] - low[z]).max()) > 4_000_000:
                z = z[: len(z) // 2]
            best, last = align([items.word[items.first[i] : items.first[i + 1]] for i in item[z]], [w.hash[x:y] for x, y in zip(low[z], high[z])])
            score[z], end[z] = best, low[z] - w.first[row[z]] + last
            a += len(z)
        ok = score >= need[item]
        return row[ok], item[ok], score[ok] / (MATCH * size[ok]), end[ok]

    return find


def frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many rows of docs each seed of items occurs, and the number of rows. Tasks count; what reaches the driver is a number for each seed of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rows, size = np.zeros(len(items.key), np.int64), 0, max(len(items.key), 1)
        for b in textkit.pieces(batches):
            rows += b.num_rows
            gram, row, _, _ = textkit.Words(b.column("text"), textkit.MARKS).seeds(items.n)
            hit, at = items.lookup(gram, items.key)
            n += np.bincount(np.unique(row[hit] * size + at) % size, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(n[some], rows))], ["seed", "n"])

    told = docs.select("text").mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    seed, n = (told.column(c).to_numpy() for c in ("seed", "n"))
    out = np.zeros(len(items.key), np.int64)
    out[seed[seed >= 0]] = n[seed >= 0]
    return out, int(n[seed < 0].sum())


def search(docs: DataFrame, items: Items, threshold: float, passage: int) -> DataFrame:
    find = finder(items, threshold, passage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textkit.pieces(batches):
            row, item, score, end = find(b.column("text"))
            if len(row):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(items.ids[item]), pa.array(score), pa.array(end)], ["doc_id", "item_id", "score", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, score double, end_word long")


def blocks(benchmark: DataFrame, n: int, most: int) -> Iterator[Items]:
    """The items in blocks of about most bytes of text, each of a range of item hashes."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // most)) if total > most else 1
    for i in range(parts):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).orderBy("item_id", "text").collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows], n)


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, passage: int = PASSAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score and end_word (of the passage) for each document and test item whose alignment reaches the threshold or the score of a passage."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id IS NOT NULL")
    out = None
    for items in blocks(benchmark.where("item_id IS NOT NULL"), n, block_bytes):
        items.choose(*frequencies(own, items), RARE, SEEDS, passage)
        found = search(own, items, threshold, passage)
        out = found if out is None else out.union(found)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("end_word")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.round("best.score", 6).alias("score"), (-F.col("best.back")).alias("end_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, passage: int = PASSAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows whose text holds a test item."""

    def clean(find: Callable[[pa.Array], tuple[np.ndarray, ...]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in textkit.pieces(batches):
                keep = np.ones(b.num_rows, bool)
                keep[find(b.column("text"))[0]] = False
                yield b.filter(pa.array(keep))

        return run

    given = docs
    for items in blocks(benchmark, n, block_bytes):
        items.choose(*frequencies(given, items), RARE, SEEDS, passage)
        docs = docs.mapInArrow(clean(finder(items, threshold, passage)), docs.schema)
    return docs
