"""Removal of repeated 100-byte strings by a hash-compared suffix sort.

A suffix is a window's start in a document's UTF-8 bytes; only its first `length` bytes count. Windows are dealt by the
least hash of the SEED-byte strings in them, which equal windows share. Consecutive windows with one least hash
travel as one segment of text.

1. Seeds: each batch announces its segments' seeds, once each; those met more than once, be it in one segment, are shared, and their segments may repeat.
2. Documents with shared seeds send the segments of these. Within a batch, equal segments are sent once, as the earliest; the others are
   removed at once. Segments of a seed that more than HOT segments have are sent as single windows, dealt by
   the whole window, so that a passage in every document isn't one group.
3. Each bucket sorts its suffixes: by first eight bytes, then by mergesort. Two suffixes are compared by the length
   that they have in common, which binary search finds with the prefix polynomial hashes of the bucket's text, in logarithmically many
   steps, and by the byte that follows. All neighbours of the result are then compared byte by byte; a group with two in
   wrong order, or with equal hashes of different bytes, is sorted again by its bytes, so a collision of hashes has no
   effect. Of equal suffixes all but the earliest are marked.
4. The marked windows of a document, united, are what is removed.

Null and short texts lose nothing. Rows with one doc_id and one text are one document, repeated, and have equal results; different texts of one doc_id are documents of their
own, in the order of their hashes. A long text is a document like others, worked on as a whole. A row without a doc_id
has no place in the order: it loses nothing and nothing is removed because of it. Windows never cross documents. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netglean.llm import textkit
from netglean.llm.shared import buckets, forget, save

LENGTH, SEED = 100, 24
#: Segments that a batch gathers before it announces their seeds, and seeds in a bucket.
FLUSH, BUCKET = 1_000_000, 400_000
#: Bytes of segments that a batch gathers before it sends them, and in a bucket.
SEND_BYTES, BUCKET_BYTES = 6_000_000, 3_000_000
#: A seed of more segments than this is dealt by whole windows.
HOT = 50_000


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all prefixes, and the powers that bring a difference to its place."""
    up, down = textkit.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(textkit._BYTE[data] * up[: len(data)], out=total[1:])
    return total, down


class Segments:
    """Runs of windows with one least seed: row, first window (byte position), number of windows, seed, and ordinal within the row.

    With weigh, also weight: 2 for a segment that holds its seed more than once and so may repeat itself, else 1.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int, seed: int, weigh: bool = False):
        self.data, self.off = data, off
        count = np.maximum(np.diff(off) - length + 1, 0)
        rows = np.repeat(np.arange(len(count)), count)
        none = np.zeros(0, np.int64)
        self.row = self.start = self.count = self.ordinal = none
        self.seed, self.weight = none.view(np.uint64), none
        if not len(rows):
            return
        total, down = prefix_hashes(data)
        low = own = textkit.mix((total[seed:] - total[:-seed]) * down[: len(data) - seed + 1])
        want, span = length - seed + 1, 1
        while span * 2 <= want:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if want > span:
            low = np.minimum(low[: span - want], low[want - span :])
        first = np.concatenate(([0], np.cumsum(count)))
        at = np.arange(first[-1]) + np.repeat(off[:-1] - first[:-1], count)
        low = low[at]
        new = np.concatenate(([True], (low[1:] != low[:-1]) | (rows[1:] != rows[:-1])))
        begin = np.flatnonzero(new)
        self.row, self.start, self.seed = rows[begin], at[begin], low[begin]
        self.count = np.diff(np.append(begin, len(at)))
        if weigh:
            left = np.full(len(begin), -1)
            right, last = left.copy(), self.start + self.count - 1
            for i in range(want):  # the leftmost seed of the first window, the rightmost of the last
                left[(own[self.start + i] == self.seed) & (left < 0)] = i
                right[own[last + i] == self.seed] = i
            self.weight = 1 + (self.start + left != last + right)
        self.ordinal = np.arange(len(begin)) - np.searchsorted(self.row, np.arange(len(count)))[self.row]


def groups(key: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values, with the end."""
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count of them, for each start, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def by_document(doc: np.ndarray, *columns: np.ndarray) -> tuple[list[int], list[list[bytes]]]:
    """Documents, and of each column the bytes of each document's entries."""
    order = np.argsort(doc, kind="stable")
    cut = groups(doc[order])
    columns = [c[order] for c in columns]
    return doc[order][cut[:-1]].tolist(), [[c[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])] for c in columns]


def shared_seeds(docs: DataFrame, length: int, seed: int, n_buckets: int, hot: int) -> DataFrame:
    """doc_id and bytes of ordinals (int32) of segments with a shared seed; those of hot seeds are negative, -1 for ordinal 0. A document may have several rows."""

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            key, doc, ordinal, weight = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(key, kind="stable")
            cut = groups(key[order])
            n = np.diff(cut)
            key, size = key[order][cut[:-1]], np.add.reduceat(weight[order], cut[:-1])
            # all segments of a seed are sent with their first one's bucket; only one entry per seed and batch counts
            where = np.repeat((key % np.uint64(n_buckets)).astype(np.int64), n)
            which = np.repeat(np.arange(len(n)), n)
            doc, ordinal = doc[order], ordinal[order]
            back = np.lexsort((ordinal, doc, where))
            cuts = groups(where[back])
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                x = back[a:b]
                w = np.unique(which[x])
                rows.append((int(where[x[0]]), key[w].tobytes(), size[w].astype(np.int32).tobytes(), np.searchsorted(w, which[x]).astype(np.int32).tobytes(), doc[x].tobytes(), ordinal[x].astype(np.int32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6))], ["bucket", "seed", "size", "of", "doc", "ordinal"])

        gathered = 0
        for b in textkit.pieces(batches):
            ids = b.column("doc_id").to_numpy()
            s = Segments(*textkit.utf8(b.column("text")), length, seed, weigh=True)
            held.append((s.seed, ids[s.row], s.ordinal, s.weight))
            gathered += len(s.seed)
            if gathered >= FLUSH:
                yield flush()
                gathered = 0
        if gathered:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        key, size, of, doc, ordinal = [], [], [], [], []
        base = 0
        for row in table.to_pylist():
            k = np.frombuffer(row["seed"], np.uint64)
            key.append(k)
            size.append(np.frombuffer(row["size"], np.int32))
            of.append(np.frombuffer(row["of"], np.int32) + base)
            doc.append(np.frombuffer(row["doc"], np.int64))
            ordinal.append(np.frombuffer(row["ordinal"], np.int32))
            base += len(k)
        key, size, of, doc, ordinal = map(np.concatenate, (key, size, of, doc, ordinal))
        _, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, size).astype(np.int64)[at][of]
        shared = total > 1
        mark = np.where(total > hot, -1 - ordinal, ordinal).astype(np.int32)
        ids, (marks,) = by_document(doc[shared], mark[shared])
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "marks": pa.array(marks, pa.binary())})

    sent = docs.mapInArrow(announce, "bucket int, seed binary, size binary, of binary, doc binary, ordinal binary")
    return sent.groupBy("bucket").applyInArrow(meet, "doc_id long, marks binary")


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which pairs of positions have the same bytes for their length."""
    out = np.ones(len(a), bool)
    step = max(1, 4_000_000 // int(length.max(initial=1)))
    for x in range(0, len(a), step):
        n = length[x : x + step]
        p, q = ranges(a[x : x + step], n), ranges(b[x : x + step], n)
        out[x : x + step] = np.minimum.reduceat(data[p] == data[q], np.cumsum(n) - n)
    return out


def compare_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 for each pair of positions, by their first length bytes."""
    out = np.zeros(len(a), np.int8)
    offset, step = np.arange(length), max(1, 4_000_000 // length)
    for x in range(0, len(a), step):
        p, q = data[a[x : x + step, None] + offset], data[b[x : x + step, None] + offset]
        differ = p != q
        at = differ.argmax(axis=1)
        row = np.arange(len(at))
        out[x : x + step] = np.where(differ[row, at], np.where(p[row, at] < q[row, at], -1, 1), 0)
    return out


class SuffixSort:
    """Sorts suffixes of data (positions) by their first length bytes, ties in their given order."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.total, self.down = prefix_hashes(data)

    def hash(self, at: np.ndarray, n) -> np.ndarray:
        return (self.total[at + n] - self.total[at]) * self.down[at]

    def same(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.hash(p, self.length) == self.hash(q, self.length)

    def compare(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair."""
        out = np.zeros(len(p), np.int8)
        todo = np.flatnonzero(~self.same(p, q))
        p, q = p[todo], q[todo]
        low, high = np.zeros(len(p), np.int64), np.full(len(p), self.length - 1)  # the common extension's length lies between
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            yes = self.hash(p, mid) == self.hash(q, mid)
            low, high = np.where(open_ & yes, mid, low), np.where(open_ & ~yes, mid - 1, high)
        out[todo] = np.where(self.data[p + low] < self.data[q + low], -1, 1)
        return out

    def sort(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """at, sorted within each group (bounds has the groups' ends too): merges of runs of doubling width, all groups together; groups that are in order stay."""
        if len(at) > 1:
            inner = np.ones(len(at) - 1, bool)
            inner[bounds[1:-1] - 1] = False
            x = np.flatnonzero(inner)
            x = x[self.compare(at[x], at[x + 1]) > 0]
            wrong = np.zeros(len(bounds) - 1, bool)
            wrong[np.searchsorted(bounds, x, "right") - 1] = True
            if not wrong.all():
                some = np.repeat(wrong, np.diff(bounds))
                out = at.copy()
                if wrong.any():
                    out[some] = self.merge(at[some], np.concatenate(([0], np.cumsum(np.diff(bounds)[wrong]))))
                return out
        return self.merge(at, bounds)

    def merge(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        at = at.copy()
        size = np.diff(bounds)
        first, n = np.repeat(bounds[:-1], size), np.repeat(size, size)
        own = np.arange(len(at)) - first
        width = 1
        while True:
            base = own // (2 * width) * (2 * width)
            left = own - base < width
            begin = np.where(left, base + width, base)  # the other run, within the group
            end = np.minimum(begin + width, n)
            move = np.flatnonzero(begin < end)
            if not len(move):
                if width >= size.max(initial=0):
                    return at
                width *= 2
                continue
            me, mine, side = at[move], first[move], left[move]
            low, high = begin[move], end[move]
            start = low.copy()
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                c = self.compare(at[mine[open_] + mid], me[open_])
                before = np.where(side[open_], c < 0, c <= 0)  # on ties the left run comes first
                low[open_] = np.where(before, mid + 1, low[open_])
                high[open_] = np.where(before, high[open_], mid)
            rank = low - start
            to = mine + base[move] + np.where(side, own[move] - base[move], own[move] - base[move] - width) + rank
            new = at.copy()
            new[to] = me
            at = new
            width *= 2


def repeated(data: np.ndarray, seg_at: np.ndarray, count: np.ndarray, seed: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and window starts of windows that have an earlier equal. Segment i lies at seg_at[i] of data and begins at window start[i] of document doc[i]."""
    order = np.lexsort((start, doc))
    seg_at, count, seed, doc, start = seg_at[order], count[order], seed[order], doc[order], start[order]
    at = ranges(seg_at, count)
    of = np.repeat(np.arange(len(count)), count)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    sorter = SuffixSort(data, length)
    # suffixes whose whole hash no other has equal nothing and needn't be sorted
    whole = sorter.hash(at, length)
    order = np.argsort(whole)
    cut = groups(whole[order])
    keep = np.sort(order[np.repeat(np.diff(cut) > 1, np.diff(cut))])
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))[at[keep]].astype(np.uint64)
    key = textkit.mix(seed[of[keep]] ^ textkit.mix(head))
    order = np.argsort(key, kind="stable")
    order, key = keep[order], key[order]
    position = at[order]
    bounds = groups(key)
    ranked = sorter.sort(position, bounds)
    # which item lies where after sorting: positions in data are unique
    back = np.argsort(position)
    order = order[back[np.searchsorted(position[back], ranked)]]
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    equal = np.zeros(max(len(ranked) - 1, 0), bool)
    near = np.flatnonzero(group[1:] == group[:-1])
    by_bytes = compare_bytes(data, ranked[near], ranked[near + 1], length)
    wrong = np.unique(group[near[(by_bytes > 0) | (by_bytes == 0) & (order[near] > order[near + 1])]])
    if len(wrong):  # hashes have collided
        for g in wrong:
            a, b = bounds[g], bounds[g + 1]
            again = np.array(sorted(range(a, b), key=lambda i: (data[ranked[i] : ranked[i] + length].tobytes(), order[i])))
            ranked[a:b], order[a:b] = ranked[again], order[again]
        by_bytes = compare_bytes(data, ranked[near], ranked[near + 1], length)
    equal[near] = by_bytes == 0
    first = np.maximum.accumulate(np.where(np.concatenate(([True], ~equal)), np.arange(len(ranked)), 0))
    d, s = doc[of[order]], start[of[order]] + (at[order] - seg_at[of[order]])
    marked = (d != d[first]) | (s != s[first])
    return d[marked], s[marked]


def send_segments(length: int, seed: int, n_buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            data, count, key, doc, start = (np.concatenate(x) for x in zip(*held))
            held.clear()
            size = count + length - 1
            at = np.cumsum(size) - size
            # equal segments: the earliest stays
            total, down = prefix_hashes(data)
            content = textkit.mix((total[at + size] - total[at]) * down[at]) ^ size.astype(np.uint64)
            order = np.lexsort((start, doc, content))
            first = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(content[order].view(np.int64)) != 0)), np.arange(len(order)), 0))
            a, b = order, order[first]
            same = (a != b) & (size[a] == size[b]) & (key[a] == key[b]) & ((doc[a] != doc[b]) | (start[a] != start[b]))
            x = np.flatnonzero(same)
            same[x] = equal_bytes(data, at[a[x]], at[b[x]], size[a[x]])
            gone = np.zeros(len(at), bool)
            gone[a[same]] = True
            out = []
            ids, (runs,) = by_document(doc[gone], np.stack((start[gone], count[gone]), 1).astype(np.int32)) if gone.any() else ([], ([],))
            out += [(None, i, r, None, None, None, None, None) for i, r in zip(ids, runs)]
            stay = np.flatnonzero(~gone)
            where = (key[stay] % np.uint64(n_buckets)).astype(np.int64)
            stay = stay[np.argsort(where, kind="stable")]
            where = np.sort(where)
            cut = groups(where)
            for i, j in zip(cut[:-1], cut[1:]):
                x = stay[i:j]
                out.append((int(where[i]), None, None, data[ranges(at[x], size[x])].tobytes(), count[x].astype(np.int32).tobytes(), key[x].tobytes(), doc[x].tobytes(), start[x].astype(np.int32).tobytes()))
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["bucket", "doc_id", "runs", "data", "count", "seed", "doc", "start"])

        gathered = 0
        for b in textkit.pieces(batches):
            ids = b.column("doc_id").to_numpy()
            data, off = textkit.utf8(b.column("text"))
            s = Segments(data, off, length, seed)
            first = np.searchsorted(s.row, np.arange(len(off)))
            chosen, hot = np.zeros(len(s.row), bool), np.zeros(len(s.row), bool)
            for i, marks in enumerate(b.column("marks").to_pylist()):
                m = np.frombuffer(b"".join(marks), np.int32).astype(np.int64)
                o = np.where(m < 0, -1 - m, m)
                ok = o < first[i + 1] - first[i]
                chosen[first[i] + o[ok]] = True
                hot[first[i] + o[ok & (m < 0)]] = True
            x, y = np.flatnonzero(chosen & ~hot), np.flatnonzero(hot)
            start, count, key, row = s.start[x], s.count[x], s.seed[x], s.row[x]
            if len(y):  # single windows, dealt by their content
                single = ranges(s.start[y], s.count[y])
                total, down = prefix_hashes(data)
                start = np.concatenate((start, single))
                count = np.concatenate((count, np.ones(len(single), np.int64)))
                key = np.concatenate((key, textkit.mix((total[single + length] - total[single]) * down[single])))
                row = np.concatenate((row, np.repeat(s.row[y], s.count[y])))
            step = max(1, 2 * SEND_BYTES // length)
            for a in range(0, len(start), step):
                z = slice(a, a + step)
                held.append((data[ranges(start[z], count[z] + length - 1)], count[z], key[z], ids[row[z]], start[z] - off[row[z]]))
                gathered += len(held[-1][0])
                if gathered >= SEND_BYTES:
                    yield flush()
                    gathered = 0
        if gathered:
            yield flush()

    return send


def sort_bucket(length: int) -> Callable[[pa.Table], pa.Table]:
    def sort(table: pa.Table) -> pa.Table:
        col = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        data, count = col("data", np.uint8), col("count", np.int32).astype(np.int64)
        size = count + length - 1
        d, s = repeated(data, np.cumsum(size) - size, count, col("seed", np.uint64), col("doc", np.int64), col("start", np.int32).astype(np.int64), length)
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        new = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)))) if len(d) else np.zeros(0, np.int64)
        runs = np.stack((s[new], np.diff(np.append(new, len(d)))), 1).astype(np.int32)
        ids, (runs,) = by_document(d[new], runs) if len(new) else ([], ([],))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "runs": pa.array(runs, pa.binary())})

    return sort


def covered(n: int, runs: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes lie in a marked window; runs has (first window, number of windows)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.minimum(runs[:, 0], n), 1)
    np.add.at(edge, np.minimum(runs[:, 0] + runs[:, 1] + length - 1, n), -1)
    return np.cumsum(edge)[:-1] > 0


def _nodes(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with node, a number for each different pair of them, in the order of doc_id; different texts of one doc_id follow each other by their hashes.

    It is doc_id itself where all doc_ids have one text, else doc_id times a power of two and the text's number, for which 64 bits must do.
    """
    spark = docs.sparkSession
    hashed = docs.withColumn("hash", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))
    odd = hashed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least <> most").select("doc_id")
    odd = save(odd, "several")
    if odd.isEmpty():
        forget(odd)
        return docs.withColumn("node", F.col("doc_id"))
    further = hashed.join(odd, "doc_id", "left_semi").select("doc_id", "hash").distinct()
    further = save(further.select("doc_id", "hash", (F.row_number().over(Window.partitionBy("doc_id").orderBy("hash")) - 1).alias("own")), "further")
    forget(odd)
    bits = int(further.agg(F.max("own")).first()[0]).bit_length()
    far = docs.agg(F.max(F.abs("doc_id"))).first()[0]
    if far >= 1 << 63 - bits:
        raise ValueError(f"doc_ids up to {far} leave no room for different texts of one doc_id")
    return hashed.join(further, ["doc_id", "hash"], "left").select("doc_id", "text", (F.col("doc_id") * (1 << bits) + F.coalesce("own", F.lit(0))).alias("node"))


def substring_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = False, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row; with_text adds kept, the remaining bytes (binary)."""
    spark, hot = docs.sparkSession, HOT if hot is None else hot
    own = _nodes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    long = own.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select(F.col("node").alias("doc_id"), "text")
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = buckets(spark, total // 40, BUCKET)
    marks = shared_seeds(long, length, seed, n_buckets, hot).groupBy("doc_id").agg(F.collect_list("marks").alias("marks"))
    some = save(long.join(marks.hint("merge"), "doc_id"), "shared")
    amount = some.agg(F.coalesce(F.sum(F.aggregate("marks", F.lit(0), lambda a, x: a + F.octet_length(x))), F.lit(0))).first()[0] // 4 * (length + 40)
    sent = some.mapInArrow(send_segments(length, seed, buckets(spark, int(amount), BUCKET_BYTES)), "bucket int, doc_id long, runs binary, data binary, count binary, seed binary, doc binary, start binary")
    sent = save(sent, "segments")
    found = sent.where("bucket IS NOT NULL").groupBy("bucket").applyInArrow(sort_bucket(length), "doc_id long, runs binary")
    runs = found.union(sent.where("bucket IS NULL").select("doc_id", "runs")).groupBy("doc_id").agg(F.collect_list("runs").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textkit.pieces(batches):
            removed, spans, sha, kept = [], [], [], []
            data, off = textkit.utf8(b.column("text"))
            for i, r in enumerate(b.column("runs").to_pylist()):
                text = data[off[i] : off[i + 1]]
                gone = covered(len(text), np.frombuffer(b"".join(r), np.int32).astype(np.int64).reshape(-1, 2), length)
                removed.append(int(gone.sum()))
                spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                left = text[~gone].tobytes()
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_text else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_removed", "n_spans", "kept_sha256", "kept"])

    less = some.select("doc_id", "text").dropDuplicates(["doc_id"]).join(runs.hint("merge"), "doc_id").mapInArrow(cut, "doc_id long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    less = save(less.withColumnRenamed("kept_sha256", "sha"), "cut")
    forget(some, sent)
    whole = [F.col("text").cast("binary").alias("whole")] * with_text
    out = own.select("doc_id", "node", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole_sha"), *whole).join(less.withColumnRenamed("doc_id", "node"), "node", "left")
    kept = [F.when(F.col("sha").isNull(), F.col("whole")).otherwise(F.col("kept")).alias("kept")] * with_text
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole_sha").alias("kept_sha256"), *kept)
