"""Exact n-gram Jaccard join by signature trees.

1. Every document's set of shingle hashes gets its size and a hash of 128 bits; equal sets form a class,
   represented by its least doc_id.
2. Sizes are dealt into bands so that linked sets lie in one band or in two adjacent ones. Two sets that link, the larger in band b,
   differ in at most k(b) shingles. So if the space of hashes is cut into a ring of k(b) + r ranges, there are at least r ranges
   from which on, for every length l, the two sets differ in fewer than l shingles over l ranges (the cycle lemma). There the first
   range agrees, and over CHAIN ranges fewer than CHAIN shingles differ. A range's content, with band and range, is hashed
   into a key; a signature of 64 parity bits stands for the chain of ranges that it begins. Sets may link if they have an equal key whose
   signatures differ in fewer than CHAIN bits; a frequent passage alone brings that about in hardly any pair. Empty ranges are left out
   unless a set has r of them. Each batch sends equal keys and signatures once, gathers many close signatures of a key
   under one with a radius, and keeps a spanning forest of what its sets share.
3. The components of sets that may link, a superset of the result's, are blocks. Their sets are brought together,
   blocks of more than CELL sets as pairs of pages.
4. In each cell, a signature tree's leaves are the sets' token bitmaps, ordered by their least hashes; inner nodes hold the OR of
   their children's bitmaps and the range of their sizes. Going down two nodes at a time, a pair of nodes is pruned when
   its largest possible overlap is less than what its smallest sizes need, when its sizes are too far apart, or when all its sets
   are already connected. Pairs of leaves are decided by their exact overlap.
5. Components of the links are those of the result.

Null and empty texts have no words: size 0, linked with nothing, each its own component. Rows with one doc_id are one node, and
each has the result of its own text; a null doc_id takes part, represented by another id of its class if there is one, and its component
may be null. An empty table gives an empty result; extra columns are ignored. Shingles are
compared by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netglean.llm import textkit
from netglean.llm.components import connected_components, forest
from netglean.llm.shared import buckets, forget, save

#: Keys that a mapper gathers before it sends them, and keys in a bucket.
FLUSH, BUCKET = 1_000_000, 400_000
#: Most sets that a page of a large block has, and bits of a cell's bitmaps.
CELL, BITS = 6000, 16384
FANOUT = 8
#: Ranges that a signature covers; signatures of a key in a batch beyond which those within RADIUS bits are gathered.
CHAIN, MANY, RADIUS = 8, 64, 3


class Threshold:
    """Links at num / den or more; bands and key counts follow from it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]
        while self.lows[-1] < 2**31:
            self.lows.append(max(self.lows[-1] + 1, -(-self.lows[-1] * den // num)))

    def band(self, n: int) -> int:
        return bisect_right(self.lows, n) - 1

    def differ(self, band: int) -> int:
        """Most shingles in which two linked sets differ, the larger in this band."""
        return (self.den - self.num) * 2 * (self.lows[band + 1] - 1) // (self.num + self.den)

    def need(self, total):
        """Least overlap that links two sets of this total size."""
        return -(-self.num * total // (self.num + self.den))


@lru_cache(maxsize=4096)
def _ranges(m: int) -> np.ndarray:
    return np.array([i * 2**64 // m for i in range(1, m)], np.uint64)


def keys_of(s: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """A sorted set's keys, and the signature of the chain of ranges that each begins."""
    own, keys, sigs = t.band(len(s)), [], []
    total = parity = None
    for band in (own, own + 1):
        k = t.differ(band)
        if not k:
            continue
        if total is None:
            total, parity = np.zeros(len(s) + 1, np.uint64), np.zeros(len(s) + 1, np.uint64)
            np.cumsum(textkit.mix(s ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
            np.bitwise_xor.accumulate(np.uint64(1) << (s & np.uint64(63)), out=parity[1:])
        spare = 2 + k // 32
        m = k + spare
        at = np.concatenate(([0], np.searchsorted(s, _ranges(m)), [len(s)]))
        salt = np.arange(m, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(band * 0x2545F4914F6CDD1D % 2**64)
        key = textkit.mix(textkit.mix(total[at[1:]] - total[at[:-1]]) + salt)
        stop = np.arange(m) + min(CHAIN, m)
        around = np.where(stop > m, parity[-1], np.uint64(0))
        sig = parity[at[np.where(stop > m, stop - m, stop)]] ^ parity[at[:-1]] ^ around
        full = at[1:] > at[:-1]
        if (~full).sum() < spare:
            key, sig = key[full], sig[full]
        keys.append(key)
        sigs.append(sig)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(keys), np.concatenate(sigs)) if keys else (none, none)


class Marks:
    """Rows (key, signature, radius, document): the documents of a row lie within its radius of its signature."""

    def __init__(self, key: np.ndarray, sig: np.ndarray, radius: np.ndarray, doc: np.ndarray):
        order = np.lexsort((doc, sig, key))
        key, sig, radius, doc = key[order], sig[order], radius[order], doc[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        least = doc[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
        self.edges = [(doc[~first], least[~first])]
        self.radius = np.maximum.reduceat(radius, np.flatnonzero(first)) if len(key) else radius
        self.key, self.sig, self.doc = key[first], sig[first], doc[first]

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each key's rows."""
        start = np.flatnonzero(np.concatenate(([True], self.key[1:] != self.key[:-1]))) if len(self.key) else np.zeros(0, np.int64)
        return start, np.diff(np.append(start, len(self.key)))

    def gather(self) -> None:
        """Of keys with many rows, those within RADIUS of a leader become one with it."""
        keep = np.ones(len(self.key), bool)
        for a, n in zip(*(x.tolist() for x in self.groups())):
            if n <= MANY:
                continue
            rest = np.arange(a, a + n)
            while len(rest):
                far = np.bitwise_count(self.sig[rest] ^ self.sig[rest[0]])
                near = far <= RADIUS
                mine = rest[near]
                self.radius[mine[0]] = max(int(far[near].max()), int(self.radius[mine[0]]))
                keep[mine[1:]] = False
                self.edges.append((self.doc[mine[1:]], np.full(len(mine) - 1, self.doc[mine[0]])))
                rest = rest[~near]
        self.key, self.sig, self.radius, self.doc = (x[keep] for x in (self.key, self.sig, self.radius, self.doc))

    def match(self) -> None:
        """Edges between the rows of one key that may stand for linked sets."""
        start, size = self.groups()
        radius = self.radius.astype(np.int64)
        for n in np.unique(size[(size > 1) & (size <= MANY)]).tolist():
            i, j = np.triu_indices(n, 1)
            of = start[size == n]
            step = max(1, 2_000_000 // len(i))
            for a in range(0, len(of), step):
                x, y = ((of[a : a + step, None] + k).ravel() for k in (i, j))
                ok = np.bitwise_count(self.sig[x] ^ self.sig[y]) < CHAIN + radius[x] + radius[y]
                self.edges.append((self.doc[x[ok]], self.doc[y[ok]]))
        for a, n in zip(start[size > MANY].tolist(), size[size > MANY].tolist()):
            rest = np.arange(a, a + n)
            while len(rest):
                todo, rest = [rest[0]], rest[1:]
                while todo and len(rest):
                    x = todo.pop()
                    near = np.bitwise_count(self.sig[rest] ^ self.sig[x]) < CHAIN + radius[x] + radius[rest]
                    if near.any():
                        mine, rest = rest[near], rest[~near]
                        todo.extend(mine.tolist())
                        self.edges.append((self.doc[mine], np.full(len(mine), self.doc[x])))

    def forest(self, *more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        u, v = (np.concatenate(x) for x in zip(*self.edges, *more))
        return forest(u[u != v], v[u != v])


def _packed(part: np.ndarray, *columns: np.ndarray) -> dict[int, tuple[bytes, ...]]:
    """The columns' bytes for each part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    start = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else part
    columns = [c[order] for c in columns]
    return {int(part[a]): tuple(c[a:b].tobytes() for c in columns) for a, b in zip(start, np.append(start[1:], len(part)))}


def sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n and the hash (h1, h2) of each row's shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textkit.pieces(batches):
            own = textkit.unique_sets(*textkit.Words(b.column("text")).shingles(k))
            h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.data) for s in own), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in own], pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "n", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long")


def shared_keys(docs: DataFrame, k: int, t: Threshold, n_buckets: int) -> DataFrame:
    """Edges (u, v) between documents that may link by their keys and signatures: for each bucket of keys a spanning forest."""
    types = {"key": np.uint32, "sig": np.uint64, "radius": np.uint8, "doc": np.int64, "u": np.int64, "v": np.int64}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, sig, doc = (np.concatenate(x) for x in zip(*held))
            held.clear()
            marks = Marks(key, sig, np.zeros(len(key), np.uint8), doc)
            marks.gather()
            u, v = marks.forest()
            n = np.uint64(n_buckets)
            keys = _packed(marks.key % n, (marks.key >> np.uint64(32)).astype(np.uint32), marks.sig, marks.radius, marks.doc)
            edges = _packed(v.view(np.uint64) % n, u, v)
            ids = sorted({*keys, *edges})
            both = [keys.get(i, (b"",) * 4) + edges.get(i, (b"",) * 2) for i in ids]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*both))], ["bucket", *types])

        size = 0
        for b in textkit.pieces(batches):
            own = textkit.unique_sets(*textkit.Words(b.column("text")).shingles(k))
            seen = set()
            for doc, s in zip(b.column("doc_id").to_pylist(), own):
                if doc is None or not len(s):
                    continue
                h = (doc, xxhash.xxh3_64_intdigest(s.data))
                if h in seen:
                    continue
                seen.add(h)
                key, sig = keys_of(s, t)
                held.append((key, sig, np.full(len(key), doc, np.int64)))
                size += len(key)
            if size >= FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        key, sig, radius, doc, u, v = (np.frombuffer(b"".join(table.column(c).to_pylist()), d) for c, d in types.items())
        marks = Marks(key, sig, radius, doc)
        marks.match()
        u, v = marks.forest((u, v))
        rows = _packed(u.view(np.uint64) % np.uint64(n_buckets), u, v)
        return pa.table([pa.array(list(rows), pa.int32()), *(pa.array([r[i] for r in rows.values()], pa.binary()) for i in (0, 1))], ["part", "u", "v"])

    def once(table: pa.Table) -> pa.Table:
        u, v = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("u", "v"))
        u, v = forest(u, v)  # what many buckets say of the same documents
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    sent = docs.mapInArrow(send, "bucket int, " + ", ".join(f"{c} binary" for c in types))
    met = sent.groupBy("bucket").applyInArrow(meet, "part int, u binary, v binary")
    return met.groupBy("part").applyInArrow(once, "u long, v long")


class Tree:
    """A signature tree over sets (sorted arrays of hashes)."""

    def __init__(self, own: list[np.ndarray]):
        sizes = np.array([len(s) for s in own])
        tokens, at, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        rank = np.cumsum(count > 1) - 1  # tokens of one set alone overlap with nothing
        owner = np.repeat(np.arange(len(own)), sizes)
        common = count[at] > 1
        owner, bit = owner[common], rank[at[common]]
        width = max(1, -(-min(int(rank[-1]) + 1, BITS) // 64))
        self.exact = rank[-1] < BITS
        bit = bit % (width * 64)
        maps = np.zeros(len(own) * width, np.uint64)
        np.bitwise_or.at(maps, owner * width + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        maps = maps.reshape(len(own), width)
        slack = np.bincount(owner, minlength=len(own)) - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, slack)]
        while len(maps) > 1:
            cut = np.arange(0, len(maps), FANOUT)
            maps = np.bitwise_or.reduceat(maps, cut, axis=0)
            _, low, high, slack = self.levels[-1]
            self.levels.append((maps, np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut)))
        self.own = own

    def possible(self, level: int, i: np.ndarray, j: np.ndarray, t: Threshold) -> np.ndarray:
        """Whether node pairs can hold a link, by sizes and by the largest overlap."""
        maps, low, high, slack = self.levels[level]
        ok = (high[i] * t.den >= low[j] * t.num) & (high[j] * t.den >= low[i] * t.num)
        at = np.flatnonzero(ok)
        step = max(1, 4_000_000 // maps.shape[1])
        for a in range(0, len(at), step):
            x = at[a : a + step]
            most = np.bitwise_count(maps[i[x]] & maps[j[x]]).sum(axis=1, dtype=np.int64) + np.minimum(slack[i[x]], slack[j[x]])
            ok[x] = most >= t.need(low[i[x]] + low[j[x]])
        return ok

    def links(self, i: np.ndarray, j: np.ndarray, t: Threshold) -> np.ndarray:
        """Which pairs of sets link."""
        ok = self.possible(0, i, j, t)
        if not self.exact:
            for x in np.flatnonzero(ok):
                a, b = self.own[i[x]], self.own[j[x]]
                ok[x] = len(np.intersect1d(a, b, assume_unique=True)) >= t.need(len(a) + len(b))
        return ok


def link_cell(own: list[np.ndarray], t: Threshold, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions) of the links among the sets; with side, of those between the two sides and whatever else it meets."""
    n = len(own)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n == 2:
        a, b = own
        yes = min(len(a), len(b)) >= t.need(len(a) + len(b)) and len(np.intersect1d(a, b, assume_unique=True)) >= t.need(len(a) + len(b))
        return (np.array([1]), np.array([0])) if yes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = sorted(range(n), key=lambda x: own[x][:4].tolist())
    tree, root = Tree([own[x] for x in order]), np.arange(n)
    of = np.zeros(n, np.int8) if side is None else side[np.array(order)]

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        i, j = root[i], root[j]
        u, v = forest(i[i != j], j[i != j])
        to = np.arange(n)
        to[u] = v
        root = to[root]

    def try_pairs(i: np.ndarray, j: np.ndarray) -> None:
        i, j = i[root[i] != root[j]], j[root[i] != root[j]]
        if len(i):
            yes = tree.links(i, j, t)
            join(i[yes], j[yes])

    for gap in (1, 2, 3):  # neighbours first: what they connect prunes the rest
        try_pairs(np.arange(n - gap), np.arange(gap, n))
    top = len(tree.levels) - 1

    def one(level: int) -> tuple[np.ndarray, np.ndarray]:
        """Each node's component, or -1; each node's sides as bits."""
        cut = np.arange(0, n, FANOUT**level)
        low, high = np.minimum.reduceat(root, cut), np.maximum.reduceat(root, cut)
        return np.where(low == high, low, -1), np.bitwise_or.reduceat(1 << of, cut)

    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if not level:
            for a in range(0, len(i), 20_000):
                x, y = i[a : a + 20_000], j[a : a + 20_000]
                if side is not None:
                    apart = of[x] != of[y]
                    x, y = x[apart], y[apart]
                try_pairs(x, y)
            continue
        same, bits = one(level)
        keep = ~((same[i] == same[j]) & (same[i] >= 0))
        if side is not None:
            keep &= (bits[i] | bits[j]) == 3
        i, j = i[keep], j[keep]
        ok = (i == j) | tree.possible(level, i, j, t)
        i, j = i[ok], j[ok]
        size = len(tree.levels[level - 1][0])
        for a in range(0, len(i), 4096):
            x = (i[a : a + 4096, None] * FANOUT + np.repeat(np.arange(FANOUT), FANOUT)).ravel()
            y = (j[a : a + 4096, None] * FANOUT + np.tile(np.arange(FANOUT), FANOUT)).ravel()
            ok = (x < size) & (y < size) & ((x < y) | ((x == y) & (level > 1)))
            if ok.any():
                stack.append((level - 1, x[ok], y[ok]))
    child = np.flatnonzero(root != np.arange(n))
    order = np.array(order)
    return order[child], order[root[child]]


def cell_links(members: DataFrame, docs: DataFrame, k: int, t: Threshold, n_bins: int) -> DataFrame:
    """Links (u, v), a spanning forest for each cell. members: doc_id, cells (array of (cell, side)); each of a document's cells gets its set."""

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textkit.pieces(batches):
            own = textkit.unique_sets(*textkit.Words(b.column("text")).shingles(k))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("cells"), pa.array([s.tobytes() for s in own], pa.binary())], ["doc_id", "cells", "tokens"])

    def solve(table: pa.Table) -> pa.Table:
        cell = table.column("cell").to_numpy()
        doc, side = table.column("doc_id").to_numpy(), table.column("side").to_numpy()
        order = np.lexsort((doc, cell))
        cut = np.concatenate(([0], np.flatnonzero(np.diff(cell[order])) + 1, [len(order)]))
        us, vs = [], []
        for a, b in zip(cut[:-1], cut[1:]):
            at = order[a:b]
            own = [np.frombuffer(x, np.uint64) for x in table.column("tokens").take(pa.array(at)).to_pylist()]
            sides = side[at]
            u, v = link_cell(own, t, sides if sides.any() and not sides.all() else None)
            us.append(doc[at[u]])
            vs.append(doc[at[v]])
        return pa.table({"u": pa.array(np.concatenate(us), pa.int64()), "v": pa.array(np.concatenate(vs), pa.int64())})

    got = docs.join(members.hint("merge"), "doc_id").select("doc_id", "text", "cells")
    got = got.mapInArrow(with_sets, "doc_id long, cells array<struct<cell: long, side: int>>, tokens binary")
    got = got.select("doc_id", "tokens", F.explode("cells").alias("c")).select("doc_id", "tokens", "c.cell", "c.side")
    return got.withColumn("bin", F.pmod(F.xxhash64("cell"), F.lit(n_bins))).groupBy("bin").applyInArrow(solve, "u long, v long")


def jaccard_join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of each row: sets of k-word shingles link at a similarity of num / den or more."""
    spark, t = docs.sparkSession, Threshold(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = save(sets(docs, k), "sets")
    # dealt by a third key, so that adaptive execution may split a class of very many copies
    third = F.xxhash64("h1").alias("h3")
    classes = save(own.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("members")), "classes")
    several = classes.where("members > 1").select("h1", "h2", third, "rep")
    total = own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_buckets = buckets(spark, 4 * (den - num) * total // (num + den), BUCKET)
    copies = own.where("n > 0").select("doc_id", "h1", "h2", third).join(several, ["h1", "h2", "h3"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    near = connected_components(shared_keys(docs, k, t, n_buckets).union(copies), "blocks")
    # the representatives in each block, and for large blocks the pairs of pages
    reps = classes.groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n"))
    blocks = save(near.join(reps, "node").select("node", "n", F.col("root").alias("block")), "members")
    forget(near)
    sizes = blocks.groupBy("block").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")).where("members > 1")
    pages = F.ceil(F.greatest(F.col("members") / CELL, F.col("tokens") / (CELL * 500)))
    members = blocks.join(sizes.select("block", pages.alias("pages")), "block").withColumn("page", F.pmod(F.xxhash64("node"), F.col("pages")))
    cells = F.expr("""
        CASE WHEN pages = 1 THEN array(struct(block AS cell, 0 AS side)) ELSE
          transform(sequence(0L, pages - 1), q -> struct(xxhash64(block, least(page, q), greatest(page, q)) AS cell, CAST(page > q AS INT) AS side)) END""")
    members = members.select(F.col("node").alias("doc_id"), cells.alias("cells"))
    amount = sizes.agg(F.coalesce(F.sum(F.col("tokens") * pages), F.lit(0))).first()[0]
    links = connected_components(cell_links(members, docs, k, t, buckets(spark, int(amount), 1_000_000)), "links")
    forget(blocks)
    # a document's representative, and a class's component; the second join's key is the representative, so copies are dealt by their own ids too
    roots = several.select("h1", "h2", "h3", F.col("rep").alias("node")).join(links, "node", "left").select("h1", "h2", "h3", F.coalesce("root", "node").alias("of_class"))
    single = links.select(F.col("node").alias("doc_id"), "root")
    out = own.select("doc_id", "n", "h1", "h2", third).join(roots, ["h1", "h2", "h3"], "left").join(single, "doc_id", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("of_class", "root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs as row (a struct of all columns), text, and node, a number for each different pair of doc_id and text.

    It is doc_id itself for the first text of a doc_id (by hash, commonly the only one); further texts of the same doc_id, and rows without
    doc_id, are numbered beyond all doc_ids, in the order of doc_id (nulls last) and hash.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, "text", F.col("doc_id").cast("long").alias("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("hash"))
    ids = keyed.groupBy("id").agg(F.min("hash").alias("least"), F.max("hash").alias("most"))
    odd = save(ids.where("id IS NULL OR least <> most").select(F.col("id").alias("odd"), F.when(F.col("id").isNotNull(), F.col("least")).alias("least")), "odd")
    top = keyed.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    again = F.col("id").eqNullSafe(F.col("odd"))
    further = keyed.select("id", "hash").join(odd, again).where("least IS NULL OR hash <> least").select("id", "hash").distinct()
    further = further.orderBy(F.col("id").asc_nulls_last(), "hash").select(F.col("id").alias("odd"), F.col("hash").alias("other"), (F.monotonically_increasing_id() + F.lit(top + 1)).alias("number"))
    further = save(further, "further")
    return keyed.join(further, again & (F.col("hash") == F.col("other")), "left").select("row", "text", F.coalesce("number", "id").alias("node"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row for each component. Different texts of one doc_id, and texts without doc_id, are documents of their own.

    That of the least doc_id stays, the first texts of all doc_ids before further ones and those without doc_id; of rows equal in doc_id and text, that of
    the least JSON of the other columns.
    """
    own = numbered(docs)
    winners = jaccard_join(own.select(F.col("node").alias("doc_id"), "text"), k, num, den).where("doc_id = component_id").select(F.col("doc_id").alias("node")).distinct()
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    kept = own.join(winners, "node", "left_semi")
    rows = kept.groupBy("node").agg(F.min_by("row", F.to_json(F.struct(*others)) if others else F.lit(0)).alias("row"))
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
