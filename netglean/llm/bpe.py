"""Byte-level BPE by segment trees.

A pre-token's byte positions are the leaves of a tree. Leaf i holds the rank of the pair that begins at the live
symbol i, and inner nodes the least rank below; descending to the left on ties finds the leftmost lowest pair.
A merge joins two live symbols, takes the swallowed one's leaf out and renews the leaves of the merged symbol and of its
left neighbour: three point updates, each logarithmic in the pre-token's length. The trees of all pre-tokens of
like length are rows of one array, and a step does one merge in each of them.

Null texts count as empty. Rows are independent, so ties and repeated rows have no effect; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netglean.llm import pretokens, textkit

#: Entries of each generation of a worker's memory of encoded pieces.
REMEMBER = 300_000
#: Leaves of the trees that are held at a time, if one tree has no more.
LEAVES = 1 << 20
#: Pre-tokens of one class of lengths below which each has its tree by itself; more step together. The results are the same.
FEW = 48
_NONE = np.int32(1 << 30)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Rank of the token that two tokens make together, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        key, rank = [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                left = ranks.get(token[:i])
                if left is not None and (right := ranks.get(token[i:])) is not None:
                    key.append(left << 32 | right)
                    rank.append(r)
        key, rank = np.array(key, np.int64), np.array(rank, np.int32)
        self.shift = np.uint64(62 - max(4, len(key)).bit_length())
        self.key = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.rank = np.full(len(self.key), _NONE, np.int32)
        at = self.home(key)
        while len(key):
            free = self.key[at] < 0
            self.key[at[free]] = key[free]  # of several that want a place, the last has it
            won = self.key[at] == key
            self.rank[at[won]] = rank[won]
            key, rank, at = key[~won], rank[~won], (at[~won] + 1) % len(self.key)

    def home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self.home(key)
        out, there = self.rank[at], self.key[at]
        todo = np.flatnonzero((there != key) & (there >= 0))
        out[there != key] = _NONE
        while len(todo):
            at[todo] = (at[todo] + 1) % len(self.key)
            there = self.key[at[todo]]
            same = there == key[todo]
            out[todo[same]] = self.rank[at[todo[same]]]
            todo = todo[~same & (there >= 0)]
        return out


class TreeMerger:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs, self.names = ranks, PairTable(ranks), {i: b for b, i in ranks.items()}
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each pre-token; one that is a token itself stays whole, as the library has it."""
        out: list[tuple[int, ...]] = [()] * len(words)
        classes: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[i] = (r,)
            else:
                classes.setdefault((len(w) - 1).bit_length(), []).append(i)
        for bits, members in classes.items():
            if len(members) < FEW:
                for i in members:
                    out[i] = tuple(self.grow_one(words[i]))
                continue
            step = max(1, LEAVES >> bits)
            for a in range(0, len(members), step):
                for i, ids in zip(members[a : a + step], self.grow(1 << bits, [words[i] for i in members[a : a + step]])):
                    out[i] = tuple(ids)
        return out

    def grow_one(self, word: bytes) -> list[int]:
        """grow() for a single pre-token, however long."""
        n, size = len(word), 1 << max(len(word) - 1, 1).bit_length()
        sym = [self.ranks[word[i : i + 1]] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda a, b: self.ranks.get(self.names[a] + self.names[b], _NONE)
        tree = [_NONE] * size + [rank(a, b) for a, b in zip(sym, sym[1:])]
        tree += [_NONE] * (2 * size - len(tree))
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(leaf: int, value: int) -> None:
            node = leaf + size
            tree[node] = value
            while node := node >> 1:
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low

        while (low := tree[1]) < _NONE:
            i = 1
            while i < size:
                i = 2 * i + (tree[2 * i] != low)
            i -= size
            j = after[i]
            k = after[j]
            sym[i], after[i], sym[j] = low, k, -1
            put(j, _NONE)
            if k < n:
                before[k] = i
            put(i, rank(low, sym[k]) if k < n else _NONE)
            if (h := before[i]) >= 0:
                put(h, rank(sym[h], low))
        return [s for s in sym if s >= 0]

    def grow(self, size: int, words: list[bytes]) -> list[list[int]]:
        n = np.array([len(w) for w in words])
        rows, at = len(words), np.arange(size)
        live = at < n[:, None]
        sym = np.zeros((rows, size), np.int32)
        sym[live] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, size + 1, dtype=np.int32), (rows, 1))
        before = np.tile(np.arange(-1, size - 1, dtype=np.int32), (rows, 1))
        tree = np.full((rows, 2 * size), _NONE, np.int32)
        tree[:, size:-1] = np.where(live[:, 1:], self.pairs.find(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(rows, size - 1), _NONE)
        width = size
        while width > 1:
            np.minimum(tree[:, width : 2 * width : 2], tree[:, width + 1 : 2 * width : 2], out=tree[:, width // 2 : width])
            width //= 2

        def put(row: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            node = leaf + size
            tree[row, node] = rank
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        row = np.arange(rows)
        while len(row := row[tree[row, 1] < _NONE]):
            low, i = tree[row, 1], np.ones(len(row), np.int64)
            for _ in range(size.bit_length() - 1):
                i = 2 * i + (tree[row, 2 * i] != low)
            i -= size
            j = after[row, i]
            k = after[row, j]
            sym[row, i], after[row, i] = low, k
            live[row, j] = False
            put(row, j, np.full(len(row), _NONE))
            there = k < n[row]
            new = np.full(len(row), _NONE)
            r, a, b = row[there], i[there], k[there]
            before[r, b] = a
            new[there] = self.pairs.find(sym[r, a], sym[r, b])
            put(row, i, new)
            h = before[row, i]
            there = h >= 0
            r, a, b = row[there], h[there], i[there]
            put(r, a, self.pairs.find(sym[r, a], sym[r, b]))
        flat, ends = sym[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Codec:
    def __init__(self, path: str, pattern: str = pretokens.PATTERN):
        ranks = read_ranks(path)
        self.merger, self.pattern, self.known = TreeMerger(ranks), pretokens.compiled(pattern), pretokens.Memory(REMEMBER)
        self.bytes = {i: b for b, i in ranks.items()}
        self.text = {i: str(i) for i in self.bytes}

    def learn(self, new: list[str]) -> None:
        tokens = [pretokens.matches(x, self.pattern) for x in new]
        flat = list(dict.fromkeys(t for ts in tokens for t in ts))
        ids = dict(zip(flat, self.merger.encode([t.encode() for t in flat])))
        self.known.young.update((x, ids[ts[0]] if len(ts) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, ts)))) for x, ts in zip(new, tokens))

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        cut = [(pretokens.spaced(x) if x else []) for x in texts]
        cut = [self.pattern.findall(x) if c is None else c for x, c in zip(texts, cut)]
        self.learn(self.known.missing(set().union(*cut)))
        ids = self.known.young.__getitem__
        return (list(chain.from_iterable(map(ids, c))) for c in cut)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded bytes) of each row's text; with_ids adds the ids.

    vocabulary is the path of a .tiktoken file of ranks, the same on all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for b in textkit.pieces(batches):
            n, ids_sha, text_sha, all_ids = [], [], [], []
            for ids in codec.encode([x or "" for x in b.column("text").to_pylist()]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(codec.text.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            out = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids, names + ["ids"] * with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, schema)
