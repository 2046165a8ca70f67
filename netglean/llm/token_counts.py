"""Token counts: rank-synchronous merging of ragged arrays.

All distinct pre-tokens of a batch lie one after another in one array of symbols. Each round looks up
the rank of every adjacent pair, takes each sequence's lowest and merges its occurrences, in all
sequences at once; a sequence without a mergeable pair is done and counted. A merge's result takes part
only in merges of higher rank (checked on loading), so merging all occurrences of the lowest pair at once,
leftmost first, equals merging them one by one.

Null texts count as empty: no bytes, no tokens. Rows are independent of each other, so ties and repeated
rows have no effect; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netglean.llm import pretokens, textkit

LIMIT_TOKENS = 1024
#: Entries of each generation of a worker's memory of counted pieces.
REMEMBER = 500_000
_NONE = np.int64(2**62)


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """Counts the tokens of byte strings by a byte-level vocabulary of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        made = {i: -1 for i in self.of_byte.tolist()}
        key, out = [], []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if not (made.get(x, rank) < rank and made.get(y, rank) < rank):
                raise ValueError(f"merge {rank} uses a symbol that no earlier merge makes")
            made.setdefault(z, rank)
            key.append(x << 20 | y)
            out.append(z)
        order = np.argsort(np.array(key), kind="stable")
        self.key, self.rank, self.out = np.array(key)[order], order.astype(np.int64), np.array(out)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        done = np.array([len(t) for t in tokens], np.int64)
        live = np.flatnonzero(done > 1)
        if not len(live):
            return done
        sym = self.of_byte[np.frombuffer(b"".join(tokens[i] for i in live), np.uint8)]
        seq = np.repeat(np.arange(len(live)), done[live])
        rank = np.append(np.where(seq[1:] == seq[:-1], self.ranks(sym[:-1], sym[1:]), _NONE), _NONE)
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            best = np.minimum.reduceat(rank, starts)
            length = np.diff(np.append(starts, len(sym)))
            over = best == _NONE
            done[live[seq[starts[over]]]] = length[over]
            if over.any():
                keep = np.repeat(~over, length)
                sym, seq, rank, best, length = sym[keep], seq[keep], rank[keep], best[~over], length[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, length))
            run = np.concatenate(([True], np.diff(hit) > 1))
            hit = hit[(np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))) % 2 == 0]
            sym[hit] = self.out[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[hit] = True
            sym, seq, touched, rank = sym[keep], seq[keep], touched[keep], rank[keep]
            anew = np.flatnonzero(touched | np.append(touched[1:], False))
            anew = anew[anew < len(sym) - 1]
            rank[-1] = _NONE
            rank[anew] = np.where(seq[anew] == seq[anew + 1], self.ranks(sym[anew], sym[anew + 1]), _NONE)
        return done


class Counter:
    """Counts whole texts, remembering the pieces it has seen."""

    def __init__(self, path: str):
        self.merger, self.pattern, self.known = RankMerger(path), pretokens.compiled(), pretokens.Memory(REMEMBER)

    def learn(self, new: list[str]) -> None:
        tokens = [pretokens.matches(x, self.pattern) for x in new]
        flat = list(dict.fromkeys(t for ts in tokens for t in ts))
        size = dict(zip(flat, self.merger.counts([t.encode() for t in flat]).tolist()))
        self.known.young.update((x, sum(map(size.__getitem__, ts))) for x, ts in zip(new, tokens))

    def count(self, texts: list[str]) -> list[int]:
        extra, cut = [0] * len(texts), []
        for i, text in enumerate(texts):
            parts = [text]
            for s in self.merger.special:
                parts = [y for x in parts for y in x.split(s)]
            extra[i] = len(parts) - 1
            cut.append([p for x in parts if x for p in (pretokens.spaced(x) or [x])])
        self.learn(self.known.missing(set().union(*cut)))
        size = self.known.young.__getitem__
        return [n + sum(map(size, ps)) for n, ps in zip(extra, cut)]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of each row's text.

    vocabulary is the path of a byte-level .json file of the tokenizers library, the same on all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for b in textkit.pieces(batches):
            texts = [x or "" for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
