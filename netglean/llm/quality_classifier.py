"""Quality scores by Bradley-Terry ranking.

A document's strength is linear in features of its text alone. From labelled rows, pairs of one good and one poor document
are preferences; the logistic loss of the difference of their features is minimised by Newton steps. The score is
the logistic function of the strength's distance from a threshold, the quantile of the training rows' strengths that errs least,
so that a score of 0.5 or more predicts label 1.

Null texts count as empty; an empty text has features, all 0, and so a score. Rows are scored one by one, so ties and
repeated rows have no effect on each other; training takes the least of several texts of one id, and rows in order of their ids; long texts are read whole; an empty table gives an empty result; extra columns are ignored. Labels that are null, or contradict
each other for one document, are left out of training; without both labels all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netglean.llm import textkit
from netglean.llm.quality_rules import STOP_WORDS

#: Most labelled rows that training takes, those with the least hashes of their ids, and preference pairs among them.
MAX_ROWS, MAX_PAIRS = 10_000, 100_000
RIDGE = 1e-2

_CLASSES = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>", "stop": b".,;:", "loud": b"!?", "line": b"\n"}
FEATURES = [*_CLASSES, "words", "word_bytes", "distinct", "function", "adjacent", "repeated"]


def _hashes(words: list[str]) -> np.ndarray:
    return np.unique(textkit.Words(pa.array(words)).hash)


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text: shares of kinds of bytes, and of kinds of words, bounded so that length alone can't dominate."""
    w = textkit.Words(column)
    rows = len(w.off) - 1
    size, n = np.diff(w.off), np.diff(w.first)
    out = np.zeros((rows, len(FEATURES)))
    for k, members in enumerate(_CLASSES.values()):
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        total = np.concatenate(([0], np.cumsum(table[w.data])))
        out[:, k] = (total[w.off[1:]] - total[w.off[:-1]]) / np.maximum(size, 1)
    k, words = len(_CLASSES), np.maximum(n, 1)
    out[:, k] = np.log1p(n) / 10
    out[:, k + 1] = np.bincount(w.row, w.end - w.start, rows) / words / 10
    order = np.lexsort((w.hash, w.row))
    row, h = w.row[order], w.hash[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    out[:, k + 2] = np.bincount(row[new], minlength=rows) / words
    known = _hashes([x + end for x in STOP_WORDS for end in ("", ".", ",")])
    out[:, k + 3] = np.bincount(w.row[np.isin(w.hash, known)], minlength=rows) / words
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    out[:, k + 4] = np.bincount(w.row[same], minlength=rows) / words
    s, first = w.shingles(3)
    row = np.repeat(np.arange(rows), np.diff(first))
    order = np.lexsort((s, row))
    row, s = row[order], s[order]
    again = np.zeros(len(s), bool)
    again[1:] = (row[1:] == row[:-1]) & (s[1:] == s[:-1])
    out[:, k + 5] = np.bincount(row[again], minlength=rows) / words
    return out


class Ranking:
    """A trained model: weights of standardised features, and the threshold."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        self.weight, self.threshold = np.zeros(len(FEATURES)), 0.0
        if not (good.any() and (~good).any()):
            return
        z = (x - self.mean) / self.scale
        rng = np.random.default_rng(7)
        a, b = np.flatnonzero(good), np.flatnonzero(~good)
        pairs = min(MAX_PAIRS, 20 * len(x))
        d = z[a[rng.integers(0, len(a), pairs)]] - z[b[rng.integers(0, len(b), pairs)]]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(d @ self.weight, -30, 30)))  # that the good one is preferred
            slope = d.T @ (p - 1) / len(d) + RIDGE * self.weight
            curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(d.shape[1])
            step = np.linalg.solve(curve, slope)
            self.weight -= step
            if np.abs(step).max() < 1e-6:
                break
        strength = z @ self.weight
        order = np.argsort(strength, kind="stable")
        s, g = strength[order], good[order]
        wrong = np.concatenate(([0], np.cumsum(g))) + np.concatenate((np.cumsum((~g)[::-1])[::-1], [0]))  # the first i called poor
        wrong[1:-1][s[1:] == s[:-1]] = len(g)
        best = np.flatnonzero(wrong == wrong.min())
        i = int(best[len(best) // 2])
        self.threshold = float((s[max(i - 1, 0)] + s[min(i, len(s) - 1)]) / 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weight - self.threshold, -30, 30)))


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Learns from at most MAX_ROWS labelled rows that aren't held out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS).select("doc_id", "quality")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")  # of at most MAX_ROWS rows of two numbers
    text = text.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one row for each labelled id, however many it has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textkit.pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(list(features(b.column("text"))), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    got = text.mapInArrow(run, "doc_id long, quality int, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES))
    return Ranking(x, got["quality"].to_numpy() == 1)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in textkit.pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(features(b.column("text"))))], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
